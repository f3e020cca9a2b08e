"""MinHash near-dedup by an inverted join on signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.llm.components import components
from motorlot.llm.store import saved

SHINGLE = 5
COORDINATES = 64
# Two sets with similarity 0.75 agree in 48 of 64 coordinates on average; fewer than 32 happens once in 218,000 pairs.
MATCHES = 32
SKETCH_BITS = 1024
HUBS = 4
FIRST_PAIRS = 2
BLOCK = 1024
CACHE_WORDS = 400_000

_RNG = np.random.default_rng(20240)
PLACES = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Distinct shingle hashes of a text: runs of SHINGLE words, or all words of a shorter text as one."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(len(h) - SHINGLE + 1, 1)
        total = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, dtype=np.uint64)
        for k in range(min(SHINGLE, len(h))):
            total += stirred(h[k:k + n] + PLACES[k])
            total *= PLACES[k]
        return np.unique(stirred(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Smallest value of each of the COORDINATES hash functions over the set, in pieces so that long sets fit."""
    best = np.full(COORDINATES, 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(s), 4096):
        best = np.minimum(best, ((s[start:start + 4096, None] * FACTORS + SHIFTS) >> np.uint64(32)).min(0).astype(np.uint32))
    return best.view(np.int32)


def sketch(s: np.ndarray) -> np.ndarray:
    """Bits that hold the parity of the elements dealt to them: two sketches differ in at most as many bits as the sets."""
    odd = np.bincount((s >> np.uint64(7)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def text_key(text: str) -> Column:
    """Name of a text, so that rows of one id or without an id can be told apart."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, set_key, sig, bits) of each row; set_key names the set and is null without words."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            n, keys, sigs, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles.of(text)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
                bits.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "set_key", "sig", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_key("text").alias("text_key")).mapInArrow(made, "doc_id long, text_key binary, n long, set_key binary, sig array<int>, bits array<long>")


def prefix_postings(sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(node, key, weight): each set under the coordinate values where a partner must show up.

    Coordinate values are ordered by how many sets hold them. Sets that agree in `matches` coordinates share one of the
    COORDINATES - matches + 1 rarest values of each, and values of a single set need no posting; so a set with fewer than
    `matches` shared values has none. weight is the sum of the list lengths: how central the set is.
    """
    coordinate = sets.select("node", F.posexplode("sig").alias("c", "v"))
    postings = coordinate.select("node", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long") + (1 << 31)).alias("key")).repartition("key")
    held = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = postings.join(held, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"), F.sum("n").alias("weight"))
    first = lists.where(F.size("keys") >= matches).select("node", "weight", F.slice("keys", 1, F.size("keys") - matches + 1).alias("keys"))
    return first.select("node", "weight", F.explode("keys.key").alias("key"))


def agreement(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(f"{a}.sig", f"{b}.sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def within(a: str, b: str) -> Column:
    """The sketches allow a similarity of 0.75: |A ^ B| <= |A| + |B| - 2 * ceil(3 / 7 * (|A| + |B|))."""
    apart = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col(f"{a}.n") + F.col(f"{b}.n")
    return apart <= both - 2 * F.ceil(both * 3 / 7)


def hub_pairs(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): each set with the most alike of the central sets in some of its lists; one pair for each set at most.

    A first guess that joins most groups through their centre, so that later only pairs between different groups count.
    """
    few = postings.groupBy("node", "weight").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("key").alias("h"), "key"))), 1, HUBS).alias("k")).select("node", "weight", F.explode("k.key").alias("key"))
    central = Window.partitionBy("key").orderBy(F.col("weight").desc(), "node")
    hubs = few.withColumn("r", F.row_number().over(central)).where(F.col("r") <= HUBS).select("key", F.col("node").alias("hub"))
    pairs = few.join(hubs, "key").where("node != hub").select("node", "hub").distinct()
    a = sets.select(F.col("node"), F.struct("n", "sig", "bits").alias("x"))
    b = sets.select(F.col("node").alias("hub"), F.struct("n", "sig", "bits").alias("y"))
    known = pairs.join(a, "node").join(b, "hub").withColumn("m", agreement("x", "y")).where((F.col("m") >= MATCHES) & within("x", "y"))
    return known.groupBy("node").agg(F.max(F.struct("m", "hub")).alias("best")).select(F.least("node", "best.hub").alias("a"), F.greatest("node", "best.hub").alias("b")).distinct()


def cross_pairs(postings: DataFrame, sets: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): every pair of sets in one list but different groups that may be alike.

    Lists whose sets all belong to one group are done. Longer lists are cut into blocks of about BLOCK sets and compared
    block by block, so no task holds a list; a pair that meets in several lists is counted in the first alone. Only pairs
    that agree in MATCHES coordinates and whose sketches allow the similarity come out. With `most`, a block gives no more
    than so many pairs of the same two groups, the most alike ones: one confirmed pair joins the groups, and what is
    left is looked at again without `most`.
    """
    grouped = postings.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lists = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high")
    parts = lists.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    mask = postings.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).alias("mask"))
    member = grouped.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select("node", "key", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    rows = member.join(mask, "node").join(sets.select("node", "n", "sig", "bits"), "node")
    rows = rows.select("key", "i", "j", "part", "node", "root", "n", "mask", "sig", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            new = {name: batch.column(name).to_numpy() for name in ("key", "i", "j", "part", "node", "root", "n", "mask")}
            new["sig"] = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
            new["bits"] = batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            held = {k: np.concatenate((held[k], v)) for k, v in new.items()} if held else new
            change = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["i"][1:] != held["i"][:-1]) | (held["j"][1:] != held["j"][:-1])) + 1
            starts = [0, *change.tolist()]
            for start, end in zip(starts, starts[1:]):
                yield from found({k: v[start:end] for k, v in held.items()})
            held = {k: v[starts[-1]:] for k, v in held.items()}
        if held:
            yield from found(held)

    def found(g: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = (g["mask"].view(np.uint64)[:, None] >> np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1) == 1
        here, two = int(g["key"][0]) >> 32, g["i"][0] != g["j"][0]
        out = []
        for a in range(len(g["node"]) - 1):
            b = np.flatnonzero((g["root"][a + 1:] != g["root"][a]) & ((g["part"][a + 1:] != g["part"][a]) if two else True)) + a + 1
            if not len(b):
                continue
            same = g["sig"][b] == g["sig"][a]
            m = same.sum(1)
            apart = np.bitwise_count(g["bits"][b] ^ g["bits"][a]).sum(1)
            both = g["n"][b] + g["n"][a]
            ok = (m >= MATCHES) & (apart <= both - 2 * -(-both * 3 // 7)) & ((same & own[b] & own[a]).argmax(1) == here)
            out.append(np.stack([np.full(ok.sum(), a), b[ok], m[ok]]))
        if not out or not sum(x.shape[1] for x in out):
            return
        a, b, m = np.concatenate(out, axis=1)
        if most:
            low, high = np.minimum(g["root"][a], g["root"][b]), np.maximum(g["root"][a], g["root"][b])
            order = np.lexsort((-m, high, low))
            start = np.flatnonzero(np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            a, b = a[order[rank < most]], b[order[rank < most]]
        pair = np.sort(np.stack([g["node"][a], g["node"][b]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have 100 * |A & B| >= 75 * |A | B|; texts: (node, text)."""
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, own = Shingles(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, tx, ty in zip(a, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last:
                    last, own = x, shingles.of(tx)
                other = shingles.of(ty)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= 75 * (len(own) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # Stored texts look small where they are alike; they are never sent to the driver to be broadcast.
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("tx")).hint("merge")
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("ty")).hint("merge")
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "tx", "ty").mapInArrow(checked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id of the group), kept.

    Equal sets are one node from the start, named by their smallest id. Sets with similarity 0.75 or more are linked, each
    link confirmed on whole sets; groups are what links reach. Null and empty texts, and texts of white space, have no
    set and no links. Rows of one id are judged each by its own text. A null id counts only where its group has no other
    (component_id is null then); a null id is kept only in that case. Other columns are not read.

    Pairs inside a group are not all looked at: central sets first join most groups, then only pairs between different
    groups that meet in some list are compared, first the most alike of two groups, then all that are left.
    """
    rows, named = grouped(docs)
    smallest = named.groupBy("root").agg(F.min("one.doc_id").alias("component"))
    by_set = named.join(smallest, "root").select("set_key", "component")
    out = rows.select("doc_id", "n", "set_key").join(by_set, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles of the rows, and (set_key, one, root) of each set: root names its group, one its first row.

    The first row has the smallest doc_id, and no id only if all rows of the set have none; rows that are still equal go
    by their text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(profiles(docs), "profiles")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = rows.where("set_key is not null").groupBy("set_key").agg(F.min(one).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    sets = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
    postings = saved(prefix_postings(sets), "postings")
    listed = postings.select("node").distinct().join(sets.select("node", "one"), "node")
    texts = saved(texts_of(docs, listed), "texts")

    links = saved(confirmed(hub_pairs(postings, sets), texts), "links")
    roots = components(links)
    for most in (FIRST_PAIRS, None):
        cross = saved(cross_pairs(postings, sets, roots, most), "cross")
        if cross.isEmpty():
            break
        links = links.union(saved(confirmed(cross, texts), "links"))
        roots = components(links)
    return rows, sets.join(roots, "node", "left").select("set_key", "one", F.coalesce("root", "node").alias("root"))


def texts_of(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(node, text) of the listed sets (node, one): id and text name one text, so a row fetches for one set at most."""
    one = listed.select("node", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
    mine = docs.select("doc_id", "text", text_key("text").alias("text_key"))
    return mine.join(one, mine["doc_id"].eqNullSafe(one["id"]) & (mine["text_key"] == one["key"])).select("node", "text").dropDuplicates(["node"])


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each group, with their columns; repeated rows stay once.

    A group keeps the row with its smallest doc_id, and one without an id only if no row of it has an id; several such
    rows with other texts are decided by the text. Rows without words are in no group and all stay.
    """
    rows, named = grouped(docs)
    first = named.groupBy("root").agg(F.min("one").alias("one")).select("one.doc_id", "one.text_key")
    kept = first.union(rows.where("set_key is null").select("doc_id", "text_key")).distinct().toDF("_id", "_key")
    keyed = docs.withColumn("_text", text_key("text"))
    named = keyed.join(kept, keyed["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (keyed["_text"] == kept["_key"]), "left_semi")
    # Whole rows are shuffled once more only if some row repeats; that is looked up on ids and keys alone.
    repeated = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = named if repeated.isEmpty() else named.dropDuplicates(["doc_id", "_text"])
    return named.select(*[f"`{c}`" for c in docs.columns])
