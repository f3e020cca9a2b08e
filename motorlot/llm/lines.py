"""Line dedup: all different lines in a sharded minimal perfect hash with fingerprints and counts that documents probe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from motorlot.llm.store import saved

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 50_000
CHUNK_BYTES = 2 << 20
SLICE_CHUNKS = 10_000
ROOM = 1.5
SHARD_ROW = "shard long, sizes array<long>, bits binary, prints binary, counts binary, keepers binary"
ROW = "chunk long, doc_id long, text string, at array<int>, h array<long>, f array<long>"


def line_keys(text: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of a text (UTF-8), the places of those long enough, and the two hash halves of their keys.

    The key is the line without white space at both ends and with A-Z in lower case; `bytes` methods do just that.
    """
    lines = text.encode("utf-8", "replace").split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip().lower()
        if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode()) >= MIN_CHARS):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
    return lines, np.array(at, dtype=np.int64), halves


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A new 64-bit hash for each level of the perfect hash."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each line on a level, from both halves of its hash."""
    return (mixed(h ^ mixed(f, level), level) % np.uint64(size)).astype(np.int64)


def perfect(h: np.ndarray, f: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes and bits of a minimal perfect hash of distinct lines, and the slot of each.

    On each level a line that has its place to itself sets a bit; the others go on to the next. The rank of the bit is
    the slot of the line.
    """
    sizes, bits = [], [np.zeros(0, dtype=bool)]
    at, rest, level = np.zeros(len(h), dtype=np.int64), np.arange(len(h)), 0
    while len(rest):
        size = -(-int(len(rest) * ROOM + 1) // 64) * 64
        place = places(h[rest], f[rest], level, size)
        alone = np.bincount(place, minlength=size) == 1
        at[rest] = sum(sizes) + place
        sizes.append(size)
        bits.append(alone)
        rest, level = rest[~alone[place]], level + 1
    bits = np.concatenate(bits)
    return sizes, bits, np.cumsum(bits)[at] - 1 if len(h) else at


class Shard:
    """The arrays of one shard: fingerprint, number of documents and keeper by perfect-hash slot."""

    def __init__(self, row: dict):
        self.sizes = row["sizes"]
        self.words = np.frombuffer(row["bits"], dtype=np.uint64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.prints, self.counts, self.keepers = (np.frombuffer(row[name], dtype=kind) for name, kind in (("prints", np.uint64), ("counts", np.int64), ("keepers", np.int64)))

    def slots(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Slot of each line, -1 for lines that are not in the shard."""
        out, rest, base = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            place = base + places(h[rest], f[rest], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            slot = self.rank[place >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[hit]] = slot[hit]
            rest, base = rest[~hit], base + size
        known = out >= 0
        known[known] = self.prints[out[known]] == f[known]
        return np.where(known, out, -1)


def built(pdf: pd.DataFrame) -> pd.DataFrame:
    """The row of one shard: h and f are the hash halves of its lines."""
    h, f = (pdf[name].to_numpy(dtype=np.int64).view(np.uint64) for name in ("h", "f"))
    sizes, bits, slots = perfect(h, f)
    pdf = pdf.iloc[np.argsort(slots)]
    arrays = [pdf[name].to_numpy(dtype=np.int64).tobytes() for name in ("f", "n", "keeper")]
    return pd.DataFrame([[int(pdf["shard"].iloc[0]), sizes, np.packbits(bits, bitorder="little").tobytes(), *arrays]], columns=[p.split()[0] for p in SHARD_ROW.split(", ")])


def split_rows(docs: DataFrame) -> DataFrame:
    """Rows of ROW: each document with the places and hash halves of its lines that are long enough; a chunk is a run of
    rows in one task with about CHUNK_BYTES of text, or one longer text."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, start, held = batch.column(1).to_pylist(), 0, 0
            for i, text in enumerate(texts):
                held += len(text or "")
                if held >= CHUNK_BYTES or i + 1 == len(texts):
                    split = [line_keys(x or "") for x in texts[start:i + 1]]
                    offsets = pa.array(np.concatenate(([0], np.cumsum([len(s[1]) for s in split]))), pa.int32())
                    halves = np.concatenate([s[2] for s in split]).view(np.int64)
                    lists = [np.concatenate([s[1] for s in split]).astype(np.int32), halves[:, 0], halves[:, 1]]
                    n = i + 1 - start
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), batch.column(0).slice(start, n), batch.column(1).slice(start, n), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]],
                                                     [p.split()[0] for p in ROW.split(", ")])
                    start, held, chunk = i + 1, 0, chunk + 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(made, ROW)


def line_counts(rows: DataFrame) -> DataFrame:
    """(h, f, n, keeper) of every different line: its number of documents and the largest of their ids.

    Rows of one id are one document; rows with a null id are one document too, which never keeps.
    """
    pairs = rows.select("doc_id", F.inline(F.array_distinct(F.arrays_zip("h", "f")))).distinct()
    return pairs.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("doc_id"), F.lit(-(1 << 63))).alias("keeper"))


def deduped(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, slice_chunks: int = SLICE_CHUNKS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (before), n_dropped and `kept`, the text that stays.

    A line whose key is long enough and stands in at least min_docs documents goes from all of them but the largest
    doc_id. Null and empty texts are one empty line. Repeated rows are one document and stay alike, a null id never
    keeps a repeated line, and other columns are not read.

    Every different line is in the index, in shards of about shard_keys lines that are built and probed in tasks; no part
    of it comes to the driver. A chunk of documents asks each shard once for each of its different lines, and the count at
    the line's slot decides; only lines that go come back to the chunk. A line that stands everywhere is one question a
    chunk, and beyond slice_chunks chunks the questions to a shard are spread over copies of it.
    """
    rows = saved(split_rows(docs), "lines")
    counts = saved(line_counts(rows), "counts")
    chunks = rows.agg(F.count_distinct("chunk")).first()[0]
    shards, slices = max(1, -(-counts.count() // shard_keys)), max(1, -(-chunks // slice_chunks))
    shard = F.pmod(F.col("h"), F.lit(shards)).cast("long")
    index = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(built, SHARD_ROW)
    index = index.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    asked = rows.select("chunk", F.inline(F.arrays_zip("h", "f"))).distinct().withColumns({"of": shard, "part": F.pmod("chunk", F.lit(slices)).cast("long")})

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return right.select(["chunk", "h", "f"]).append_column("keeper", pa.nulls(len(right), pa.int64())).slice(0, 0)
        table = Shard({name: left[name][0].as_py() for name in ("sizes", "bits", "prints", "counts", "keepers")})
        h, f = (right[name].to_numpy().view(np.uint64) for name in ("h", "f"))
        slot = table.slots(h, f)
        goes = np.flatnonzero((slot >= 0) & (table.counts[slot] >= min_docs))
        return pa.table([right["chunk"].take(goes), right["h"].take(goes), right["f"].take(goes), pa.array(table.keepers[slot[goes]])], names=["chunk", "h", "f", "keeper"])

    hits = index.groupBy("shard", "slice").cogroup(asked.groupBy("of", "part")).applyInArrow(probed, "chunk long, h long, f long, keeper long")
    hits = saved(hits.withColumnRenamed("chunk", "asker"), "hits")
    return rows.groupBy("chunk").cogroup(hits.groupBy("asker")).applyInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a chunk without the lines that go; right holds those lines with their keepers."""
    gone = dict(zip(zip(right["h"].to_pylist(), right["f"].to_pylist()), right["keeper"].to_pylist()))
    counts, dropped, kept = [], [], []
    for doc, text, at, h, f in zip(*(left[name].to_pylist() for name in ("doc_id", "text", "at", "h", "f"))):
        lines = (text or "").split("\n")
        lost = {i for i, key in zip(at, zip(h, f)) if key in gone and (doc is None or gone[key] != doc)}
        counts.append(len(lines))
        dropped.append(len(lost))
        kept.append("\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else text or "")
    return pa.table([left["doc_id"], pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def digest(kept: DataFrame) -> DataFrame:
    """The result columns of the line query."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# Check text of the query: lines by their key, joined back to their documents.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 3),
m AS (SELECT l.*, c.k IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
