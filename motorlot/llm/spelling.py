"""Spelling variants: a relational trie is walked level by level by states of all words that may still be one edit away."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from motorlot.llm.store import ascii_lower, saved

MIN_CHARS, MIN_COUNT = 7, 2
RATIO = 10
TYPO = 31
LONG = 32
DOUBLINGS = 5
RUN = r"([A-Za-zÀ-ÿ]+)"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only), one in TYPO of a document's runs without one letter.

    Which runs lose a letter, and which, follows from the crc32 of key:run. Words are counted in each task before they are
    shuffled, so a word that stands everywhere costs one row a task.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.where(F.length("run") >= min_chars).withColumn("h", F.crc32(F.concat_ws(":", "k", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % TYPO == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def node(prefix: Column) -> Column:
    """Name of the trie node at the end of a prefix; `way` says in which of the two tries."""
    return F.xxhash64("way", prefix)


def ending(tail: str) -> Column:
    """One of 64 bits for what is left of a word (an SQL expression)."""
    return F.expr(f"shiftleft(1L, cast(xxhash64({tail}) & 63 as int))")


def two_ways(words: DataFrame) -> DataFrame:
    """(word, m, way, spelt, start): each word forward and backward. The two starts add up to m, so every neighbour that
    is no shorter shares the first `start` letters with one of the two."""
    forward = words.select("word", F.length("word").alias("m"), F.lit(0).alias("way"), F.col("word").alias("spelt"), F.ceil(F.length("word") / 2).cast("int").alias("start"))
    backward = words.select("word", F.length("word").alias("m"), F.lit(1).alias("way"), F.reverse("word").alias("spelt"), F.floor(F.length("word") / 2).cast("int").alias("start"))
    return forward.union(backward)


def edges(spelt: DataFrame, depth: int) -> DataFrame:
    """(node, c, child, tails) of the edges from `depth` to the next level; tails has a bit for each ending below."""
    rows = spelt.where(F.col("m") > depth).select(
        node(F.substring("spelt", 1, depth)).alias("node"), F.substring("spelt", depth + 1, 1).alias("c"),
        node(F.substring("spelt", 1, depth + 1)).alias("child"), ending(f"substring(spelt, {depth + 2})").alias("bit"),
    )
    return rows.groupBy("node", "c", "child").agg(F.bit_or("bit").alias("tails"))


def frontier(words: DataFrame, min_chars: int = MIN_CHARS, longest: int = LONG) -> DataFrame:
    """(word, near): all pairs of words up to `longest` letters, and one more for near, that are one edit apart, one way round.

    States (word, node, rest, edits) stand at a node of the trie with `rest` letters of the word to go. All states of one
    level meet the edges of that level in one join. A state without an edit starts on the word's own path and takes one: a
    greater letter instead of its next, or a letter put in. A state with an edit goes on only by its own next letter.
    Losing a letter and a smaller letter are the same pairs from the other word. An edge tells by its bits which endings
    lie below, so states that cannot end are not made. States whose rest is empty name their neighbour by their node.
    """
    words = words.where(F.length("word") <= longest + 1)
    spelt = saved(two_ways(words), "spelt")
    deepest = spelt.agg(F.max("m")).first()[0] or 0
    states, ended = None, []
    for depth in range(min_chars // 2, min(deepest, longest + 1) + 1):
        own = spelt.where((F.col("m") <= longest) & (F.col("start") <= depth) & (F.col("m") >= depth))
        fresh = own.select("word", node(F.substring("spelt", 1, depth)).alias("node"), F.expr(f"substring(spelt, {depth + 1})").alias("rest"), F.lit(0).alias("edits"))
        fresh = fresh.union(states) if states is not None else fresh
        fresh = fresh.select("word", "node", "rest", "edits", F.substring("rest", 1, 1).alias("next"), ending("substring(rest, 2)").alias("after"), ending("rest").alias("whole"))
        met = fresh.join(edges(spelt, depth), "node")
        steps = F.when(F.col("edits") == 1, (F.col("c") == F.col("next")) & (F.col("tails").bitwiseAND(F.col("after")) != 0))
        instead = (F.col("edits") == 0) & (F.col("rest") != "") & (F.col("c") > F.col("next")) & (F.col("tails").bitwiseAND(F.col("after")) != 0)
        put_in = (F.col("edits") == 0) & (F.col("c") != F.col("next")) & (F.col("tails").bitwiseAND(F.col("whole")) != 0)
        shorter, same = F.expr("substring(rest, 2)"), F.col("rest")
        rests = F.array_compact(F.array(F.when(steps.otherwise(instead), shorter), F.when(put_in, same)))
        moved = met.where(steps.otherwise(instead | put_in)).select("word", F.col("child").alias("node"), F.explode(rests).alias("rest"), F.lit(1).alias("edits"))
        moved = saved(moved, "states")
        ended.append(moved.where("rest = ''").select("word", "node"))
        states = moved.where("rest != ''")
    if not ended:
        return words.select("word", F.col("word").alias("near")).limit(0)
    found = ended[0]
    for part in ended[1:]:
        found = found.union(part)
    terminal = spelt.select(node(F.col("spelt")).alias("node"), F.col("word").alias("near"))
    return found.join(terminal, "node").select("word", "near")


def long_pairs(words: DataFrame, longest: int = LONG) -> DataFrame:
    """(word, near): candidates among words above `longest` letters, with all their one-letter losses as rolling hashes.

    The trie would need a level for each letter. A word here gives one row for each letter, whatever its length: the sum
    of the letters before it and, moved up by one, of those behind it. Equal sums at one place are a changed letter; the
    sum of a whole word among them is a lost one. At most one state for each letter of the alphabet shares a place.
    """
    step = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(int(step), -1, 1 << 64))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                letters = np.array([ord(c) for c in word], dtype=np.uint64)
                powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(word) - 1, step))), dtype=np.uint64)
                sums = np.concatenate(([np.uint64(0)], np.cumsum(letters * powers, dtype=np.uint64)))
                lost = sums[:-1] + (sums[-1] - sums[1:]) * back
                name = pa.array([hash_of(word)], pa.int64()).take(pa.array(np.zeros(len(word) + 1, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([name, pa.array(np.append(np.arange(len(word)), -1)), pa.array(np.append(lost, sums[-1]).view(np.int64)), pa.array(np.append(np.full(len(word), len(word) - 1), len(word)))], ["id", "place", "sum", "size"])

    words = words.where(F.length("word") >= longest)
    rows = saved(words.mapInArrow(losses, "id long, place long, sum long, size long"), "losses")
    names = saved(words.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([hash_of(w) for w in b.column(0).to_pylist()], pa.int64()), b.column(0)], ["id", "word"]) for b in batches), "id long, word string"), "names")
    lost, whole = rows.where("place >= 0"), rows.where("place < 0").select(F.col("id").alias("other"), "sum", "size")
    changed = lost.select("id", "place", "sum", "size").join(lost.select(F.col("id").alias("other"), "place", "sum", "size"), ["place", "sum", "size"]).where("id < other")
    pairs = changed.select("id", "other").union(lost.join(whole, ["sum", "size"]).select("id", "other")).distinct()
    return pairs.join(names, "id").join(names.select(F.col("id").alias("other"), F.col("word").alias("near")), "other").select("word", "near")


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def neighbours(words: DataFrame, min_chars: int = MIN_CHARS, longest: int = LONG) -> DataFrame:
    """(word, near): every ordered pair of different words exactly one edit apart, each checked on the words themselves."""
    pairs = frontier(words, min_chars, longest).union(long_pairs(words, longest))
    true = pairs.where("word != near").where(F.levenshtein("word", "near", 1) == 1)
    return true.select("word", "near").union(true.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, longest: int = LONG) -> DataFrame:
    """One row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    n_near counts the words one edit away; form is the one of largest n (of equals the smallest in code-point order) if its
    n is at least `ratio` times the word's, else null; root follows forms to the last. Counts grow by `ratio` with each
    step, so a chain has under 20 steps and DOUBLINGS joins of the table of forms with itself reach its end.

    Null texts have no words, a null key counts as an empty one, repeated rows count again; other columns are not read; an
    empty table gives an empty result. Words of any length take part: those above `longest` letters by `long_pairs`.
    """
    words = saved(vocabulary(docs, key, text, min_chars, min_count), "vocabulary")
    near = neighbours(words, min_chars, longest).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    told = saved(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f"),
    ), "forms")
    hops = saved(told.where("f is not null").select("word", F.col("f.form").alias("root")), "hops")
    for _ in range(DOUBLINGS):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = saved(hops.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "hops")
    return told.join(hops, "word", "left").select("word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.form_n").alias("form_n"))


# Check text of the query: crc32 by its table, neighbours by words without one letter, forms followed by recursion.
SQL = r"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
b AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM d WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
                                     lambda c, y: xor(t[(xor(c, y) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS h FROM b, tbl),
s AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
v AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT v.word, w.word FROM v JOIN w ON v.less = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.less = w.word),
q AS (SELECT p.word, near, w.n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS k FROM p JOIN w ON p.near = w.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN q.n >= 10 * w.n THEN near END AS form, CASE WHEN q.n >= 10 * w.n THEN q.n END AS form_n FROM w LEFT JOIN q ON w.word = q.word AND k = 1),
walk AS (SELECT word, word AS spot FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.spot = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, spot AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON f.word = walk.word JOIN f g ON walk.spot = g.word WHERE g.form IS NULL
"""
