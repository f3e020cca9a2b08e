"""Benchmark decontamination: a positional inverted index of training text, met from the rarest term of each phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.llm.store import ascii_lower, saved

WINDOW = 10
BLOCK_WINDOWS = 10_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-case runs of digits, letters and all characters beyond ASCII; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(F.col(text)), NO_WORD), ""), F.array().cast("array<string>"))


def text_key(text: str) -> Column:
    """What names a text: its md5; equal texts are judged once."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def windows_of(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of `size` consecutive words (all words of a shorter item) with the ids of their items."""
    run = benchmark.select(F.col(item).alias("item"), words(text).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = run.select("item", "ws", F.explode(starts).alias("i")).select("item", F.slice("ws", F.col("i"), size).alias("phrase"))
    return each.groupBy("phrase").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))


def chosen_terms(docs: DataFrame, windows: DataFrame, text: str, block: int) -> DataFrame:
    """windows plus `anchor`, the term of the phrase that is rarest in docs, and `offset`, where it stands (0 first)."""
    terms = windows.select(F.explode("phrase").alias("term")).distinct()
    counted = None
    for held in in_blocks(terms, "term", block):
        part = docs.select(F.explode(F.filter(words(text), lambda w: w.isin(held))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    ranked = windows.select("phrase", F.posexplode("phrase").alias("offset", "term"))
    ranked = ranked.join(counted, "term", "left") if counted is not None else ranked.withColumn("n", F.lit(0))
    rarest = ranked.groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset")).alias("r"))
    return windows.join(rarest, "phrase").select("phrase", "items", F.col("r.term").alias("anchor"), F.col("r.offset").alias("offset"))


def in_blocks(terms: DataFrame, column: str, block: int) -> list[list[str]]:
    """The test terms in lists of about `block`; they come from the benchmark, a stated set."""
    parts = -(-terms.count() // block)
    return [[r[0] for r in terms.where(F.pmod(F.xxhash64(column), F.lit(parts)) == k).collect()] for k in range(parts)]


def postings(text: str, anchors: list[str], size: int) -> Column:
    """(n_words, list of postings) of a text: for each place of an anchor term, the term, place, and words around it.

    The words around, up to size - 1 each side, stand in for the lists of the other terms: windows are compared with them.
    The array of words is bound to a lambda variable, so a text is split once.
    """
    def posting(ws: Column, i: Column) -> Column:
        first = F.greatest(i - (size - 1), F.lit(1))
        return F.struct(F.element_at(ws, i).alias("term"), (i - 1).alias("pos"), (i - first).alias("at"), F.slice(ws, first, i + size - first).alias("around"))

    def indexed(ws: Column) -> Column:
        places = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.transform(F.filter(places, lambda i: F.element_at(ws, i).isin(anchors)), lambda i: posting(ws, i)).alias("list"))

    return F.element_at(F.transform(F.array(words(text)), indexed), 1)


def index_and_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text",
                      item: str = "item_id", block: int = BLOCK_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(rows of docs: key, text_key, n_words; matches: text_key, pos, n, items, exact).

    The index is stored as a table: postings of every term that is the rarest of some window. Each posting meets the
    windows of its term; a window matches where all its terms stand within `size` - 1 words of it in any order
    (proximity), and exactly where each stands at its offset. Terms and windows of the benchmark are handled in blocks of
    `block`, one pass over docs each, so what is broadcast has a fixed bound and any number of items works the same way.
    """
    docs = docs.select(F.col(key), F.col(text))
    windows = saved(chosen_terms(docs, windows_of(benchmark, size, item, "text"), text, block), "windows")
    parts = max(1, -(-windows.count() // block))
    rows = found = None
    for k in range(parts):
        own = windows.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == k)
        anchors = [r[0] for r in own.select("anchor").distinct().collect()]
        index = saved(docs.select(key, text_key(text).alias("text_key"), postings(text, anchors, size).alias("p")), "postings")
        rows = rows if rows is not None else index.select(key, "text_key", F.col("p.n_words").alias("n_words"))
        lists = index.select("text_key", F.explode("p.list").alias("x")).select("text_key", "x.*")
        met = lists.join(F.broadcast(own), F.col("term") == F.col("anchor")).where(F.size(F.array_except("phrase", "around")) == 0)
        start = F.col("at") - F.col("offset")
        exact = F.when(start >= 0, F.slice("around", start + 1, F.size("phrase")) == F.col("phrase")).otherwise(F.lit(False))
        part = met.select("text_key", (F.col("pos") - F.col("offset")).alias("pos"), F.size("phrase").alias("n"), "items", exact.alias("exact"))
        found = part if found is None else found.unionByName(part)
    return rows, found


def phrase_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Exact phrase matches: doc_id, pos (first word, from 0), n (words), item_id as text; one row for each place."""
    rows, found = index_and_matches(docs, benchmark, **options)
    places = found.where("exact").select("text_key", "pos", "n", F.explode("items").alias("item_id")).distinct()
    return rows.join(places, "text_key").drop("text_key", "n_words")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Places where all words of a window stand near its rarest word, in any order: doc_id, item_id, exact."""
    rows, found = index_and_matches(docs, benchmark, **options)
    places = found.select("text_key", "exact", F.explode("items").alias("item_id")).groupBy("text_key", "item_id").agg(F.max("exact").alias("exact"))
    return rows.join(places, "text_key").drop("text_key", "n_words")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: the key, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts words inside any exact occurrence of a window, each once. Null and empty texts have no words; items
    without words or of a null id are no items (a null id still hits). Repeated rows of docs repeat in the result,
    repeated items count once. Equal texts are judged once and share the result; Spark splits a large group of copies in
    the last join. Empty tables give empty or clean results; other columns are not read.
    """
    rows, found = index_and_matches(docs, benchmark, **options)
    exact = saved(found.where("exact").select("text_key", "pos", "n", "items").distinct(), "matches")
    hits = exact.select("text_key", "pos", "n").distinct().select("text_key", F.explode(F.expr("sequence(pos, pos + n - 1)")).alias("pos")).distinct()
    n_hit = hits.groupBy("text_key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = exact.select("text_key", F.explode("items").alias("item")).groupBy("text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    per_text = n_hit.join(items, "text_key", "left")
    none = F.array().cast("array<string>")
    out = rows.join(per_text, "text_key", "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        rows.columns[0], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with their columns."""
    _, found = index_and_matches(docs, benchmark, **options)
    hit = saved(found.where("exact").select(F.col("text_key").alias("_key")).distinct(), "hit")
    return docs.withColumn("_text_key", text_key(options.get("text", "text"))).join(hit, F.col("_text_key") == F.col("_key"), "left_anti").select(*[f"`{c}`" for c in docs.columns])


# Check text of the query: every run of words of every text next to every window.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS phrase FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT row_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase FROM (SELECT row_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM w) WHERE i + n - 1 <= len(ws)),
m AS (SELECT row_id, i, p.n, item_id FROM p JOIN w ON p.phrase = w.phrase AND p.n = w.n),
h AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY row_id),
t AS (SELECT row_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM m WHERE item_id IS NOT NULL GROUP BY row_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN t USING (row_id)
"""
