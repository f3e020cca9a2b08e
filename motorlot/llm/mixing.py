"""Mixture of sources to target weights: whole repeats and one seeded draw for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.llm.store import NOT_BLANK, saved

MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = "mix"


def word_count(text: str = "text") -> Column:
    """Number of runs without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANK)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size), one for each source -> the same with `target`.

    Sources take the weights in turn, by code point with null last. Targets share the sum of all sizes by weight, none
    above `most` times its source: the excess goes to the others by weight. That is one level L with target
    min(most * size, L * weight); sources in order of size / weight give L from running sums. The rows are one for each
    source. A source of size 0 has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)
    # The level holds from the first source on whose cap lies above its share.
    found = ranked.withColumn("l", level).withColumn("fits", F.col("l") * F.col("w") <= most * F.col("source_size"))
    chosen = found.withColumn("level", F.max(F.when(F.col("fits"), F.col("l"))).over(whole))
    cap = (most * F.col("source_size")).cast("double")
    return chosen.select("source", "source_size", F.coalesce(F.least(cap, F.col("level") * F.col("w")), cap).alias("target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 that depends on the id and the seed alone; rows without an id draw by their text."""
    name = F.coalesce(doc_id.cast("string"), F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), name).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def repeats(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies: floor(rate) copies and one more with the chance of the fraction.

    rate = target / source_size, so copies never exceed `most`. A null source is a source of its own; null and empty
    texts have size 0 and follow their source's rate, or are taken once where all of the source is empty. Rows of one id
    draw alike. Sizes are summed by source before any shuffle, and the table of sources, one row each, is written and
    joined back: knowing its size, Spark broadcasts it below its own limit and otherwise splits the sources with many rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sizes = docs.groupBy("source").agg(F.sum(word_count()).alias("source_size"))
    targets = saved(source_targets(sizes, weights, most).withColumnRenamed("source", "_source"), "targets")
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < rate - whole).cast("long")
    return joined.withColumn("size", word_count()).withColumn("copies", F.least(whole + extra, F.lit(most).cast("long")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture, each as often as it is taken, with the columns of docs."""
    return repeats(docs, **options).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The result columns of the mixing query."""
    return repeats(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# Check text of the query: the targets by repeated resharing of the excess, the draw by the same digest.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
r AS (
    SELECT 0 AS n, source, source_size, w, false AS capped, (sum(source_size) OVER ())::DOUBLE / (sum(w) OVER ()) AS level FROM w
    UNION ALL
    SELECT n + 1, source, source_size, w, capped OR level * w > 3 * source_size,
           ((sum(source_size) OVER ()) - (sum(CASE WHEN capped OR level * w > 3 * source_size THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE
           / nullif(sum(CASE WHEN capped OR level * w > 3 * source_size THEN 0 ELSE w END) OVER (), 0)
    FROM r WHERE n < (SELECT count(*) FROM w)
),
t AS (SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN (3 * source_size)::DOUBLE ELSE least(level * w, (3 * source_size)::DOUBLE) END AS target FROM r WHERE n = (SELECT max(n) FROM r)),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate,
             ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, md5(d.text), '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * least(floor(rate)::BIGINT + (CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END), 3)::BIGINT AS taken FROM p
"""
