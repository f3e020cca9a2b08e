"""Shuffled shards by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.llm.store import saved

BUCKET_BYTES = 16 << 20
# Rows equal in key and text beyond this number are numbered, so that they scatter too.
MOST_EQUAL = 1000


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text, none for null, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def row_size(docs: DataFrame) -> Column:
    """About how many bytes a row holds, over all of its columns."""
    size = F.lit(8)
    for name, kind in docs.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            size = size + 8 + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("c")))), F.lit(0))
        else:
            size = size + 8
    return size.cast("long")


def numbered(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """docs plus `_copy`: 0, or a number of their own for rows whose key and text stand in more than `most` rows.

    Such rows are counted by their columns in each task before they are shuffled, and laid out again with their numbers.
    """
    name = F.xxhash64(F.col(key), F.col(text), F.col(key).isNull(), F.col(text).isNull())
    many = docs.select(name.alias("_name")).groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_name")
    many = saved(many, "repeated")
    if many.isEmpty():
        return docs.withColumn("_copy", F.lit(0).cast("long"))
    named, columns = docs.withColumn("_name", name), [f"`{c}`" for c in docs.columns]
    rest = named.join(many, "_name", "left_anti").select(*columns, F.lit(0).cast("long").alias("_copy"))
    counted = named.join(many, "_name", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return rest.unionByName(counted.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")))


def scatter(key: str, text: str, buckets: int, seed: int) -> Column:
    """Bucket of a row: a seeded hash of its key, text and copy number, so copies of any kind spread evenly."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.crc32(F.col(text).cast("binary")), F.col("_copy")), F.lit(buckets)).cast("long")


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = BUCKET_BYTES,
             key: str = "doc_id", text: str = "text", most_equal: int = MOST_EQUAL) -> DataFrame:
    """All rows of docs in random order, dealt to shards: every column plus `shard` (int) and `slot` (long, gapless from 0).

    Law `rows`: shard sizes differ by one row at most. A first pass sums the bytes, which sets how many buckets of about
    `bucket_bytes` there are; rows are scattered over them by a seeded hash, each bucket is put in a defined order and
    then in random order (`shuffle` of an array is Fisher-Yates), and the place of a row over all buckets gives shard and
    slot. Only the row counts of the buckets meet in one place: one number for each `bucket_bytes` of input.

    Null keys and null texts are scattered like others; empty input gives an empty result. Up to `most_equal` rows of equal
    key and text share a bucket; more of them are numbered and spread over all buckets, as equal texts under different keys
    do. Bucket sizes count all columns. The random order hangs on the seed and on the number of tasks, which follows
    `spark.sql.shuffle.partitions` and the size of the input; a task that runs again draws the same. Columns of docs
    named `shard` or `slot` give way to the new ones.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(row_size(docs))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    tasks = min(buckets, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * bucket_bytes))))
    names = docs.columns
    copies = numbered(docs, key, text, most_equal)
    placed = copies.select(scatter(key, text, buckets, seed).alias("_bucket"), F.xxhash64(F.lit(seed + 1), F.col(key), F.crc32(F.col(text).cast("binary")), F.col("_copy")).alias("_order"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"))
    counts = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # The order within a task is fixed before the random draw, so a task that runs again draws the same.
    gathered = (
        placed.repartition(tasks, "_bucket").groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_order", "_row"))).alias("_rows"))
        .sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    )
    dealt = gathered.join(starts, "_bucket").select("_start", F.posexplode("_rows").alias("_pos", "_item"))
    rank = F.col("_start") + F.col("_pos")
    return dealt.select("_item._row.*", (rank % shards).cast("int").alias("shard"), F.expr(f"(_start + _pos) div {shards}").alias("slot"))


def write_shards(dealt: DataFrame, folder: str) -> None:
    """One folder for each shard, its rows in slot order; a task writes whole ranges of slots, so files stay bounded."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def digest(dealt: DataFrame) -> DataFrame:
    """The result columns of the sharding query."""
    return dealt.select(
        "doc_id", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
