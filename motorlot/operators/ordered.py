"""Running, ranking and neighbour columns over an order, without one task holding a whole group.

A plain window sends each of its groups to a single task. That is right while every group is
known to be small, so group sizes are counted first. If some group is larger than ``task_rows``,
the rows are split into ranges of (group, order, tie): the cuts come from a hash sample of the
keys, each range is windowed alone, and per-range totals carry sums, counts and ties across the
range borders. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from motorlot.session import TASK_ROWS, checkpointed

MAX_RANGES = 8192
FAN = 32
SAMPLE_PER_RANGE = 16
HASH_SPACE = 1 << 40


def _ascending(names: Sequence[str]) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]


def _precedes(keys: Sequence[str], cut: Sequence[str]) -> str:
    """SQL test that a row sorts before ``cut``, ascending with nulls last."""
    result = None
    for key, value in reversed(list(zip(keys, cut))):
        less = f"coalesce({key} < {value}, {key} is not null and {value} is null)"
        result = less if result is None else f"({less} or ({key} <=> {value} and {result}))"
    return result


def range_cuts(df: DataFrame, keys: Sequence[str], rows: int, ranges: int) -> list[tuple]:
    """At most ``ranges - 1`` key tuples that split the rows into ranges of similar size.

    ``keys`` must identify a row, so that one hot leading value can be cut too. The collected
    sample holds about 16 keys per range, whatever the size of the table.
    """
    if rows <= 1 or ranges <= 1:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    drawn = F.pmod(F.xxhash64(*keys), F.lit(HASH_SPACE)) < F.lit(int(share * HASH_SPACE) + 1)
    sample = [tuple(r) for r in df.select(*keys).where(drawn).orderBy(*_ascending(keys)).collect()]
    step = max(1, len(sample) // ranges)
    cuts: list[tuple] = []
    for key in sample[step::step]:
        if not cuts or cuts[-1] != key:
            cuts.append(key)
    return cuts[: ranges - 1]


def _fan(cuts: list[tuple]) -> tuple[list[tuple], list[list[tuple]]]:
    """Up to FAN - 1 evenly spaced pivots and the cuts left between them."""
    if len(cuts) < FAN:
        return cuts, [[] for _ in range(len(cuts) + 1)]
    places = [len(cuts) * i // FAN for i in range(1, FAN)]
    edges = [-1, *places, len(cuts)]
    return [cuts[i] for i in places], [cuts[low + 1:high] for low, high in zip(edges, edges[1:])]


def with_ranges(df: DataFrame, keys: Sequence[str], rows: int, ranges: int) -> DataFrame:
    """Add ``_range``, a number that rises with the key range a row belongs to.

    The range is searched level by level. A level joins the few pivots of the range found so far
    (a broadcast table of at most MAX_RANGES / FAN rows) and finds the row's place among them.
    """
    cuts = range_cuts(df, keys, rows, ranges)
    out = df.withColumn("_range", F.lit(0))
    names = [f"`{k}`" for k in keys]
    open_ranges = {0: cuts}
    while any(open_ranges.values()):
        table, deeper = [], {}
        for number, inside in open_ranges.items():
            pivots, parts = _fan(inside)
            flat = [number]
            for i in range(FAN - 1):
                flat += [i < len(pivots), *(pivots[i] if i < len(pivots) else [None] * len(keys))]
            table.append(tuple(flat))
            deeper.update({number * FAN + i: part for i, part in enumerate(parts)})
        schema = StructType().add("_range", IntegerType())
        for i in range(FAN - 1):
            schema = schema.add(f"_on{i}", BooleanType())
            for j, k in enumerate(keys):
                schema = schema.add(f"_p{i}_{j}", df.schema[k].dataType)
        pivots = df.sparkSession.createDataFrame(table, schema)

        def search(low: int, high: int) -> str:
            if low == high:
                return str(low)
            i = (low + high) // 2
            before = f"not _on{i} or {_precedes(names, [f'_p{i}_{j}' for j in range(len(keys))])}"
            return f"case when {before} then {search(low, i)} else {search(i + 1, high)} end"

        found = out.join(F.broadcast(pivots), "_range")
        place = F.expr(f"_range * {FAN} + {search(0, FAN - 1)}")
        out = found.select(*df.columns, place.alias("_range"))
        open_ranges = deeper
    return out


def group_sizes(df: DataFrame, partition: Sequence[str]) -> tuple[int, int]:
    """(rows in the table, rows of its largest group)."""
    if not partition:
        rows = df.count()
        return rows, rows
    row = (
        df.groupBy(*partition).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("top"))
        .first()
    )
    return row["rows"], row["top"]


def ordered_scan(
    df: DataFrame,
    order: Sequence[str],
    tie: Sequence[str],
    partition: Sequence[str] = (),
    sums: Sequence[str] = (),
    edges: Sequence[str] = (),
    neighbours: Mapping[str, Callable[[Window], Column]] | None = None,
    reach: int = 0,
    ranks: bool = True,
    task_rows: int = TASK_ROWS,
    ranges: int | None = None,
    sizes: tuple[int, int] | None = None,
    costly: bool = False,
) -> DataFrame:
    """Add ordered columns to every row of each ``partition`` group (the whole table if empty).

    Rows are ordered by ``order`` then ``tie``, ascending with nulls last; pass a negated column
    for a descending order. ``tie`` makes the order unique. Added columns:

    * ``row_num`` and ``group_rows``; with ``ranks`` also ``rank_num``, ``dense_num`` and
      ``peers_end`` (row number of the last row with equal ``order`` values)
    * ``run_<c>`` and ``total_<c>`` for each of ``sums``; ``first_<c>`` and ``last_<c>`` for ``edges``
    * one column per ``neighbours`` entry, built over the ordered window; the expressions may look
      up to ``reach`` rows back or forward.

    ``sizes`` hands over a known ``group_sizes`` result. ``costly`` marks an input that is dear to
    compute again; it is checkpointed before a scan by ranges, which reads it three times.
    """
    neighbours = dict(neighbours or {})
    rows, largest = sizes or group_sizes(df, partition)
    kinds = df.agg(*[F.sum(c).alias(c) for c in sums]).schema if sums else ()
    typed = {f"{part}_{f.name}": f.dataType for f in kinds for part in ("run", "total")}

    def same_types(out: DataFrame) -> DataFrame:
        """Sums of both ways have the type of a plain sum."""
        return out.withColumns({name: F.col(name).cast(kind) for name, kind in typed.items()})

    if largest <= task_rows:
        return same_types(_plain(df, order, tie, partition, sums, edges, neighbours, ranks))
    if ranges is None:
        shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(MAX_RANGES, max(shuffle, 2 * rows // max(task_rows, 1) + 1))
    if costly:
        df = checkpointed(df)
    return same_types(_by_range(df, order, tie, partition, sums, edges, neighbours, reach, ranks, rows, ranges))


def _plain(df, order, tie, partition, sums, edges, neighbours, ranks) -> DataFrame:
    group = Window.partitionBy(*partition)
    full = group.orderBy(*_ascending([*order, *tie]))
    peers = group.orderBy(*_ascending(order))
    so_far = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = {
        "row_num": F.row_number().over(full).cast("long"),
        "group_rows": F.count(F.lit(1)).over(group),
    }
    if ranks:
        added["rank_num"] = F.rank().over(peers).cast("long")
        added["dense_num"] = F.dense_rank().over(peers).cast("long")
        added["peers_end"] = F.count(F.lit(1)).over(
            peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
    for c in sums:
        added[f"run_{c}"] = F.sum(c).over(so_far)
        added[f"total_{c}"] = F.sum(c).over(group)
    for c in edges:
        added[f"first_{c}"] = F.first(c).over(whole)
        added[f"last_{c}"] = F.last(c).over(whole)
    for name, build in neighbours.items():
        added[name] = build(full)
    return df.withColumns(added)


def _by_range(df, order, tie, partition, sums, edges, neighbours, reach, ranks, rows, ranges):
    ranged = with_ranges(df, [*partition, *order, *tie], rows, ranges)
    group = []
    if partition:
        # A struct groups and joins null keys like any other value.
        ranged = ranged.withColumn("_group", F.struct(*partition))
        group = ["_group"]
    carry = _range_totals(ranged, order, tie, group, sums, edges, ranks)

    body = ranged.withColumn("_halo", F.lit(False))
    if neighbours and reach:
        body = body.unionByName(_halo_rows(ranged, carry, order, tie, group, reach).withColumn("_halo", F.lit(True)))
    # Without groups the totals hold one row per range, at most MAX_RANGES; otherwise Spark decides.
    side = carry if group else F.broadcast(carry)
    body = body.join(side, ["_range", *group])

    part = Window.partitionBy("_range", *group)
    full = part.orderBy(*_ascending([*order, *tie]))
    so_far = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    borrowed = F.least(F.lit(reach if neighbours else 0), F.col("_before"))
    real = ~F.col("_halo")
    added = {
        "row_num": F.col("_before") + F.row_number().over(full) - borrowed,
        "group_rows": F.col("_group_rows"),
    }
    for c in sums:
        mine = F.sum(F.when(real, F.col(c))).over(so_far)
        # Null only while neither earlier ranges nor this one have shown a value.
        added[f"run_{c}"] = F.when(
            F.col(f"_before_{c}").isNull() & mine.isNull(), F.lit(None)
        ).otherwise(F.coalesce(F.col(f"_before_{c}"), F.lit(0)) + F.coalesce(mine, F.lit(0)))
        added[f"total_{c}"] = F.col(f"_total_{c}")
    for c in edges:
        added[f"first_{c}"] = F.col(f"_first_of_{c}")
        added[f"last_{c}"] = F.col(f"_last_of_{c}")
    for name, build in neighbours.items():
        added[name] = build(full)
    out = body.withColumns(added).where(real)
    if ranks:
        peers = Window.partitionBy("_range", *group, *order)
        steps = part.orderBy(*_ascending(order))
        key = _order_key(order)
        at_head = key.eqNullSafe(F.col("_head"))
        at_tail = key.eqNullSafe(F.col("_tail"))
        out = out.withColumns({
            "rank_num": F.when(at_head, F.col("_head_start")).otherwise(F.min("row_num").over(peers)),
            "peers_end": F.when(at_tail, F.col("_tail_end")).otherwise(F.max("row_num").over(peers)),
            "dense_num": F.col("_keys_before") + F.dense_rank().over(steps) - F.col("_joined").cast("long"),
        })
    names = ["row_num", "group_rows"] + (["rank_num", "dense_num", "peers_end"] if ranks else [])
    names += [f"{kind}_{c}" for c in sums for kind in ("run", "total")]
    names += [f"{kind}_{c}" for c in edges for kind in ("first", "last")]
    return out.select(*df.columns, *names, *neighbours)


def _order_key(order: Sequence[str]) -> Column:
    fields = []
    for i, c in enumerate(order):
        fields += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*fields)


def _range_totals(ranged, order, tie, group, sums, edges, ranks) -> DataFrame:
    """Totals of each (range, group) and what the ranges before and after it hand over."""
    place = F.struct(_order_key(order).alias("o"), *tie)
    totals = []
    for c in sums:
        totals.append(F.sum(c).alias(f"_sum_{c}"))
    for c in edges:
        totals.append(F.min_by(F.struct(c), place).alias(f"_min_{c}"))
        totals.append(F.max_by(F.struct(c), place).alias(f"_max_{c}"))
    if ranks:
        # Equal order values are merged first, so a hot value costs one row per range.
        inner = [F.count(F.lit(1)).alias("_n")] + [F.sum(c).alias(f"_sum_{c}") for c in sums]
        for c in edges:
            inner.append(F.min_by(F.struct(c), F.struct(*tie)).alias(f"_min_{c}"))
            inner.append(F.max_by(F.struct(c), F.struct(*tie)).alias(f"_max_{c}"))
        merged = ranged.withColumn("_key", _order_key(order)).groupBy("_range", *group, "_key").agg(*inner)
        outer = [
            F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_keys"),
            F.min("_key").alias("_head"), F.max("_key").alias("_tail"),
            F.min_by("_n", "_key").alias("_head_n"), F.max_by("_n", "_key").alias("_tail_n"),
        ]
        outer += [F.sum(f"_sum_{c}").alias(f"_sum_{c}") for c in sums]
        for c in edges:
            outer.append(F.min_by(f"_min_{c}", "_key").alias(f"_min_{c}"))
            outer.append(F.max_by(f"_max_{c}", "_key").alias(f"_max_{c}"))
        table = merged.groupBy("_range", *group).agg(*outer)
    else:
        table = ranged.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_rows"), *totals)

    # At most one row per range in each group from here on.
    whole = Window.partitionBy(*group)
    line = whole.orderBy("_range")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    later = line.rowsBetween(1, Window.unboundedFollowing)
    all_rows = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = {
        "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        "_group_rows": F.sum("_rows").over(whole),
        "_pieces": F.count(F.lit(1)).over(whole),
    }
    for c in sums:
        added[f"_before_{c}"] = F.sum(f"_sum_{c}").over(earlier)
        added[f"_total_{c}"] = F.sum(f"_sum_{c}").over(whole)
    for c in edges:
        added[f"_first_of_{c}"] = F.first(f"_min_{c}").over(all_rows)[c]
        added[f"_last_of_{c}"] = F.last(f"_max_{c}").over(all_rows)[c]
    table = table.withColumns(added)
    if ranks:
        table = table.withColumns({
            "_joined": F.coalesce(F.col("_head") == F.lag("_tail").over(line), F.lit(False)),
            "_goes_on": F.coalesce(F.col("_tail") == F.lead("_head").over(line), F.lit(False)),
        })
        single = F.col("_keys") == 1
        table = table.withColumns({
            # First row number of the last value's run, if that run starts in this range ...
            "_tail_start": F.when(~single | ~F.col("_joined"), F.col("_before") + F.col("_rows") - F.col("_tail_n") + 1),
            # ... and last row number of the first value's run, if it stops here.
            "_head_stop": F.when(~single | ~F.col("_goes_on"), F.col("_before") + F.col("_head_n")),
        })
        table = table.withColumns({
            "_head_start": F.when(
                F.col("_joined"), F.last("_tail_start", ignorenulls=True).over(earlier)
            ).otherwise(F.col("_before") + 1),
            "_tail_end": F.when(
                F.col("_goes_on"), F.first("_head_stop", ignorenulls=True).over(later)
            ).otherwise(F.col("_before") + F.col("_rows")),
            "_keys_before": F.coalesce(
                F.sum(F.col("_keys") - F.col("_joined").cast("long")).over(earlier), F.lit(0)
            ),
        })
    return table


def _halo_rows(ranged, carry, order, tie, group, reach) -> DataFrame:
    """Copies of the rows just outside each range border, for expressions that look across it."""
    cut_groups = carry.where(F.col("_pieces") > 1).select("_range", *group, "_before", "_rows")
    # A range borders at most two cut groups, so this side holds two rows per range at most.
    near = ranged.join(F.broadcast(cut_groups), ["_range", *group])
    part = Window.partitionBy("_range", *group)
    forward = part.orderBy(*_ascending([*order, *tie]))
    backward = part.orderBy(*[F.col(c).desc_nulls_first() for c in [*order, *tie]])
    head = near.withColumn("_i", F.row_number().over(forward)).where(F.col("_i") <= reach)
    tail = near.withColumn("_i", F.row_number().over(backward)).where(F.col("_i") <= reach)
    columns = [c for c in ranged.columns if c != "_range"]

    after = tail.withColumn("_at", F.col("_before") + F.col("_rows") - F.col("_i") + 1)
    after = after.withColumn("_start", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + reach))).select(*columns, "_start")
    starts = cut_groups.select("_range", *group, (F.col("_before") + 1).alias("_start"))
    before = head.withColumn("_at", F.col("_before") + F.col("_i"))
    before = before.withColumn("_stop", F.explode(F.sequence(F.col("_at") - reach, F.col("_at") - 1))).select(*columns, "_stop")
    stops = cut_groups.select("_range", *group, (F.col("_before") + F.col("_rows")).alias("_stop"))
    return (
        after.join(F.broadcast(starts), [*group, "_start"]).select(*ranged.columns)
        .unionByName(before.join(F.broadcast(stops), [*group, "_stop"]).select(*ranged.columns))
    )


def ntile(tiles: int) -> Column:
    """Tile number from ``row_num`` and ``group_rows``; the first tiles take the spare rows."""
    size = F.expr(f"group_rows div {tiles}")
    spare = F.col("group_rows") % tiles
    wide = spare * (size + 1)
    place = F.col("row_num") - 1
    return F.when(
        place < wide, F.floor(place / (size + 1)) + 1
    ).otherwise(spare + F.floor((place - wide) / F.nullif(size, F.lit(0))) + 1)


def percent_rank() -> Column:
    return F.when(F.col("group_rows") > 1, (F.col("rank_num") - 1) / (F.col("group_rows") - 1)).otherwise(0.0)


def cume_dist() -> Column:
    return F.col("peers_end") / F.col("group_rows")
