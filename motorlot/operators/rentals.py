"""Batch forms of the rental procedures: reservations, starts, settlements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from motorlot.functions.money import money, ratio
from motorlot.operators.changes import assign_keys
from motorlot.operators.ordered import ordered_scan
from motorlot.operators.overlap import with_blocked
from motorlot.operators.pricing import apply_loyalty, apply_promo, check_promos, price
from motorlot.session import written

# Fuel price per point, flat damage fee, late-fee factor.
FUEL_POINT, DAMAGE_FEE, LATE_FACTOR = 3, 250, "1.5"


def check_available(requests: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Add ``vehicle_status`` and ``start_check``: a rental starts only on an available vehicle."""
    states = vehicles.select("vehicle_id", F.col("status").alias("vehicle_status"))
    return requests.join(states, "vehicle_id", "left").withColumn(
        "start_check",
        F.when(F.col("vehicle_status").isNull(), "UNKNOWN_VEHICLE")
        .when(F.col("vehicle_status") != "AVAILABLE", "NOT_AVAILABLE").otherwise("OK"),
    )


def day_slots(bookings: DataFrame, *columns: str) -> DataFrame:
    """One row per booked vehicle day, from the pickup day up to the day before the return."""
    return bookings.where(F.col("pickup_date") < F.col("dropoff_date")).select(
        "vehicle_id", *columns, F.explode(F.sequence("pickup_date", F.date_sub("dropoff_date", 1))).alias("day")
    )


def grant_in_order(requests: DataFrame, order: str) -> DataFrame:
    """Requests that would be accepted one after another in ``order`` (unique), none overlapping another.

    Two requests overlap when they share a vehicle day. In every round the open request that is
    first on all of its days is granted, because nothing before it can still take them; open
    requests on granted days fall out. The result equals the sequential one, and a busy vehicle is
    spread over its days.
    """
    lengths = written(requests.select(order, F.datediff("dropoff_date", "pickup_date").alias("_days")))
    open_slots = written(day_slots(requests, order))
    granted = None
    while True:
        first = open_slots.groupBy("vehicle_id", "day").agg(F.min(order).alias(order))
        leads = first.groupBy(order).agg(F.count(F.lit(1)).alias("_led"))
        won = written(leads.join(lengths, order).where(F.col("_led") == F.col("_days")).select(order))
        if won.isEmpty():
            break
        granted = won if granted is None else granted.unionByName(won)
        taken = open_slots.join(won, order, "left_semi").select("vehicle_id", "day")
        losers = open_slots.join(taken, ["vehicle_id", "day"], "left_semi").select(order).distinct()
        open_slots = written(open_slots.join(losers, order, "left_anti"))
    if granted is None:
        return requests.limit(0)
    return requests.join(granted, order, "left_semi").select(*requests.columns)


# An island of requests with at most this many of them is decided in one row.
FOLD_ROWS = 500


def with_islands(rows: DataFrame) -> DataFrame:
    """Add ``island`` to booked spans (vehicle_id, s, e): spans of different islands of a vehicle cannot overlap.

    A vehicle has one row for each day on which some span starts, whatever the number of its bookings.
    """
    starts = rows.groupBy("vehicle_id", "s").agg(F.max("e").alias("_until"))
    line = Window.partitionBy("vehicle_id").orderBy("s")
    before = F.max("_until").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opens = starts.withColumn("_opens", F.coalesce((before <= F.col("s")).cast("int"), F.lit(1)))
    numbered = opens.select("vehicle_id", "s", F.sum("_opens").over(line).alias("island"))
    return rows.join(numbered, ["vehicle_id", "s"])


def contenders(requests: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """(order, vehicle_id, s, e, island, n) of the proper requests on a vehicle; n requests share an island.

    A request that overlaps an existing booking has island -1: it clashes for certain and holds no day, so islands are
    made of the others alone. Nothing here hangs on who may be accepted, so it is worked out once for all passes.
    """
    proper = (F.col("pickup_date") < F.col("dropoff_date")) & F.col("vehicle_id").isNotNull()
    asked = requests.where(proper).select(F.col(order).alias("o"), "vehicle_id", "pickup_date", "dropoff_date")
    held = existing.select("vehicle_id", F.col("pickup_date").alias("_s"), F.col("dropoff_date").alias("_e"))
    marked = written(with_blocked(asked, held, "vehicle_id", "pickup_date", "dropoff_date", "_s", "_e").select(
        "o", "vehicle_id", F.col("pickup_date").alias("s"), F.col("dropoff_date").alias("e"), "blocked"))
    free = with_islands(marked.where("not blocked").drop("blocked"))
    sizes = free.groupBy("vehicle_id", "island").agg(F.count(F.lit(1)).alias("n"))
    blocked = marked.where("blocked").select("o", "vehicle_id", "s", "e", F.lit(-1).cast("long").alias("island"), F.lit(1).cast("long").alias("n"))
    return written(free.join(sizes, ["vehicle_id", "island"]).select("o", "vehicle_id", "s", "e", "island", "n").unionByName(blocked))


def decided(lines: DataFrame, fold_rows: int) -> DataFrame:
    """(o, clash) of contenders with ``able``: whether a request overlaps an existing booking or an earlier accepted one.

    A request alone on its island is free. Other islands are folded in order; those with too many requests for one row
    are decided by ``grant_in_order``.
    """
    alone = lines.where("n = 1").select("o", (F.col("island") < 0).alias("clash"))
    few = _folded(lines.where((F.col("n") > 1) & (F.col("n") <= fold_rows)))
    many = lines.where((F.col("n") > 1) & (F.col("n") > fold_rows))
    out = alone.unionByName(few)
    return out if many.isEmpty() else out.unionByName(_by_days(many))


def clash_flags(requests: DataFrame, existing: DataFrame, order: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """(order, clash): whether a request overlaps an existing booking or an earlier accepted request.

    ``able`` tells whether a request would be accepted but for a clash. A request without a vehicle clashes with nothing;
    one with empty dates has no row.
    """
    able = requests.select(F.col(order).alias("o"), "able")
    flags = decided(written(contenders(requests, existing, order).join(able, "o")), fold_rows)
    nowhere = requests.where((F.col("pickup_date") < F.col("dropoff_date")) & F.col("vehicle_id").isNull()).select(order, F.lit(False).alias("clash"))
    return flags.withColumnRenamed("o", order).unionByName(nowhere)


def _folded(lines: DataFrame) -> DataFrame:
    """Islands in order; only the spans accepted so far are carried and searched."""
    lined = lines.groupBy("vehicle_id", "island").agg(F.array_sort(F.collect_list(F.struct("o", "s", "e", "able"))).alias("line"))
    span = "struct<s:{0},e:{0}>".format(lines.schema["s"].dataType.simpleString())
    order = lines.schema["o"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<{span}>").alias("taken"), F.array().cast(f"array<{order}>").alias("hit"))

    def step(done, x):
        hit = F.exists(done["taken"], lambda h: (h["s"] < x["e"]) & (h["e"] > x["s"]))
        return F.struct(
            F.when(x["able"] & ~hit, F.array_append(done["taken"], F.struct(x["s"].alias("s"), x["e"].alias("e")))).otherwise(done["taken"]).alias("taken"),
            F.when(hit, F.array_append(done["hit"], x["o"])).otherwise(done["hit"]).alias("hit"),
        )

    hits = lined.select("line", F.aggregate("line", start, step, lambda done: done["hit"]).alias("hits"))
    return hits.select(F.explode(F.transform("line", lambda x: F.struct(x["o"].alias("o"), F.array_contains("hits", x["o"]).alias("clash")))).alias("d")).select("d.*")


def _by_days(lines: DataFrame) -> DataFrame:
    """The same for islands of any size, by vehicle days."""
    asked = written(lines.select("o", "vehicle_id", F.col("s").alias("pickup_date"), F.col("e").alias("dropoff_date"), "able"))
    granted = grant_in_order(asked.where("able").select("o", "vehicle_id", "pickup_date", "dropoff_date"), "o")
    holders = day_slots(granted, "o").withColumnRenamed("o", "_holder")
    clashing = day_slots(asked, "o").join(holders, ["vehicle_id", "day"]).where(F.col("_holder") < F.col("o")).select("o").distinct().withColumn("_hit", F.lit(True))
    return asked.join(clashing, "o", "left").select("o", F.coalesce("_hit", F.lit(False)).alias("clash"))


# Promotions with at most this many uses left are counted off by a window that every task cuts short.
FEW_USES = 10_000


def _run_out(accepted: DataFrame, order: str):
    """The first accepted request that takes the last use of its promotion, if more ask for it; else None.

    ``_left`` is the number of uses left before the batch. Uses are numbered up to the largest of them, so a task hands on
    no more rows of a promotion than that; beyond FEW_USES an ordered scan numbers them.
    """
    full = written(accepted.groupBy("promo_code", "_left").agg(F.count(F.lit(1)).alias("n")).where("n > _left").select("promo_code", F.col("_left").alias("_most")))
    most = full.agg(F.max("_most")).first()[0]
    if most is None:
        return None
    rows = accepted.join(full.select("promo_code"), "promo_code", "left_semi").select("promo_code", "_left", order)
    if most <= FEW_USES:
        line = Window.partitionBy("promo_code").orderBy(order)
        numbered = rows.withColumn("row_num", F.row_number().over(line)).where(F.col("row_num") <= F.lit(most))
    else:
        numbered = ordered_scan(rows, [order], [order], ["promo_code"], ranks=False)
    return numbered.where(F.col("row_num") == F.col("_left")).orderBy(order).select("promo_code", order).first()


def decide_reservations(requests: DataFrame, existing: DataFrame, customers: DataFrame, rates: DataFrame,
                        promos: DataFrame, as_of: datetime, order: str, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Accept or refuse each request, in ``order``.

    Checks in turn: dates, clash with a booking or with a request accepted earlier in the order,
    customer, promotion. A request that fails a later check blocks nobody. Every accepted request
    uses its promotion once, and a promotion at its limit is refused from there on: the batch is
    decided, the earliest request at which some promotion runs out is exact and fixed, and the
    islands of requests that this refuses are decided again, once for each promotion that runs out.
    """
    people = customers.select("customer_id", F.col("is_active").alias("_active"))
    checked = check_promos(requests, promos, as_of).join(people, "customer_id", "left").withColumns({
        "_dates_ok": F.col("dropoff_date") > F.col("pickup_date"),
        "_customer_ok": F.coalesce(F.col("_active") == "Y", F.lit(False)),
    })
    checked = written(checked)
    left = promos.where(F.col("max_uses").isNotNull()).select("promo_code", (F.col("max_uses") - F.col("current_uses")).alias("_left"))
    able = F.col("_dates_ok") & F.col("_customer_ok") & (F.col("promo_check") == "OK")
    asking = checked.select(F.col(order).alias("o"), F.coalesce("promo_code", F.lit("")).alias("code"), able.alias("able"))
    lines = written(contenders(checked, existing, order).join(asking, "o"))
    flags = written(decided(lines, fold_rows))
    ends: dict[str, object] = {}
    while True:
        accepted = lines.where("able").join(flags.where("not clash"), "o").select(F.col("o").alias(order), F.col("code").alias("promo_code"))
        nowhere = checked.where(F.col("vehicle_id").isNull()).where(able).select(order, "promo_code")
        accepted = accepted.unionByName(nowhere).join(left, "promo_code").where(~F.col("promo_code").isin(list(ends)))
        ran_out = _run_out(accepted, order)
        if ran_out is None:
            break
        code, last = ran_out["promo_code"], ran_out[order]
        ends[code] = last
        # Only islands with a request that this promotion now refuses can change.
        refused = (F.col("code") == code) & (F.col("o") > F.lit(last))
        lines = written(lines.withColumn("changed", F.col("able") & refused).withColumn("able", F.col("able") & ~refused))
        changed = lines.where("changed").select("vehicle_id", "island").where("island >= 0").distinct()
        again = lines.where("island >= 0 and n > 1").join(changed, ["vehicle_id", "island"], "left_semi").drop("changed")
        again = written(decided(again, fold_rows))
        lines = lines.drop("changed")
        flags = written(flags.join(again, "o", "left_anti").unionByName(again))
    over = F.lit(False)
    for code, last in ends.items():
        over = over | ((F.col("promo_code") == code) & (F.col(order) > F.lit(last)))
    checked = checked.withColumn("promo_check", F.when(F.coalesce(over, F.lit(False)) & (F.col("promo_check") == "OK"), "PROMO_LIMIT_REACHED").otherwise(F.col("promo_check")))
    flags = flags.withColumnRenamed("o", order)
    reason = (
        F.when(~F.col("_dates_ok"), "INVALID_DATES").when(F.col("clash"), "VEHICLE_UNAVAILABLE")
        .when(~F.col("_customer_ok"), "CUSTOMER_NOT_FOUND").when(F.col("promo_check") != "OK", F.col("promo_check"))
    )
    told = checked.join(flags, order, "left").withColumn("reason", reason)
    priced = apply_promo(price(told, rates, "pickup_date", "dropoff_date"), promos, as_of)
    return apply_loyalty(priced, customers, "left").select(
        order, "customer_id", "vehicle_id", "pickup_date", "dropoff_date", "promo_code",
        F.when(F.col("reason").isNull(), "CONFIRMED").otherwise("REFUSED").alias("decision"), "reason",
        F.when(F.col("reason").isNull(), F.col("cost")).alias("estimated_cost"),
    )


def begin_rentals(reservations: DataFrame, requests: DataFrame, vehicles: DataFrame, as_of: datetime, next_id: int,
                  order: Sequence[str] = ("reservation_id", "odometer_out", "employee_out"),
                  **scan) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Start rentals: (new rentals, reservations afterwards, vehicles afterwards, refused requests).

    Requests are taken in ``order``. A reservation must be confirmed and starts once; a vehicle must be available and
    takes one rental, the first. Refused requests have a reason: NOT_CONFIRMED (unknown, not confirmed or begun by an
    earlier request) or NOT_AVAILABLE. The first request of a reservation and of a vehicle is a minimum that is taken
    before the shuffle.
    """
    confirmed = F.col("status") == "CONFIRMED"
    place = F.struct(*order)
    numbered = requests.withColumn("_place", place)
    open_ = numbered.join(reservations.where(confirmed), "reservation_id").join(
        vehicles.select("vehicle_id", F.col("status").alias("_state")), "vehicle_id", "left")
    free = open_.where(F.col("_state") == "AVAILABLE")
    # Requests of one reservation share its vehicle, so the first of the vehicle settles both.
    first = free.groupBy("vehicle_id").agg(F.min("_place").alias("_first"))
    copies = first.join(free, "vehicle_id").where(F.col("_first") == F.col("_place")).drop("_first", "_place", "_state")
    started = written(copies.dropDuplicates(list(order)))
    keyed = assign_keys(started, ["reservation_id"], "rental_id", next_id, **scan)
    rentals = keyed.select(
        "rental_id", "reservation_id", "customer_id", "vehicle_id", "pickup_location", "dropoff_location",
        F.lit(str(as_of)).cast("timestamp_ntz").alias("actual_pickup"), "odometer_out", "employee_out",
        F.lit("ACTIVE").alias("status"),
    )
    marks = started.select("reservation_id", F.lit(True).alias("_begun"))
    after = reservations.join(marks, "reservation_id", "left").withColumn(
        "status", F.when(F.col("_begun"), "COMPLETED").otherwise(F.col("status"))
    ).drop("_begun")
    rented = started.select("vehicle_id", F.lit(True).alias("_rented"))
    fleet = vehicles.join(rented, "vehicle_id", "left").withColumn(
        "status", F.when(F.col("_rented"), "RENTED").otherwise(F.col("status"))
    ).select(*vehicles.columns)
    known = reservations.select("reservation_id", confirmed.alias("_confirmed"))
    winners = started.select("reservation_id", F.struct(*order).alias("_won"))
    judged = numbered.join(known, "reservation_id", "left").join(winners, "reservation_id", "left")
    # Copies of the request that won are told apart by their number.
    judged = judged.groupBy(*requests.columns, "_place", "_confirmed", "_won").agg(F.count(F.lit(1)).alias("_n"))
    wins = F.coalesce(F.col("_won") == F.col("_place"), F.lit(False))
    lost = judged.withColumn("_n", F.col("_n") - wins.cast("long")).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    reason = F.when(F.coalesce(F.col("_confirmed"), F.lit(False)) & F.col("_won").isNull(), "NOT_AVAILABLE").otherwise("NOT_CONFIRMED")
    return rentals, after, fleet, lost.withColumn("reason", reason).select(*requests.columns, "reason")


def fuel_charge(out: Column, back: Column) -> Column:
    return F.when(back < out, (out - back) * FUEL_POINT).otherwise(0)


def damage_charge(notes: Column) -> Column:
    return F.when(F.length(notes) > 0, DAMAGE_FEE).otherwise(0)


def late_fee(reserved: Column, day: Column, daily_rate: Column) -> Column:
    days = F.greatest(F.lit(0), F.datediff(day, reserved))
    return F.when(reserved.isNull(), 0).otherwise(days * daily_rate * F.lit(LATE_FACTOR).cast("decimal(2,1)"))


def settle(returns: DataFrame, rates: DataFrame, promos: DataFrame, as_of: datetime) -> DataFrame:
    """Charges of returned rentals.

    ``returns`` holds the open rental, its reservation's ``reserved_dropoff`` and ``promo_code`` (null
    without one) and what was read at return. Late days cost the vehicle's own daily rate. Returns of
    rentals that are not open are left to ``refused_returns``.
    """
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    day = F.to_date(now)
    opened = returns.where(F.col("status") == "ACTIVE")
    priced = apply_promo(price(opened, rates, "pickup_date", day), promos, as_of)
    late = ratio(late_fee(F.col("reserved_dropoff"), day, F.col("daily_rate")) * 10, F.lit(10))
    charged = priced.withColumns({
        "base_charge": F.col("price"),
        "fuel_charge": money(fuel_charge(F.col("fuel_level_out"), F.col("fuel_level_in"))),
        "damage_charge": money(damage_charge(F.col("damage_notes"))),
        "late_fee": late,
        "actual_dropoff": now,
        "status": F.lit("COMPLETED"),
    })
    total = F.coalesce("base_charge", F.lit(0)) + F.col("fuel_charge") + F.col("damage_charge") + F.col("late_fee")
    return charged.withColumn("total_charge", total.cast("decimal(18,2)"))


def refused_returns(returns: DataFrame) -> DataFrame:
    """Returns that settle nothing, because their rental is not open."""
    return returns.where(~F.coalesce(F.col("status") == "ACTIVE", F.lit(False))).withColumn("reason", F.lit("NO_ACTIVE_RENTAL"))
