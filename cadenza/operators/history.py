"""Analytics over many rides: records, rollups, distributions, comparisons and regressions."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import geo
from cadenza.plans.lineage import discard, store


def records(sessions: DataFrame) -> DataFrame:
    """(record, session_id, value): longest distance, biggest climb and longest duration; ties go to the smallest id."""
    kinds = (("longest_ride", "distance_km"), ("biggest_climb", "elevation_gain_m"), ("longest_duration", "cast(net_duration_sec as double)"))
    best = lambda x: F.max(F.when(F.expr(x).isNotNull(), F.struct(F.expr(x).alias("v"), (-F.col("session_id")).alias("k"))))
    top = sessions.agg(*[best(x).alias(name) for name, x in kinds])
    stack = ", ".join(f"'{n}', {n}" for n, _ in kinds)
    return top.selectExpr(f"stack({len(kinds)}, {stack}) as (record, s)").where("s is not null").selectExpr("record", "-s.k as session_id", "s.v as value")


def best_per_label(efforts: DataFrame, label: str, value: str, least: bool) -> DataFrame:
    """(label, session_id, value): each label's best value, nulls left out, ties to the smallest session."""
    x = F.struct(F.col(value).alias("v"), F.col("session_id").alias("s")) if least else F.struct(F.col(value).alias("v"), (-F.col("session_id")).alias("s"))
    best = efforts.where(F.col(value).isNotNull()).groupBy(label).agg((F.min if least else F.max)(x).alias("b"))
    return best.select(F.col(label).alias("label"), (F.col("b.s") if least else -F.col("b.s")).alias("session_id"), F.col("b.v").alias("value"))


def yearly_rollup(sessions: DataFrame, now_year: int) -> DataFrame:
    """Rides, distance, duration and climb by year, with zero rows for years without rides up to ``now_year``."""
    df = sessions.withColumn("year", F.year("session_start"))
    years = df.agg(F.min("year").alias("a")).select(F.explode(F.sequence("a", F.greatest("a", F.lit(now_year)))).alias("year"))
    per = df.groupBy("year").agg(F.count(F.lit(1)).alias("rides"), F.sum("distance_km").alias("km"), F.sum("net_duration_sec").alias("sec"), F.sum("elevation_gain_m").alias("climb"))
    out = years.join(per, "year", "left")
    return out.select("year", F.coalesce("rides", F.lit(0)).alias("rides"), F.round(F.coalesce("km", F.lit(0.0)), 6).alias("distance_km"), F.coalesce("sec", F.lit(0)).cast("long").alias("net_duration_sec"), F.round(F.coalesce("climb", F.lit(0.0)), 6).alias("elevation_gain_m"))


def monthly_rollup(sessions: DataFrame, now: str, months: int = 12) -> DataFrame:
    """Rides and distance of the ``months`` months that end with the month of ``now``, zero-filled."""
    last = F.trunc(F.lit(now).cast("date"), "month")
    grid = sessions.sparkSession.range(months).select(F.date_format(F.add_months(last, -F.col("id").cast("int")), "yyyy-MM").alias("month"))
    per = sessions.groupBy(F.date_format("session_start", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rides"), F.sum("distance_km").alias("km"))
    return grid.join(per, "month", "left").select("month", F.coalesce("rides", F.lit(0)).alias("rides"), F.round(F.coalesce("km", F.lit(0.0)), 6).alias("distance_km"))


#: Classes of a ride by its climb in metres per 100 km.
CLIMB_CLASSES = (("flat", 0.0), ("rolling", 200.0), ("hilly", 800.0), ("mountain", 1400.0), ("alpine", 2000.0))


def values_at(rows: DataFrame, column: str, ranks: list[int]) -> list:
    """The values of ``column`` (no nulls) at some places, from 0, of its sorted order, without sorting all rows in one task.

    Equal values are counted first; the counts are dealt by ranges, the driver sums up the ranges (one number each), and
    only the ranges that hold a rank are sorted out.
    """
    counts = store(rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c")).repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = {r["part"]: (r["low"], r["n"]) for r in counts.groupBy("part").agg(F.min("v").alias("low"), F.sum("c").alias("n")).collect()}
    found, before = {}, 0
    for part, (_, n) in sorted(totals.items(), key=lambda x: x[1][0]):
        here = sorted({r for r in ranks if before <= r < before + n})
        if here:
            run = counts.where(F.col("part") == part).withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("v")) + before)
            hit = " or ".join(f"(upto > {r} and upto - c <= {r})" for r in here)
            for row in run.where(hit).select("v", "c", "upto").collect():
                found |= {r: row["v"] for r in here if row["upto"] - row["c"] <= r < row["upto"]}
        before += n
    discard(counts)
    return [found[r] for r in ranks]


def middle_range(rows: DataFrame, column: str, low: float, high: float) -> tuple[float, float]:
    """Percentiles of a float column by linear interpolation in single precision."""
    n, out = rows.count(), []
    places = [q * (n - 1) for q in (low, high)]
    values = iter(values_at(rows, column, [k for x in places for k in (math.floor(x), math.ceil(x))]) if n else [0.0] * 4)
    for x in places if n else (0.0, 0.0):
        a, b = np.float32(next(values)), np.float32(next(values))
        out.append(float(np.float32(a + np.float32(b - a) * np.float32(x - math.floor(x)))))
    return out[0], out[1]


def power_speed_cloud(sessions: DataFrame) -> DataFrame:
    """Rides' power and speed in single precision, without those outside the middle 95 % of either, and their climb class.

    Rides count that have power, climb, time and distance; the class goes by metres of climb per 100 km.
    """
    df = sessions.where("has_power and average_power is not null and elevation_gain_m is not null and net_duration_sec > 0 and distance_km > 0")
    df = df.selectExpr("session_id", "cast(average_power as float) as power", "cast(distance_km / net_duration_sec * 3600e0 as float) as speed", "elevation_gain_m / distance_km * 100e0 as climb")
    df = store(df)
    for c, (low, high) in {c: middle_range(df, c, 0.025, 0.975) for c in ("power", "speed")}.items():
        df = df.where(F.col(c).between(F.lit(low).cast("float"), F.lit(high).cast("float")))
    return df.select("session_id", F.round(F.col("power").cast("double"), 4).alias("power"), F.round(F.col("speed").cast("double"), 4).alias("speed"), F.expr(geo.bin_label("climb", CLIMB_CLASSES)).alias("climb_class"))


def equal_weight_average(hist: DataFrame) -> DataFrame:
    """(label, percent): the mean over sessions of each label's share of its session; labels a session lacks count as 0."""
    total = hist.groupBy("session_id").agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))
    sessions = total.agg(F.count(F.lit(1)).alias("n"))
    per = hist.join(total, "session_id").groupBy("label").agg(F.sum(F.col("cnt") * 100.0 / F.col("total")).alias("s"))
    return per.crossJoin(F.broadcast(sessions)).select("label", F.round(F.col("s") / F.col("n"), 6).alias("percent"))


#: The metrics that rides are compared by, as SQL over a ride; null: the ride has none. Whole ones are cut off.
COMPARED = {
    "duration": "cast(net_duration_sec as double)", "distance": "distance_km", "speed": "CASE WHEN net_duration_sec > 0 THEN distance_km / net_duration_sec * 3600e0 ELSE 0e0 END",
    "power": "CASE WHEN has_power THEN cast(average_power as double) END", "normalized": "CASE WHEN has_power THEN cast(normalized_power as double) END", "fat": "CASE WHEN has_power THEN cast(fat_score as double) END",
    "cardiac": "CASE WHEN has_power AND avg_heart_rate <> 0 THEN average_power / cast(avg_heart_rate as double) END", "kcal": f"cast({geo.half_up('9.3e0 * fat_g + 4.1e0 * carb_g')} as double)",
    "climb": "elevation_gain_m", "climb_rate": "CASE WHEN distance_km > 0 THEN elevation_gain_m / distance_km * 100e0 END",
}
WHOLE = ("duration", "power", "normalized")


def _middle(values: list[float]) -> float | None:
    n = len(values)
    if n < 2:
        return None
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2.0


def previous_comparison(sessions: DataFrame, last: int = 5) -> DataFrame:
    """Medians of ten metrics over a rider's ``last`` earlier rides and over all earlier ones, and the sizes of both pools.

    Earlier means an earlier start: rides that start together do not count for each other. Of those that start together
    before, the larger session_id is the later one. A median needs two values. Rides stream by rider and start; a sorted
    list for each metric grows by one value a ride, so a ride costs a search, not a sort of all rides before it.
    """
    names = list(COMPARED)
    rows = sessions.selectExpr("rider_id", "session_id", "unix_micros(cast(session_start as timestamp)) as at", *[f"{x} as {n}" for n, x in COMPARED.items()])
    fields = [f"{n}_{pool}" for n in names for pool in ("recent", "all")]
    schema = "session_id bigint, n_recent bigint, n_all bigint, " + ", ".join(f"{f} double" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rider, begun, pools, recent, waiting, total = None, False, [], [], [], 0
        for batch in batches:
            out = []
            for who, key, at, *values in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or who != rider:
                    rider, begun, pools, recent, waiting, total = who, True, [[] for _ in names], [], [], 0
                if waiting and waiting[0][0] != at:
                    for _, old in waiting:
                        for pool, v in zip(pools, old):
                            if v is not None:
                                bisect.insort(pool, v)
                        recent = [*recent, old][-last:]
                    total, waiting = total + len(waiting), []
                row = [key, len(recent), total]
                for i, pool in enumerate(pools):
                    row += [_middle(sorted(r[i] for r in recent if r[i] is not None)), _middle(pool)]
                out.append(row)
                waiting.append((at, values))
            names_out = [c.split(" ")[0] for c in schema.split(", ")]
            columns = list(zip(*out)) if out else [()] * len(names_out)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(columns)], names=names_out)

    found = rows.repartition("rider_id").sortWithinPartitions("rider_id", "at", "session_id").mapInArrow(run, schema)
    return found.select("session_id", "n_recent", "n_all", *[(F.col(f).cast("int") if f.rpartition("_")[0] in WHOLE else F.round(f, 6)).alias(f) for f in fields])


def group_averages(sessions: DataFrame, key: str) -> DataFrame:
    """Averages of a group of rides: durations and powers in whole numbers, cut off; speed and climb from the averages, not averaged."""
    per = sessions.groupBy(F.col(key).alias("group_id")).agg(
        F.count(F.lit(1)).alias("rides"), F.expr("sum(net_duration_sec) div count(1)").alias("avg_duration_sec"),
        F.expr("sum(CASE WHEN has_power THEN average_power END) div count(CASE WHEN has_power THEN average_power END)").alias("avg_power"),
        F.expr("sum(CASE WHEN has_power THEN normalized_power END) div count(CASE WHEN has_power THEN normalized_power END)").alias("avg_normalized_power"),
        F.avg("distance_km").alias("km"), F.avg("elevation_gain_m").alias("climb"))
    return per.selectExpr("group_id", "rides", "avg_duration_sec", "avg_power", "avg_normalized_power", "round(km, 6) AS avg_distance_km", "round(CASE WHEN avg_duration_sec > 0 THEN km / avg_duration_sec * 3600e0 ELSE 0e0 END, 6) AS avg_speed_kmh",
                          "round(CASE WHEN km > 0 THEN climb / km * 100e0 END, 6) AS climb_per_100km")


def power_duration_model(sessions: DataFrame, key: str) -> DataFrame:
    """Least squares of duration on power by group: slope, intercept, bounds of a slider in tens of watts, and the median distance of all rides.

    Groups with fewer than two rides with power, or one power only, have no model and no row.
    """
    x, y = "CASE WHEN has_power THEN average_power END", "net_duration_sec"
    both = f"{x} is not null and {y} is not null"
    exact = lambda *f: f"sum(CASE WHEN {both} THEN {' * '.join(f'cast({v} as decimal(19, 0))' for v in f)} END)"
    per = sessions.groupBy(F.col(key).alias("group_id")).agg(
        F.expr(f"count({x})").alias("n"), F.expr(f"cast(count(CASE WHEN {both} THEN 1 END) as decimal(19, 0))").alias("m"),
        *[F.expr(f"cast({exact(*f)} as decimal(38, 0))").alias(name) for name, f in (("sx", (x,)), ("sy", (y,)), ("sxx", (x, x)), ("sxy", (x, y)))],
        F.expr(f"cast(min({x}) as int)").alias("low"), F.expr(f"cast(max({x}) as int)").alias("high"), F.round(F.percentile("distance_km", F.lit(0.5)), 6).alias("median_km"))
    # Whole numbers have exact sums; a quotient that lies on half a digit is then rounded the same way in any order of the rides.
    out = per.withColumn("above", F.expr("cast(m * sxy - sx * sy as decimal(38, 0))")).withColumn("below", F.expr("cast(m * sxx - sx * sx as decimal(38, 0))"))
    out = out.where("n >= 2 and below > 0").withColumn("b", F.expr("cast(above as double) / cast(below as double)")).withColumn("a", F.expr("cast(sy * sxx - sx * sxy as double) / cast(below as double)"))
    return out.selectExpr("group_id", "n", "round(b, 5) AS slope", "round(a, 5) AS intercept", "(low - 10) div 10 * 10 AS slider_min", "CASE WHEN (high + 10) % 10 = 0 THEN high + 10 ELSE ((high + 10) div 10 + 1) * 10 END AS slider_max", "median_km")


def estimated_seconds(models: DataFrame, watts: str) -> DataFrame:
    """(group_id, sec): a model's whole seconds at a power (SQL); null unless positive."""
    return models.selectExpr("group_id", f"CASE WHEN slope * ({watts}) + intercept > 0 THEN cast(slope * ({watts}) + intercept as int) END AS sec")


def histogram_average(hist: DataFrame, groups: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(group_id, label, percent): the mean over a group's sessions of each label's share, for fixed labels; groups: (group_id, session_id)."""
    total = hist.groupBy("session_id").agg(F.greatest(F.sum("cnt"), F.lit(1)).alias("total"))
    shares = hist.join(total, "session_id").selectExpr("session_id", "label", "cnt * 1e2 / total as share")
    sizes = groups.join(total.select("session_id"), "session_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.join(shares, "session_id").groupBy("group_id", "label").agg(F.sum("share").alias("s"))
    grid = sizes.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    return grid.join(sums, ["group_id", "label"], "left").selectExpr("group_id", "label", "round(coalesce(s, 0e0) / n, 6) AS percent")


def kept_names(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """(group_id, old_id, name): each new group takes the first existing one, by creation, whose members are all in it; nulls without one.

    Both have (group_id, members); ``existing`` also name and created_at. Empty existing groups match nothing.
    """
    old = existing.select(F.col("group_id").alias("old_id"), "name", "created_at", F.array_distinct("members").alias("m")).where(F.size("m") > 0)
    old = old.select("old_id", "name", "created_at", F.size("m").alias("n"), F.explode("m").alias("member"))
    new = fresh.select("group_id", F.explode(F.array_distinct("members")).alias("member"))
    full = new.join(old, "member").groupBy("group_id", "old_id").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.first("name").alias("name"), F.first("created_at").alias("created_at")).where("hits = n")
    best = full.groupBy("group_id").agg(F.min(F.struct("created_at", "old_id", "name")).alias("b"))
    return fresh.select("group_id").join(best, "group_id", "left").select("group_id", "b.old_id", "b.name")


def stale_groups(existing: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of existing groups that no new group continues."""
    return existing.select("group_id").join(kept.where("old_id is not null").selectExpr("old_id as group_id").distinct(), "group_id", "left_anti")


def trend(value: str, reference: str, higher_is_better: bool) -> str:
    """SQL: 'up' or 'down' with 'better' or 'worse' against a reference; null where there is none, or no difference."""
    up, down = ("up better", "down worse") if higher_is_better else ("up worse", "down better")
    return f"(CASE WHEN {reference} = 0 OR {value} = {reference} THEN NULL WHEN {value} > {reference} THEN '{up}' WHEN {value} < {reference} THEN '{down}' END)"


def import_summary(results: DataFrame) -> DataFrame:
    """One row, message: counts of imported rides, failures with the first one's message, and rides too short (idx, kind, message)."""
    per = results.agg(F.count_if(F.col("kind") == "success").alias("s"), F.count_if(F.col("kind") == "error").alias("e"), F.count_if(F.col("kind") == "small").alias("t"), F.min(F.when(F.col("kind") == "error", F.struct("idx", "message")))["message"].alias("m"))
    parts = ["CASE WHEN s > 0 THEN concat('Imported ', s, ' new ride', CASE WHEN s = 1 THEN '' ELSE 's' END) END", "CASE WHEN e > 0 THEN concat(e, ' failed: ', m) END", "CASE WHEN t > 0 THEN concat(t, ' skipped (too short)') END"]
    return per.selectExpr(f"concat_ws(', ', {', '.join(parts)}) AS message").selectExpr("CASE WHEN message = '' THEN 'No new rides found' ELSE message END AS message")


def newest(sessions: DataFrame, limit: int) -> DataFrame:
    return sessions.orderBy(F.desc("session_start"), F.desc("session_id")).limit(limit).select("session_id", "session_start", "distance_km")


def middle_member(sessions: DataFrame, key: str, by: str) -> DataFrame:
    """The middle ride of each group in the order of ``by``: place n div 2 from 0."""
    w = Window.partitionBy(key)
    df = sessions.withColumn("r", F.row_number().over(w.orderBy(by, "session_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return df.where("r = n div 2 + 1").select(F.col(key).alias("group_id"), "session_id", F.col(by).alias("value"))


def sorted_groups(groups: DataFrame, order: str) -> DataFrame:
    """All of (group_id, name, distance, frequency) in one of six orders, with its place: distance, frequency or name, ``_asc`` or ``_desc``.

    Names go by their lower case; ties by group_id. The place is found without one task for all rows.
    """
    what, _, way = order.partition("_")
    key = F.lower("name") if what == "name" else F.col(what)
    keys = [key.desc() if way == "desc" else key.asc(), F.col("group_id").asc()]
    return placed(groups, keys)


def placed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with their place, from 1, in the order of ``keys``: ranges are sorted apart, and shifted by the sizes of those before."""
    parts = store(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, shift = 0, []
    for p in sorted(sizes):
        shift.append((p, before))
        before += sizes[p]
    table = rows.sparkSession.createDataFrame(shift, "_part int, _shift long")
    df = parts.join(F.broadcast(table), "_part").withColumn("place", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) + F.col("_shift"))
    return df.drop("_part", "_shift")


def merged_speed_bins(hist: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Counts under new labels; unknown labels are dropped, missing new ones filled with 0."""
    pairs = hist.sparkSession.createDataFrame(list(mapping.items()), "label string, merged string")
    labels = pairs.select("merged").distinct()
    sums = hist.join(F.broadcast(pairs), "label").groupBy("session_id", "merged").agg(F.sum("cnt").alias("c"))
    grid = hist.select("session_id").distinct().crossJoin(F.broadcast(labels))
    return grid.join(sums, ["session_id", "merged"], "left").select("session_id", F.col("merged").alias("label"), F.coalesce("c", F.lit(0)).cast("long").alias("cnt"))


def energy_kcal(grams: DataFrame) -> DataFrame:
    """Whole kilocalories of fat and carbohydrate grams; null if either is."""
    return grams.select("session_id", F.expr(geo.half_up("9.3e0 * fat_g + 4.1e0 * carb_g")).alias("kcal"))


#: Older, finer labels of speeds and the labels that took their place.
SPEED_LABELS = {
    "0-5 km/h": "0-10 km/h", "5-10 km/h": "0-10 km/h", "10-20 km/h": "10-20 km/h", "20-25 km/h": "20-30 km/h", "25-30 km/h": "20-30 km/h",
    "30-35 km/h": "30-40 km/h", "35-40 km/h": "30-40 km/h", ">40 km/h": ">40 km/h",
}


def inserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``stored`` with new rows; a key that is there already, or twice in ``rows``, is an error."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    clash = rows.select(key).join(stored.select(key), key, "left_semi").unionByName(twice).limit(1).collect()
    if clash:
        raise ValueError(f"{key} {clash[0][0]} is there already")
    return stored.unionByName(rows)


def updated(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``changes`` in place of those of the same key; changes of unknown keys do nothing."""
    known = changes.join(stored.select(key), key, "left_semi").select(*stored.columns)
    return stored.join(known.select(key), key, "left_anti").select(*stored.columns).unionByName(known)


def without(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti").select(*stored.columns)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each of ``keys``: the first by ``order`` (an edge that several chunks matched counts for the earliest)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, "_b.*").select(*rows.columns)


def joined_legs(*legs: DataFrame) -> DataFrame:
    """Rows of legs (route, seq, ...) one leg behind the other, numbered anew from 0."""
    both = None
    for i, leg in enumerate(legs):
        part = leg.withColumn("_leg", F.lit(i))
        both = part if both is None else both.unionByName(part)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("route").orderBy("_leg", "seq")) - 1).drop("_leg")


def by_creation(groups: DataFrame) -> DataFrame:
    return groups.orderBy("created_at", "group_id")


def upsert(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``changes`` in place of those of the same key."""
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes)


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")
