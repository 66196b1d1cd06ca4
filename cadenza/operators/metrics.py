"""Ride cleaning and per-ride metrics over (session_id, idx, ts, lat, lon, speed_kmh, power, heart_rate, altitude)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from cadenza.functions import geo
from cadenza.operators.folds import folded, metres

# Bins by lower bound; zones are ratios to the threshold power or the maximal heart rate.
SPEED_BINS = (("0-10 km/h", 0.0), ("10-20 km/h", 10.0), ("20-30 km/h", 20.0), ("30-40 km/h", 30.0), (">40 km/h", 40.0))
POWER_ZONES = (("Zone 1", 0.0), ("Zone 2", 0.55), ("Zone 3", 0.70), ("Zone 4", 0.92), ("Zone 5", 1.05), ("Zone 6", 1.25))
HR_ZONES = (("Zone 1", 0.0), ("Zone 2", 0.60), ("Zone 3", 0.70), ("Zone 4", 0.80), ("Zone 5", 0.90))
FAT_BINS = (("Low (0-50%)", 0.0), ("Medium (50-80%)", 50.0), ("High (>80%)", 80.0))
SPRINT_BINS = (("3-5 s", 3.0), ("6-15 s", 6.0), ("16-30 s", 16.0))
FAT_MAX_WATT = -geo.FAT[1] / (2 * geo.FAT[0])


def _ride() -> WindowSpec:
    return Window.partitionBy("session_id")


def _order() -> WindowSpec:
    return _ride().orderBy("idx")


def _r(x: str, alias: str):
    return F.round(F.expr(x), 6).alias(alias)


def gps_quality_filter(points: DataFrame, max_speed: float = 110, max_power: int = 1500, leap_m: float = 500, leap_s: float = 5, implied: float = 120) -> DataFrame:
    """Points that pass the fixed limits and do not leap from the last kept point: a fold, since that point may be any earlier one."""
    ok = points.where("lat <> 0 and lon <> 0").where((F.coalesce("speed_kmh", F.lit(0.0)) <= max_speed) & (F.coalesce("power", F.lit(0)) <= max_power))
    rows = ok.select("session_id", "idx", F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("s"), "lat", "lon")

    def step(state, row):
        _, s, lat, lon = row
        if state is not None:
            d, dt = metres(state[1], state[2], lat, lon), s - state[0]
            if (d > leap_m and dt < leap_s) or (dt > 0 and d / dt * 3.6 > implied):
                return state, False
        return (s, lat, lon), True

    kept = folded(rows, "session_id", "idx", step, "kept boolean")
    return kept.where("kept").select("session_id", "idx")


def heading_vectors(points: DataFrame) -> DataFrame:
    """Movement from the point before in local metres, and its heading; nulls below half a metre."""
    df = points.select("session_id", "idx", "lat", "lon", F.lag("lat").over(_order()).alias("a"), F.lag("lon").over(_order()).alias("b"))
    df = df.withColumn("dx", F.expr(f"(lon - b) * {geo.metres_per_degree_lon('lat')}")).withColumn("dy", F.expr("(lat - a) * 111320e0"))
    moved = F.expr("sqrt(dx * dx + dy * dy) >= 5e-1")
    return df.select("session_id", "idx", F.round(F.when(moved, F.col("dx")), 6).alias("dx"), F.round(F.when(moved, F.col("dy")), 6).alias("dy"), F.round(F.when(moved, F.expr(geo.positive_mod("degrees(atan2(dx, dy))", "360e0"))), 6).alias("heading"))


def interpolated_power(points: DataFrame) -> DataFrame:
    """Power with gaps filled: linear by index between known values, the nearest known one at either end."""
    known = F.when(F.col("power").isNotNull(), F.struct("idx", "power"))
    down = _ride().orderBy(F.desc("idx"))
    df = points.withColumn("a", F.last(known, True).over(_order())).withColumn("b", F.last(known, True).over(down))
    mid = "cast(a.power + (b.power - a.power) * (cast(idx - a.idx as double) / (b.idx - a.idx)) as int)"
    return df.select("session_id", "idx", F.expr(f"coalesce(power, case when a is null then b.power when b is null then a.power else {mid} end)").cast("int").alias("power"))


def ride_distance(points: DataFrame) -> DataFrame:
    df = points.withColumn("a", F.lag("lat").over(_order())).withColumn("b", F.lag("lon").over(_order()))
    return df.groupBy("session_id").agg(F.round(F.coalesce(F.sum(F.expr(geo.haversine("a", "b", "lat", "lon"))), F.lit(0.0)) / 1000, 6).alias("distance_km"), F.count(F.lit(1)).alias("n_points"))


def _micros(ts: str = "ts"):
    return F.expr(f"unix_micros(cast({ts} as timestamp))")


def ride_duration(points: DataFrame) -> DataFrame:
    """Whole seconds from the first to the last point."""
    return points.withColumn("m", _micros()).groupBy("session_id").agg(F.floor((F.max_by("m", "idx") - F.min_by("m", "idx")) / 1e6).cast("long").alias("total_sec"))


def net_duration(points: DataFrame, events: DataFrame) -> DataFrame:
    """Whole seconds of a ride without its pauses, never negative."""
    df = ride_duration(points).join(pause_duration(events), "session_id", "left")
    return df.select("session_id", "total_sec", F.greatest(F.lit(0), F.col("total_sec") - F.coalesce("pause_sec", F.lit(0))).cast("long").alias("net_sec"))


def pause_duration(events: DataFrame) -> DataFrame:
    """Seconds from each first stop (``stop`` or ``stop_all``) to the next start; a stop without a start does not count."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    back = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    df = events.withColumn("m", _micros()).withColumn("rests", F.col("kind").isin("stop", "stop_all")).withColumn("first", F.col("rests") & ~F.lag("rests", 1, False).over(w))
    df = df.withColumn("next", F.last(F.when(~F.col("rests"), F.col("m")), True).over(back))
    return df.groupBy("session_id").agg(F.coalesce(F.sum(F.when(F.col("first"), F.floor((F.col("next") - F.col("m")) / 1e6))), F.lit(0)).cast("long").alias("pause_sec"))


def has_power(points: DataFrame, least: float = 0.1) -> DataFrame:
    """Whether at least so large a share of a ride's points has power."""
    return points.groupBy("session_id").agg((F.count("power") >= F.lit(least) * F.count(F.lit(1))).alias("has_power"))


def histogram(points: DataFrame, value: str, bins, extra: tuple[str, ...] = ()) -> DataFrame:
    """(session_id, label, cnt) with zero rows for labels that a session lacks; ``value`` is SQL for a label or null."""
    counts = points.withColumn("label", F.expr(value)).where("label is not null").groupBy("session_id", "label").agg(F.count(F.lit(1)).alias("cnt"))
    grid = points.select("session_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in [*extra, *[b[0] for b in bins]]])))
    return grid.join(counts, ["session_id", "label"], "left").select("session_id", "label", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def speed_label() -> str:
    return geo.bin_label("coalesce(speed_kmh, 0e0)", SPEED_BINS)


def power_label(ftp: float) -> str:
    return f"CASE WHEN coalesce(power, 0) = 0 THEN '0 W' ELSE {geo.bin_label(f'power / {geo.number(ftp)}', POWER_ZONES)} END"


def hr_label(max_hr: float) -> str:
    return f"CASE WHEN heart_rate > 0 THEN {geo.bin_label(f'heart_rate / {geo.number(max_hr)}', HR_ZONES)} END"


def speed_histogram(points: DataFrame) -> DataFrame:
    return histogram(points, speed_label(), SPEED_BINS)


def power_zones(points: DataFrame, ftp: float = 150) -> DataFrame:
    return histogram(points, power_label(ftp), POWER_ZONES, ("0 W",))


def hr_zones(points: DataFrame, max_hr: float = 190) -> DataFrame:
    return histogram(points, hr_label(max_hr), HR_ZONES)


def average_power(points: DataFrame) -> DataFrame:
    return points.groupBy("session_id").agg(F.expr(geo.half_up("avg(power)")).alias("avg_power"))


def average_hr(points: DataFrame, coverage: float = 0.1) -> DataFrame:
    """Mean of positive heart rates where at least ``coverage`` of the points have one."""
    good = "count(case when heart_rate > 0 then 1 end)"
    return points.groupBy("session_id").agg(F.expr(f"case when {good} >= {geo.number(coverage)} * count(1) and {good} > 0 then {geo.half_up('avg(case when heart_rate > 0 then heart_rate end)')} end").alias("avg_hr"))


def normalized_power(points: DataFrame) -> DataFrame:
    """Fourth root of the mean fourth power of 30-sample means; the plain mean for short rides."""
    df = points.withColumn("p", F.coalesce(F.col("power"), F.lit(0)).cast("double")).withColumn("r", F.avg("p").over(_order().rowsBetween(-29, 0)))
    return df.groupBy("session_id").agg(F.round(F.expr("case when count(1) > 29 then pow(avg(case when idx >= 29 then pow(r, 4e0) end), 25e-2) else avg(p) end"), 6).alias("normalized_power"))


def effective_power(points: DataFrame, back: int = 20) -> DataFrame:
    """Power with each zero replaced by the median of the last ``back`` positive values before it (0 without any)."""
    df = points.select("session_id", "idx", F.when(F.col("power") > 0, F.col("power")).otherwise(0).alias("p")).withColumn("on", F.col("p") > 0)
    df = df.withColumn("m", F.expr(f"case when on then percentile(p, 0.5) over (partition by session_id, on order by idx rows between {back - 1} preceding and current row) end"))
    before = F.coalesce(F.last("m", True).over(_order()), F.lit(0.0))
    return df.select("session_id", "idx", F.when(F.col("on"), F.col("p").cast("double")).otherwise(before).alias("effective_power"))


def fat_carb_grams(points: DataFrame) -> DataFrame:
    """Grams of fat and carbohydrate burnt at the effective power, one second a point."""
    eff = effective_power(points)
    return eff.groupBy("session_id").agg(_r(f"sum({geo.fat_rate('effective_power')}) / {geo.number(geo.KCAL_PER_GRAM_FAT)}", "fat_g"), _r(f"sum({geo.carb_rate('effective_power')}) / {geo.number(geo.KCAL_PER_GRAM_CARB)}", "carb_g"))


def _fat_share(p: str) -> str:
    return f"({geo.fat_rate(p)} / greatest({geo.fat_rate(geo.number(FAT_MAX_WATT))}, 1e-9))"


def fat_score_text(p: str) -> str:
    top = geo.number(FAT_MAX_WATT)
    weight = f"(CASE WHEN {p} <= {top} THEN 1e0 ELSE greatest({geo.carb_rate(top)}, 1e-9) / greatest({geo.carb_rate(p)}, 1e-9) END)"
    return geo.half_up(f"avg({_fat_share(p)} * {weight}) * 100e0")


def fat_score(points: DataFrame) -> DataFrame:
    """Mean share of the maximal fat burn, discounted above its power, in percent, over positive effective powers."""
    return effective_power(points).where("effective_power > 0").groupBy("session_id").agg(F.expr(fat_score_text("effective_power")).alias("fat_score"))


def fat_label(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {geo.bin_label(f'least(100e0, greatest(0e0, {_fat_share(p)} * 100e0))', FAT_BINS)} END"


def fat_histogram(points: DataFrame) -> DataFrame:
    return histogram(effective_power(points), fat_label("effective_power"), FAT_BINS)


def elevation_gain(points: DataFrame, step_m: float = 3.0) -> DataFrame:
    """Climb counted once it exceeds ``step_m`` above the last low: a fold over the ride in order; null below two altitudes."""
    rows = points.where("altitude is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "altitude"))).alias("p"))
    fold = f"""aggregate(slice(p, 2, size(p)), named_struct('low', p[0].altitude, 'gain', 0D), (acc, x) -> case
      when x.altitude < acc.low then named_struct('low', x.altitude, 'gain', acc.gain)
      when x.altitude - acc.low >= {geo.number(step_m)} then named_struct('low', x.altitude, 'gain', acc.gain + (x.altitude - acc.low)) else acc end, acc -> acc.gain)"""
    return rows.select("session_id", F.when(F.size("p") >= 2, F.round(F.expr(fold), 6)).alias("elevation_gain_m"))


def cardiac_drift(points: DataFrame, ftp: float = 150, bucket: int = 600, least: int = 3600) -> DataFrame:
    """Loss of power per heart beat from a ride's first to its second half, in percent, by buckets of ``bucket`` points."""
    total = points.groupBy("session_id").agg(F.max("elapsed_sec").cast("long").alias("total")).where(F.col("total") >= least).withColumn("n", F.expr(f"total div {bucket}"))
    df = points.where("heart_rate > 0").join(total, "session_id").withColumn("b", F.least(F.floor(F.col("elapsed_sec") / bucket), F.col("n") - 1))
    used = f"coalesce(power, 0) >= {geo.number(ftp * 0.25)}"
    per = df.groupBy("session_id", "n", "b").agg(F.expr(f"avg(case when {used} then power end) / avg(case when {used} then heart_rate end)").alias("ef"), F.expr(f"count(case when {used} then 1 end) / count(1)").alias("share")).where("share >= 5e-1")
    out = per.groupBy("session_id").agg(F.expr("avg(case when b < n div 2 then ef end)").alias("one"), F.expr("avg(case when b >= n div 2 then ef end)").alias("two"))
    return out.where("one > 0 and two is not null").select("session_id", F.round(F.expr("(one - two) / one * 100e0"), 6).alias("drift_percent"))


def quality_percent(points: DataFrame, kept: DataFrame) -> DataFrame:
    """Shares of points kept by the quality filter and of points with power, in percent."""
    k = kept.groupBy("session_id").agg(F.count(F.lit(1)).alias("k"))
    raw = points.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.count("power").alias("p"))
    return raw.join(k, "session_id", "left").select("session_id", F.round(F.expr("coalesce(k, 0) * 100e0 / n"), 6).alias("gps_quality"), F.round(F.expr("p * 100e0 / n"), 6).alias("power_quality"))


def rolling_power(points: DataFrame, window: int = 15) -> DataFrame:
    """Trailing mean of ``window`` samples; 0 before the window is full."""
    mean = F.avg(F.coalesce("power", F.lit(0)).cast("double")).over(_order().rowsBetween(1 - window, 0))
    return points.select("session_id", "idx", F.round(F.when(F.col("idx") < window - 1, 0.0).otherwise(mean), 6).alias("rolling"))


def _islands(rows: DataFrame, gap: int) -> DataFrame:
    """Numbers runs of idx whose steps are at most ``gap``."""
    new = (F.col("idx") - F.lag("idx").over(_order()) > gap) | F.lag("idx").over(_order()).isNull()
    return rows.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(_order()))


def intervals(points: DataFrame, ftp: float = 150, window: int = 15, rest: int = 15, least: int = 120) -> DataFrame:
    """Stretches whose rolling power stays above 95 % of the threshold, with rests of at most ``rest`` samples.

    Each ends window - 1 samples behind its last high mean; it stands if its length times its intensity reaches
    ``least``. Power, work, way and speed of a stretch are differences of running sums, so long stretches cost no more
    than short ones. Its direction is that of its ends; its track has six decimals.
    """
    hot = rolling_power(points, window).where(F.col("rolling") > 0.95 * ftp)
    spans = _islands(hot, rest + 1).groupBy("session_id", "island").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("last"))
    ends = points.groupBy("session_id").agg(F.max("idx").alias("top"))
    spans = spans.join(ends, "session_id").select("session_id", "start_idx", F.least(F.col("last") + window - 1, F.col("top")).alias("end_idx"))
    o = _order()
    step = F.coalesce(F.expr(geo.haversine("a", "b", "lat", "lon")), F.lit(0.0))
    df = points.withColumn("a", F.lag("lat").over(o)).withColumn("b", F.lag("lon").over(o)).withColumn("p", F.coalesce("power", F.lit(0)).cast("long")).withColumn("step", step)
    # Speeds are added up as decimals: differences of running sums of doubles would tip means that lie on half a tenth.
    df = df.withColumn("v", F.expr("cast(coalesce(speed_kmh, 0e0) as decimal(38, 18))")).withColumn("k", F.col("speed_kmh").isNotNull().cast("int"))
    running = df.select("session_id", "idx", "lat", "lon", _micros().alias("m"), "p", "v", "k", "step", *[F.sum(x).over(o).alias(f"s_{x}") for x in ("p", "v", "k", "step")])
    first = running.selectExpr("session_id", "idx as start_idx", "s_p - p as p0", "s_v - v as v0", "s_k - k as k0", "s_step as d0", "m as m0", "lat as start_lat", "lon as start_lon")
    last = running.selectExpr("session_id", "idx as end_idx", "s_p as p1", "s_v as v1", "s_k as k1", "s_step as d1", "m as m1", "lat as end_lat", "lon as end_lon")
    out = spans.join(first, ["session_id", "start_idx"]).join(last, ["session_id", "end_idx"]).withColumn("n", F.expr("end_idx - start_idx + 1")).withColumn("mean", F.expr("cast(p1 - p0 as double) / n"))
    out = out.where(F.col("n") * (F.col("mean") / ftp) >= least).withColumn("avg_power", F.expr(geo.half_up("mean"))).withColumn("duration_sec", F.expr("cast(greatest(floor((m1 - m0) / 1e6), n) as int)"))
    # Quotients of decimals too: that of a double sum may fall beside half a tenth where the mean lies on it.
    out = out.withColumn("distance", F.expr("d1 - d0")).withColumn("total", F.expr("cast(v1 - v0 as decimal(30, 14))")).withColumn("parts", F.expr("cast(k1 - k0 as decimal(10, 0))"))
    tenth = lambda x, n: f"CASE WHEN {n} > 0 THEN cast(round({x} / {n}, 1) as double) ELSE 0e0 END"
    return out.selectExpr("session_id", "start_idx", "end_idx", "duration_sec", "avg_power", f"cast(duration_sec * avg_power / {geo.number(ftp)} as int) AS normalized_sec", "round(distance, 4) AS distance_m", f"{tenth('total', 'parts')} AS speed_kmh",
                          f"{tenth(f'(total * cast({geo.number(ftp)} as decimal(7, 3)))', '(parts * cast(avg_power as decimal(10, 0)))')} AS normalized_kmh", f"{geo.compass('distance', geo.bearing('start_lat', 'start_lon', 'end_lat', 'end_lon'))} AS direction")


def interval_tracks(points: DataFrame, found: DataFrame) -> DataFrame:
    """(session_id, start_idx, idx, lat, lon): the points of each interval, to six decimals; bounded by a range join within the ride."""
    spans = found.select("session_id", "start_idx", "end_idx")
    return points.join(spans, "session_id").where("idx between start_idx and end_idx").select("session_id", "start_idx", "idx", *[F.round(c, 6).alias(c) for c in ("lat", "lon")])


def pauses_between(found: DataFrame) -> DataFrame:
    """(session_id, start_idx, pause_sec): time from the interval before to each one, where there is some (start_sec, duration_sec)."""
    w = Window.partitionBy("session_id").orderBy("start_idx")
    df = found.withColumn("pause_sec", (F.col("start_sec") - F.lag(F.col("start_sec") + F.col("duration_sec")).over(w)).cast("long"))
    return df.where("pause_sec > 0").select("session_id", "start_idx", "pause_sec")


def interval_totals(found: DataFrame) -> DataFrame:
    """(session_id, n, total_sec, avg_power): the summary of a ride's intervals; the mean of their powers is cut off."""
    return found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").cast("long").alias("total_sec"), F.expr("cast(avg(avg_power) as int)").alias("avg_power"))


def sprints(points: DataFrame, ftp: float = 150, factor: float = 1.33) -> DataFrame:
    """Runs above ``factor`` times the threshold with gaps of one sample, of 3 to 30 samples, and their peaks."""
    hot = points.where(F.col("power") > ftp * factor)
    out = _islands(hot, 2).groupBy("session_id", "island").agg(F.min("idx").alias("start_idx"), (F.max("idx") - F.min("idx") + 1).alias("duration"), F.max("power").alias("peak_power"))
    return out.where("duration between 3 and 30").select("session_id", "start_idx", "duration", "peak_power")


def sprint_histogram(points: DataFrame) -> DataFrame:
    label = geo.bin_label("duration", SPRINT_BINS)
    return histogram(sprints(points), label, SPRINT_BINS)


def cumulative(points: DataFrame) -> DataFrame:
    """Running distance in metres (c), seconds (e) and energy in joules (w, power held until the next point), with the row before."""
    d = F.expr(geo.haversine("a", "b", "lat", "lon"))
    df = points.withColumn("a", F.lag("lat").over(_order())).withColumn("b", F.lag("lon").over(_order()))
    df = df.withColumn("step", F.coalesce(d, F.lit(0.0))).withColumn("e", F.col("elapsed_sec"))
    df = df.withColumn("joule", F.coalesce(F.lag(F.coalesce("power", F.lit(0)).cast("double")).over(_order()) * (F.col("e") - F.lag("e").over(_order())), F.lit(0.0)))
    df = df.withColumn("c", F.sum("step").over(_order())).withColumn("w", F.sum("joule").over(_order()))
    return df.select("session_id", "idx", "c", "e", "w", F.lag("c").over(_order()).alias("pc"), F.lag("e").over(_order()).alias("pe"), F.lag("w").over(_order()).alias("pw"))


#: Distances of best splits in metres, and durations of best powers in seconds.
SPLITS_M, DURATIONS_S = (25_000, 50_000, 100_000), (1, 5, 10, 20, 60, 300, 600, 1200, 1800)


def best_splits(points: DataFrame, metres: tuple[float, ...] = SPLITS_M) -> DataFrame:
    """(session_id, metres, best_sec): least time to cover each distance from any sample, interpolated at the end.

    One pass: a descending frame for each distance, all over the same sort, finds each sample's end in linear time.
    Rides shorter than a distance have no row for it.
    """
    df = cumulative(points)
    for i, m in enumerate(metres):
        df = df.withColumn(f"x{i}", F.expr(f"min(struct(c, idx, e, pc, pe)) over (partition by session_id order by c desc range between unbounded preceding and {m:.1f}D preceding)"))
    time = lambda i, m: F.expr(f"min(case when x{i}.c > x{i}.pc then x{i}.pe + ({m:.1f}D + c - x{i}.pc) / (x{i}.c - x{i}.pc) * (x{i}.e - x{i}.pe) else x{i}.e end - e)").alias(f"b{i}")
    per = df.groupBy("session_id").agg(*[time(i, m) for i, m in enumerate(metres)])
    stack = ", ".join(f"{m:.1f}D, b{i}" for i, m in enumerate(metres))
    return per.selectExpr("session_id", f"stack({len(metres)}, {stack}) as (metres, b)").where("b is not null").selectExpr("session_id", "metres", "round(b, 6) as best_sec")


def best_split(points: DataFrame, metres: float) -> DataFrame:
    return best_splits(points, (metres,))


def best_powers(points: DataFrame, seconds: tuple[float, ...] = DURATIONS_S) -> DataFrame:
    """(session_id, seconds, watts): greatest mean power over each duration from any sample, to whole watts; null where all power is 0.

    One pass as for ``best_splits``. Rides shorter than a duration have no row for it.
    """
    df = cumulative(points)
    for i, t in enumerate(seconds):
        df = df.withColumn(f"x{i}", F.expr(f"min(struct(e, idx, w, pe, pw)) over (partition by session_id order by e desc range between unbounded preceding and {t:.1f}D preceding)"))
    mean = lambda i, t: F.expr(f"max((case when x{i}.e > x{i}.pe then x{i}.pw + (x{i}.w - x{i}.pw) * ((e + {t:.1f}D - x{i}.pe) / (x{i}.e - x{i}.pe)) else x{i}.w end - w) / {t:.1f}D)").alias(f"b{i}")
    per = df.groupBy("session_id").agg(*[mean(i, t) for i, t in enumerate(seconds)])
    stack = ", ".join(f"{t:.1f}D, b{i}" for i, t in enumerate(seconds))
    return per.selectExpr("session_id", f"stack({len(seconds)}, {stack}) as (seconds, b)").where("b is not null").selectExpr("session_id", "seconds", f"case when b > 0 then {geo.half_up('round(b, 6)')} end as watts")


def best_power(points: DataFrame, seconds: float) -> DataFrame:
    return best_powers(points, (seconds,))
