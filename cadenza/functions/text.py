"""Formats of numbers, times, places and colours as SQL text that Spark and DuckDB read alike (``div`` apart: see ``duck``)."""

from __future__ import annotations

from cadenza.functions import geo

# Names of point categories, speed classes with their colours, colours of interval lengths, axis steps.
CATEGORY_NAMES = {
    "cafe": "Café", "bakery": "Bakery", "bicycle": "Bicycle", "restaurant": "Restaurant", "fast_food": "Fast food", "friture": "Fast food",
    "fuel": "Fuel station", "drinking_water": "Drinking water", "vending_machine": "Vending machine",
}
WEEKDAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")


def duck(sql: str) -> str:
    return sql.replace(" div ", " // ")


def fixed(x: str, digits: int) -> str:
    """``x`` with so many decimals, halves away from zero by its shortest decimal form."""
    return f"CAST(CAST(CAST({x} AS STRING) AS DECIMAL(30, {digits})) AS STRING)"


def whole(x: str) -> str:
    return f"CAST({x} AS STRING)"


def thousands(n: str) -> str:
    """A whole number from 0 to a billion with commas."""
    low = f"lpad({whole(f'({n}) % 1000')}, 3, '0')"
    middle = f"({n}) div 1000 % 1000"
    return f"(CASE WHEN {n} < 1000 THEN {whole(n)} WHEN {n} < 1000000 THEN {whole(middle)} || ',' || {low} ELSE {whole(f'({n}) div 1000000')} || ',' || lpad({whole(middle)}, 3, '0') || ',' || {low} END)"


def signed(n: str) -> str:
    return f"(CASE WHEN {n} >= 0 THEN '+' ELSE '' END || {whole(n)})"


def signed_fixed(x: str, digits: int) -> str:
    return f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {fixed(x, digits)})"


def duration(sec: str) -> str:
    """The two largest units: 1h 5m, 5m 3s, 3s; 0s for nothing."""
    h, m, s = f"({sec}) div 3600", f"({sec}) % 3600 div 60", f"({sec}) % 60"
    return f"(CASE WHEN {sec} <= 0 THEN '0s' WHEN {h} > 0 THEN {whole(h)} || 'h ' || {whole(m)} || 'm' WHEN {m} > 0 THEN {whole(m)} || 'm ' || {whole(s)} || 's' ELSE {whole(s)} || 's' END)"


def duration_hours(sec: str) -> str:
    h, m = f"({sec}) div 3600", f"({sec}) % 3600 div 60"
    return f"(CASE WHEN {h} > 0 THEN {whole(h)} || 'h ' ELSE '' END || {whole(m)} || 'min')"


def duration_long(sec: str) -> str:
    return f"({whole(f'({sec}) div 3600')} || 'h ' || {whole(f'({sec}) % 3600 div 60')} || 'm ' || {whole(f'({sec}) % 60')} || 's')"


def minutes_seconds(sec: str) -> str:
    return f"({whole(f'({sec}) div 60')} || ':' || lpad({whole(f'({sec}) % 60')}, 2, '0'))"


def climb_per_100km(gain_m: str, km: str) -> str:
    return f"(CASE WHEN {km} > 0e0 THEN {thousands(f'({geo.half_up(f'{gain_m} / {km} * 100e0 / 10e0')} * 10)')} || ' m' END)"


def percent_off(value: str, median: str) -> str:
    return signed(geo.half_up(f"({value} - {median}) / CAST({median} AS DOUBLE) * 100e0"))


def comparison(value: str, median: str, unit: str) -> str:
    """A value, with its difference from a median in units and percent; no difference from a median that is null or 0."""
    shown = f"{geo.half_up(value)}" if unit == "W" else value
    plain = whole(shown) if unit == "W" else fixed(value, 1)
    diff = signed(geo.half_up(f"{value} - {median}")) if unit == "W" else signed_fixed(f"({value} - {median})", 1)
    return f"({plain} || ' {unit}' || CASE WHEN {median} IS NULL OR {median} = 0 THEN '' ELSE ' (' || {diff} || ' | ' || {percent_off(value, median)} || '%)' END)"


def duration_comparison(sec: str, median: str) -> str:
    diff = f"CASE WHEN {sec} >= {median} THEN '+' ELSE '-' END || {duration(f'abs({sec} - {median})')}"
    return f"({duration(sec)} || CASE WHEN {median} IS NULL OR {median} = 0 THEN '' ELSE ' (' || {diff} || ' | ' || {percent_off(sec, median)} || '%)' END)"


def category_name(category: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_NAMES.items())
    return f"(CASE {category} {known} ELSE upper(substring({category}, 1, 1)) || substring({category}, 2) END)"


def _near(metres: str) -> str:
    return f"{whole(f'greatest(10, {geo.half_up(f'{metres} / 10e0')} * 10)')} || ' m'"


def poi_distance(metres: str) -> str:
    """Tens of metres below a kilometre, then kilometres with a decimal comma."""
    return f"(CASE WHEN {metres} < 1000e0 THEN {_near(metres)} ELSE replace({fixed(f'({metres} / 1e3)', 1)}, '.', ',') || ' km' END)"


def track_poi_distance(metres: str) -> str:
    return f"(CASE WHEN {metres} < 1000e0 THEN {_near(metres)} ELSE {whole(geo.half_up(f'{metres} / 1e3'))} || ' km' END)"


def nice_distance(metres: str) -> str:
    """The largest of 1, 2, 5 times a power of ten that is not above ``metres``; 1 at least."""
    power = f"pow(10e0, floor(log10({metres})))"
    return f"(CASE WHEN {metres} <= 1e0 THEN 1e0 ELSE {power} * CASE WHEN {metres} / {power} >= 5e0 THEN 5e0 WHEN {metres} / {power} >= 2e0 THEN 2e0 ELSE 1e0 END END)"


def scale_label(metres: str) -> str:
    return f"(CASE WHEN {metres} < 1000e0 THEN {whole(geo.half_up(metres))} || ' m' ELSE {whole(geo.half_up(f'{metres} / 1e3'))} || ' km' END)"


def class_of(x: str, limits: list[tuple[float, str]], last: str) -> str:
    """The name of the first limit that ``x`` is below."""
    return f"(CASE {' '.join(f'WHEN {x} < {geo.number(a)} THEN {chr(39)}{b}{chr(39)}' for a, b in limits)} ELSE '{last}' END)"


def ramp(x: str, low: int, high: int, colours: list[str]) -> str:
    """A colour #RRGGBB between the two nearest of evenly spaced ones; ``x`` is held between ``low`` and ``high``."""
    n = len(colours) - 1
    at = f"((least({high}, greatest({low}, {x})) - {low}) / {geo.number(high - low)} * {geo.number(n)})"
    step = f"CAST(least({n - 1}, floor({at})) AS INT)"

    def channel(i: int) -> str:
        levels = [int(c[1 + 2 * i:3 + 2 * i], 16) for c in colours]
        start = f"CASE {step} {' '.join(f'WHEN {k} THEN {v}e0' for k, v in enumerate(levels[:-1]))} END"
        rise = f"CASE {step} {' '.join(f'WHEN {k} THEN {b - a}e0' for k, (a, b) in enumerate(zip(levels, levels[1:])))} END"
        return f"lpad(upper(hex(CAST(floor({start} + {rise} * ({at} - {step})) AS BIGINT))), 2, '0')"

    return f"('#' || {channel(0)} || {channel(1)} || {channel(2)})"


def short_file_name(name: str, longest: int = 25) -> str:
    """``name`` if it fits, else without its extension, cut with an ellipsis if need be."""
    bare = rf"regexp_replace({name}, '[.][^.]*$', '')"
    return f"(CASE WHEN length({name}) <= {longest} THEN {name} WHEN length({bare}) <= {longest} THEN {bare} ELSE substring({bare}, 1, {longest - 1}) || '…' END)"


def drift_band(percent: str) -> str:
    return class_of(percent, [(5, "GOOD"), (10, "NORMAL")], "SIGNIFICANT")


def axis_step(low: str, high: str, steps: list[float], most: int) -> str:
    """The first step that gives at most so many ticks, the range rounded outwards; else the last step."""
    def ticks(s: float) -> str:
        q = geo.number(s)
        return f"(greatest(ceil({high} / {q}) - floor({low} / {q}), 1) + 1)"
    return f"(CASE {' '.join(f'WHEN {ticks(s)} <= {most} THEN {geo.number(s)}' for s in steps)} ELSE {geo.number(steps[-1])} END)"


def escape_xml(text: str) -> str:
    for mark, entity in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("''", "apos")):
        text = f"replace({text}, '{mark}', '&{entity};')" if mark != "''" else f"replace({text}, chr(39), '&{entity};')"
    return text


def ride_date(ts: str) -> str:
    """Spark SQL: a date as Mon, 05 Jan 2026."""
    return f"date_format({ts}, 'EEE, dd MMM yyyy')"


def file_base(name: str, day: str) -> str:
    """Spark SQL: a file name from a day (yymmdd) and a route's name, of which other characters than letters, digits, blanks, _ and - become _."""
    safe = f"trim(regexp_replace({name}, '[^A-Za-z0-9 _-]', '_'))"
    return f"({day} || '_' || CASE WHEN {safe} = '' THEN 'route' ELSE {safe} END)"


def ride_summary(km: str, sec: str, watts: str, intervals: str) -> str:
    """Distance, duration, power where there is some, and the number of intervals if there are any."""
    return f"({fixed(km, 1)} || ' km | ' || {duration(sec)} || coalesce(' | ' || {whole(watts)} || ' W', '') || CASE WHEN {intervals} > 0 THEN ' | ' || {whole(intervals)} || ' intervals' ELSE '' END)"


def icon_key(category: str) -> str:
    """The category whose icon is shown."""
    return f"(CASE WHEN {category} = 'friture' THEN 'fast_food' ELSE {category} END)"


def rounded_bounds(low: str, high: str, step: float = 10.0) -> tuple[str, str]:
    """Bounds of an axis, rounded outwards to whole steps."""
    q = geo.number(step)
    return f"(floor({low} / {q}) * {q})", f"(ceil({high} / {q}) * {q})"


#: Steps between whole-number ticks.
TICK_STEPS = (1, 2, 5, 10, 20, 25, 50, 100, 200, 250, 500, 1000)


def tick_step(low: str, high: str, most: int = 4) -> str:
    """The least step that parts a range into at most so many; the largest if none does, 1 for no range."""
    cases = " ".join(f"WHEN ({high} - {low}) / {s}e0 <= {most} THEN {s}" for s in TICK_STEPS)
    return f"(CASE WHEN {high} <= {low} THEN 1 {cases} ELSE {TICK_STEPS[-1]} END)"


def integer_ticks(low: str, high: str, most: int = 4) -> str:
    """Spark SQL: whole multiples of the step within a range, in order; its middle if there is none."""
    step = tick_step(low, high, most)
    first, last = f"cast(ceil({low} / {step}) as bigint)", f"cast(floor(({high} + {step} * 1e-4) / {step}) as bigint)"
    return f"(CASE WHEN {first} <= {last} THEN transform(sequence({first}, greatest({first}, {last})), k -> cast(k * {step} as double)) ELSE array(({low} + {high}) / 2e0) END)"


def count_axis(most: str) -> str:
    """The top of an axis of counts: the next multiple of five, five at least."""
    return f"(CASE WHEN {most} = 0 THEN 5 ELSE ({most} + 4) div 5 * 5 END)"


def cardiac(value: str) -> str:
    return f"({fixed(value, 2)} || ' W/bpm')"


def speed(kmh: str) -> str:
    return f"({fixed(kmh, 1)} || ' km/h')"


def decimal_comma(text: str) -> str:
    return f"try_cast(replace({text}, ',', '.') AS DOUBLE)"


def is_open(hours: str, weekday: int, minute: int) -> str:
    """Spark SQL: whether opening hours hold on ``weekday`` (1 is Monday) at a minute of the day; null if unreadable.

    Rules are separated by semicolons and the last that applies wins; days are lists and ranges that may wrap around the
    week; times may pass midnight.
    """
    names = "array(" + ", ".join(f"'{d}'" for d in WEEKDAYS) + ")"
    times = r"'^(.*?)([0-9]{1,2}):([0-9]{2})\\s*-\\s*([0-9]{1,2}):([0-9]{2})'"

    def part(k: int) -> str:
        return f"regexp_extract(r, {times}, {k})"

    def pos(x: str) -> str:
        return f"array_position({names}, trim({x}))"

    a, b = pos("split(d, '-', 2)[0]"), pos("split(d, '-', 2)[1]")
    spans = f"({a} > 0 AND {b} > 0 AND CASE WHEN {a} <= {b} THEN {weekday} BETWEEN {a} AND {b} ELSE {weekday} >= {a} OR {weekday} <= {b} END)"
    day = f"(trim({part(1)}) = '' OR exists(split({part(1)}, ','), d -> CASE WHEN instr(d, '-') > 0 THEN {spans} ELSE {pos('d')} = {weekday} END))"
    opens, closes = f"(CAST({part(2)} AS INT) * 60 + CAST({part(3)} AS INT))", f"(CAST({part(4)} AS INT) * 60 + CAST({part(5)} AS INT))"
    sane = " AND ".join([f"CAST({part(2)} AS INT) <= 24", f"CAST({part(3)} AS INT) <= 59", f"CAST({part(4)} AS INT) <= 24", f"CAST({part(5)} AS INT) <= 59"])
    within = f"CASE WHEN {closes} > {opens} THEN {minute} >= {opens} AND {minute} < {closes} ELSE {minute} >= {opens} OR {minute} < {closes} END"
    rule = f"CASE WHEN r = 'off' THEN false WHEN r = '24/7' THEN true WHEN NOT r RLIKE {times} THEN CAST(NULL AS BOOLEAN) WHEN ({sane}) AND {day} THEN {within} END"
    return f"try_element_at(filter(transform(transform(split(lower({hours}), ';'), r -> trim(r)), r -> {rule}), v -> v IS NOT NULL), -1)"
