"""Geodesy and burn rates as SQL expression texts; they read the same to any ANSI engine."""

from __future__ import annotations

EARTH_RADIUS_M = 6371000.0
# Kilocalories an hour by watts, as polynomials; energy of a gram.
FAT = (-0.0142156, 5.30361, -83.0716)
CARB = (-0.0000007556, 0.0006540519, -0.1720687649, 17.6082662802, -409.747303849)
KCAL_PER_GRAM_FAT, KCAL_PER_GRAM_CARB = 9.3, 4.1


def number(x: float) -> str:
    """A literal that both engines read as a double."""
    return f"{x:.17e}"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres between two points."""
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2e0), 2e0) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2e0), 2e0))"
    return f"(2e0 * {number(EARTH_RADIUS_M)} * atan2(sqrt({a}), sqrt(1e0 - {a})))"


def positive_mod(x: str, m: str) -> str:
    return f"({x} - {m} * floor({x} / {m}))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Initial bearing from 0 up to 360 degrees."""
    y = f"sin(radians({lon2} - {lon1})) * cos(radians({lat2}))"
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1}))"
    return positive_mod(f"degrees(atan2({y}, {x}))", "360e0")


def bearing_difference(a: str, b: str) -> str:
    """The smaller angle between two bearings, 0 to 180."""
    d = positive_mod(f"abs({a} - {b})", "360e0")
    return f"(CASE WHEN {d} > 180e0 THEN 360e0 - {d} ELSE {d} END)"


def compass(distance: str, course: str) -> str:
    """One of four directions by a bearing; unknown below ten metres."""
    return f"(CASE WHEN {distance} < 1e1 THEN 'unknown' WHEN {course} >= 315e0 OR {course} < 45e0 THEN 'north' WHEN {course} < 135e0 THEN 'east' WHEN {course} < 225e0 THEN 'south' ELSE 'west' END)"


def metres_per_degree_lon(lat: str) -> str:
    return f"(111320e0 * cos(radians({lat})))"


def polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    text = number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * ({x}) + ({number(c)}))"
    return text


def fat_rate(watts: str) -> str:
    """Fat burnt, kcal a second, never negative."""
    return f"greatest(0e0, {polynomial(watts, FAT)} / 3600e0)"


def carb_rate(watts: str) -> str:
    return f"greatest(0e0, {polynomial(watts, CARB)} / 3600e0)"


def half_up(x: str) -> str:
    """Rounds to the nearest integer, halves upwards."""
    return f"CAST(floor({x} + 5e-1) AS INT)"


def point_to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance to a segment in a plane."""
    length = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"(CASE WHEN {length} = 0e0 THEN 0e0 ELSE greatest(0e0, least(1e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {length})) END)"
    return f"sqrt(pow({px} - ({ax} + {t} * ({bx} - {ax})), 2e0) + pow({py} - ({ay} + {t} * ({by} - {ay})), 2e0))"


def bin_label(x: str, bins: tuple[tuple[str, float], ...]) -> str:
    """The label of the last bin whose lower bound x reaches."""
    cases = " ".join(f"WHEN {x} >= {number(low)} THEN '{label}'" for label, low in reversed(bins))
    return f"CASE {cases} ELSE '{bins[0][0]}' END"
