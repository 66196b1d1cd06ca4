"""Geodesy for the DuckDB side only, written apart from the engine's own expressions, so that both do not share a mistake."""

from __future__ import annotations


def hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (a, b) and (c, d), latitude first, by the arcsine form."""
    return f"(12742000e0 * asin(least(1e0, sqrt(power(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians(({d}) - ({b})) / 2), 2)))))"


def course(a: str, b: str, c: str, d: str) -> str:
    """Degrees clockwise from north, 0 up to 360, from (a, b) to (c, d)."""
    return f"fmod(degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b}))))) + 360e0, 360e0)"


def apart(a: str, b: str) -> str:
    """The angle between two courses, 0 to 180."""
    return f"(180e0 - abs(abs(({a}) - ({b})) - 180e0))"


def to_segment(lat: str, lon: str, alat: str, alon: str, blat: str, blon: str) -> str:
    """Metres from a point to a segment, in the plane that touches the globe at the point."""
    k = f"cos(radians({lat}))"
    px, py, qx, qy = f"(({alon}) - ({lon})) * {k}", f"(({alat}) - ({lat}))", f"(({blon}) - ({alon})) * {k}", f"(({blat}) - ({alat}))"
    size = f"({qx} * {qx} + {qy} * {qy})"
    t = f"greatest(0e0, least(1e0, -({px} * {qx} + {py} * {qy}) / nullif({size}, 0e0)))"
    return f"(111320e0 * sqrt(power({px} + coalesce({t}, 0e0) * {qx}, 2) + power({py} + coalesce({t}, 0e0) * {qy}, 2)))"


def rounded(x: str) -> str:
    """To the nearest whole number, halves upwards."""
    return f"CAST(floor({x} + 0.5e0) AS INT)"
