"""Ride and route files: FIT recordings and GPX tracks in and out, content hashes, guards and folder sync.

Files are read whole by ``binaryFile``, one row each, so that a listing of millions of small files spreads over the
executors; each is decoded where it lies. A file that cannot be decoded gives one row with its error and no points.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text
from cadenza.operators import tracks

FIT_EPOCH = 631065600
SEMICIRCLE = 180.0 / 2**31
# Fixed values of the FIT format: struct codes and invalid values by base type, message and field numbers.
BASE_TYPES = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF),
    0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
RECORD, EVENT, TIMER, TIMESTAMP = 20, 21, 0, 253
TIMER_KINDS = {0: "start", 1: "stop", 4: "stop_all"}

POINTS = "path string, kind string, idx long, ts timestamp, lat double, lon double, speed_kmh double, power int, heart_rate int, altitude double, event string, error string"
TRACKS = "path string, name string, idx long, lat double, lon double, altitude double, error string"


def fit_messages(data: bytes) -> Iterator[tuple[int, dict[int, int]]]:
    """(message number, values by field) of a FIT file; invalid values are left out, compressed times are resolved."""
    if len(data) < 12 or data[8:12] != b".FIT":
        raise ValueError("not a FIT file")
    at, end = data[0], data[0] + int.from_bytes(data[4:8], "little")
    if end > len(data):
        raise ValueError("FIT file is cut short")
    layouts: dict[int, tuple[int, str, list[tuple[int, int, int]], int]] = {}
    last = 0
    while at < end:
        head = data[at]
        at += 1
        if not head & 0x80 and head & 0x40:
            order, n = ("<", ">")[data[at + 1]], data[at + 4]
            number = int.from_bytes(data[at + 2:at + 4], "little" if order == "<" else "big")
            fields = [(data[i], data[i + 1], data[i + 2]) for i in range(at + 5, at + 5 + 3 * n, 3)]
            at += 5 + 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(data[at + 2 + 3 * i] for i in range(data[at]))
                at += 1 + 3 * data[at]
            layouts[head & 15] = (number, order, fields, extra)
            continue
        local = head >> 5 & 3 if head & 0x80 else head & 15
        if local not in layouts:
            raise ValueError("FIT data without a definition")
        number, order, fields, extra = layouts[local]
        found = {}
        for field, size, base in fields:
            code, invalid = BASE_TYPES.get(base, (None, None))
            if code and struct.calcsize(code) == size:
                value = struct.unpack_from(order + code, data, at)[0]
                if value != invalid:
                    found[field] = value
            at += size
        at += extra
        if head & 0x80:
            last += (head - last) & 31
            found[TIMESTAMP] = last
        last = found.get(TIMESTAMP, last)
        yield number, found


def _fit_rows(path: str, data: bytes) -> list[tuple]:
    rows, records = [], 0
    for number, v in fit_messages(data):
        ts = pd.Timestamp(v[TIMESTAMP] + FIT_EPOCH, unit="s") if TIMESTAMP in v else None
        if number == RECORD:
            records += 1
            if ts is not None and 0 in v and 1 in v:
                speed, high = v.get(73, v.get(6)), v.get(78, v.get(2))
                rows.append((path, "record", records - 1, ts, v[0] * SEMICIRCLE, v[1] * SEMICIRCLE, None if speed is None else speed / 1000 * 3.6, v.get(7), v.get(3), None if high is None else high / 5 - 500, None, None))
        elif number == EVENT and v.get(0) == TIMER and v.get(1) in TIMER_KINDS and ts is not None:
            rows.append((path, "timer", len(rows), ts, None, None, None, None, None, None, TIMER_KINDS[v[1]], None))
    rows.append((path, "total", records, None, None, None, None, None, None, None, None, None))
    return rows


def _decoded(schema: str, decode):
    """A function for mapInPandas: each file's rows, or one row with its error."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = [c.split()[0] for c in schema.split(", ") if c.split()[1] in ("int", "long")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = decode(path, bytes(content))
                except (ValueError, IndexError, struct.error, ET.ParseError) as e:
                    rows = [(path, *[None] * (len(names) - 2), str(e) or type(e).__name__)]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype(dict.fromkeys(whole, "Int64"))
    return run


def binary_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_fit(files: DataFrame) -> DataFrame:
    """Rows of FIT files (path, content): ``record`` points with a place and a time, ``timer`` events, and per file a ``total`` whose idx counts all records."""
    return files.select("path", "content").mapInPandas(_decoded(POINTS, _fit_rows), POINTS)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not in ``known`` (sha1), each content once: the first path stays."""
    hashed = files.withColumn("sha1", F.sha1("content"))
    first = hashed.groupBy("sha1").agg(F.min("path").alias("path"))
    return hashed.join(first, ["sha1", "path"], "left_semi").join(known.select("sha1"), "sha1", "left_anti")


def enough_points(points: DataFrame, key: str, least: int = 60, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points of rides with at least ``least`` of them, and the keys and counts of the others; ``force`` lets all rides pass."""
    counts = points.groupBy(key).agg(F.count(F.lit(1)).alias("n_points"))
    small = F.lit(False) if force else F.col("n_points") < least
    return points.join(counts.where(~small), key, "left_semi"), counts.where(small)


def checked_graph(tables: dict[str, DataFrame], metadata: DataFrame, version: int = 1) -> dict[str, DataFrame]:
    """The road graph's tables, if its one row of metadata has the right schema_version; otherwise an error that says so."""
    found = [r["schema_version"] for r in metadata.select("schema_version").limit(2).collect()]
    if found != [version]:
        raise ValueError(f"the road graph has schema versions {found}, not [{version}]")
    return tables


def _number(s: str | None) -> float | None:
    try:
        return float(s) if s is not None else None
    except ValueError:
        return None


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _under(root: ET.Element, *path: str) -> list[ET.Element]:
    found = [root]
    for step in path:
        found = [c for e in found for c in e if _tag(c) == step]
    return found


def _gpx_rows(path: str, data: bytes) -> list[tuple]:
    root = ET.fromstring(data)
    pts = []
    for route in (("trk", "trkseg", "trkpt"), ("rte", "rtept")):
        for p in _under(root, *route):
            lat, lon = _number(p.get("lat")), _number(p.get("lon"))
            if lat is not None and lon is not None:
                ele = [h for h in (_number((e.text or "").strip()) for e in _under(p, "ele")) if h is not None]
                pts.append((lat, lon, ele[-1] if ele else None))
        if pts:
            break
    if not pts:
        raise ValueError("no usable point in this GPX document")

    def names(*where: str) -> list[str]:
        return [t for t in ((e.text or "").strip() for e in _under(root, *where, "name")) if t]

    name = next((n for n in (names("trk")[-1:], names("rte")[:1], names("metadata")[:1]) if n), [None])[0]
    return [(path, name, i, *p, None) for i, p in enumerate(pts)]


def read_gpx(files: DataFrame) -> DataFrame:
    """Points of GPX files (path, content): all track segments in order, else the route; points without a readable place drop out."""
    return files.select("path", "content").mapInPandas(_decoded(TRACKS, _gpx_rows), TRACKS)


def gpx_of_edges(edges: DataFrame, time: str) -> DataFrame:
    """(route, gpx): the polylines of roads (route, seq, encoded), decoded and joined in order, as GPX 1.1 documents."""
    lines = edges.select(F.struct("route", "seq").alias("edge"), "encoded")
    keyed = lines.selectExpr("xxhash64(edge) as id", "edge", "encoded")
    points = tracks.decode_polylines(keyed.select("id", "encoded")).join(keyed.select("id", "edge"), "id")
    rows = points.selectExpr("edge.route as route", "concat('route ', edge.route) as _name", "struct(edge.seq as edge, seq) as _at", "lat", "lon")
    return gpx_documents(rows, "route", "_name", "_at", time)


#: A definition of record messages with all fields that are read, and its number of bytes.
_LAYOUT = bytes([0x40, 0, 0]) + struct.pack("<HB", RECORD, 7) + bytes([TIMESTAMP, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85, 6, 2, 0x84, 7, 2, 0x84, 3, 1, 0x02, 2, 2, 0x84])


def fit_checksum(data: bytes) -> int:
    """The 16-bit checksum of FIT files: a cyclic redundancy check of polynomial 0x8005, low bits first."""
    value = 0
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ 0xA001 if value & 1 else value >> 1
    return value


def fit_documents(records: DataFrame, key: str) -> DataFrame:
    """(path, content): each key's records (idx, s, y, x in semicircles, power, heart_rate, v in mm/s, h in fifths of a metre above -500) as a FIT file; one row holds one ride."""
    rows = records.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "s", "y", "x", "v", "power", "heart_rate", "h"))).alias("r")).selectExpr(f"cast({key} as string) as path", "r")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for records_ in batch["r"]:
                body = bytearray(_LAYOUT)
                for r in records_:
                    v, p, hr, h = (default if x is None or x != x else int(x) for x, default in ((r["v"], 0xFFFF), (r["power"], 0xFFFF), (r["heart_rate"], 0xFF), (r["h"], 0xFFFF)))
                    body += b"\0" + struct.pack("<IiiHHBH", int(r["s"]), int(r["y"]), int(r["x"]), v, p, hr, h)
                head = struct.pack("<BBHI4s", 14, 0x10, 100, len(body), b".FIT")
                head += struct.pack("<H", fit_checksum(head))
                out.append(head + bytes(body) + struct.pack("<H", fit_checksum(head + bytes(body))))
            yield pd.DataFrame({"path": batch["path"], "content": out})

    return rows.mapInPandas(run, "path string, content binary")


def gpx_documents(tracks: DataFrame, key: str, name: str, order: str, time: str, creator: str = "cadenza") -> DataFrame:
    """(key, gpx): each track's points (lat, lon, by ``order``) as a GPX 1.1 document. One row holds one track."""
    pts = F.sort_array(F.collect_list(F.struct(order, "lat", "lon")))
    rows = tracks.groupBy(key).agg(F.min(name).alias("_name"), pts.alias("_pts"))
    label = text.escape_xml("coalesce(_name, '')")
    body = "array_join(transform(_pts, p -> concat('      <trkpt lat=\"', p.lat, '\" lon=\"', p.lon, '\"/>\n')), '')"
    head = f"""concat('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata>\n    <name>', {label},
      '</name>\n    <time>{time}</time>\n  </metadata>\n  <trk>\n    <name>', {label}, '</name>\n    <trkseg>\n', {body}, '    </trkseg>\n  </trk>\n</gpx>\n')"""
    return rows.selectExpr(key, f"{head} AS gpx")
