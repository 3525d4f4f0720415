"""Planar geometry: point operators as Column expressions, line and polygon operators as Arrow-batched helpers.

A geometry is a struct of gtype (POINT, LINESTRING, POLYGON or one of these with MULTI before it), pts, all its vertices in
order, and starts, the places in pts at which its parts begin (null: one part). A polygon's parts are its closed rings, the
outer one first; of several polygons they are the rings of all. What lies in an odd number of rings is inside.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import overlay

_REAL = T.DoubleType()
_POINTS = T.ArrayType(T.StructType([T.StructField("x", _REAL), T.StructField("y", _REAL)]))
GEOMETRY = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("pts", _POINTS), T.StructField("starts", T.ArrayType(T.IntegerType()))])
#: Half the circumference and the radius of the Web-Mercator sphere. Fixed values.
HALF, RADIUS = 20037508.342789244, 6378137.0


def mercator_x(lon: Column) -> Column:
    return lon * HALF / 180


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan((F.lit(90.0) + lat) * math.pi / 360)) * RADIUS


def longitude(x: Column) -> Column:
    return x * 180 / HALF


def latitude(y: Column) -> Column:
    return F.atan(F.exp(y / RADIUS)) * 360 / math.pi - 90


def shape(gtype: str, pts: Column) -> Column:
    """A geometry of one part."""
    return F.struct(F.lit(gtype).alias("gtype"), pts.alias("pts"), F.lit(None).cast("array<int>").alias("starts"))


def point(x: Column, y: Column) -> Column:
    return shape("POINT", F.array(F.struct(x.alias("x"), y.alias("y"))))


def part_arrays(geometry: Column) -> Column:
    """The vertices of each part."""
    n = F.size(geometry["pts"])
    starts = F.coalesce(geometry["starts"], F.array(F.lit(0)))
    return F.transform(starts, lambda a, i: F.slice(geometry["pts"], a + 1, F.coalesce(F.get(starts, i + 1), n) - a))


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def grid_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size), F.floor(y / size)


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the Web-Mercator tile that holds a point."""
    n = float(2**zoom)
    return F.floor((lon + 180) / 360 * n), F.floor((F.lit(1.0) - mercator_y(lat) / (math.pi * RADIUS)) / 2 * n)


def steps(pts: Column) -> Column:
    """Lengths of a line's segments."""
    return F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts), F.lit(1))), lambda a, b: point_distance(a["x"], a["y"], b["x"], b["y"]))


def length(geometry: Column) -> Column:
    """Length of a line or of several together; 0 for points and polygons."""
    own = lambda pts: F.aggregate(steps(pts), F.lit(0.0), lambda a, b: a + b)
    total = F.aggregate(F.transform(part_arrays(geometry), own), F.lit(0.0), lambda a, b: a + b)
    return F.when(geometry["gtype"].isin("LINESTRING", "MULTILINESTRING"), total).otherwise(0.0)


def ring_area(pts: Column) -> Column:
    """Shoelace area of a closed ring."""
    cross = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts)), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2


def compactness(pts: Column) -> Column:
    """4 pi area / perimeter squared: 1 for a circle, near 0 for a sliver."""
    perimeter = F.aggregate(steps(pts), F.lit(0.0), lambda a, b: a + b)
    return 4 * math.pi * ring_area(pts) / F.nullif(perimeter * perimeter, F.lit(0.0))


def geojson(geometry: Column) -> Column:
    """GeoJSON text of a geometry in degrees. Several polygons are given as one each of their rings, without holes among them."""
    parts = F.transform(part_arrays(geometry), lambda part: F.transform(part, lambda p: F.array(p["x"], p["y"])))
    named = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    kind = geometry["gtype"]
    flat = F.get(parts, 0)
    return (
        F.when(kind == "POINT", named("Point", F.get(flat, 0)))
        .when(kind == "LINESTRING", named("LineString", flat))
        .when(kind == "POLYGON", named("Polygon", parts))
        .when(kind == "MULTIPOINT", named("MultiPoint", F.flatten(parts)))
        .when(kind == "MULTILINESTRING", named("MultiLineString", parts))
        .when(kind == "MULTIPOLYGON", named("MultiPolygon", F.transform(parts, lambda ring: F.array(ring))))
    )


def random_point(key: Column, x: float, y: float, radius: float) -> tuple[Column, Column]:
    """A point of a disc that depends on key alone, so that batch, stream and retry agree."""
    unit = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    r, a = F.sqrt(unit("r")) * radius, unit("a") * (2 * math.pi)
    return x + r * F.cos(a), y + r * F.sin(a)


def _parts(pts, starts) -> list[np.ndarray]:
    whole = np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2)
    return [whole] if starts is None else np.split(whole, list(starts)[1:])


_TYPES = ("POINT", "LINESTRING", "POLYGON")
_WKT = re.compile(r"\s*(?:([A-Za-z]+)|([(),])|([^\s(),]+))")


def _groups(tokens: list[str]) -> list:
    """The nested lists of a bracketed text; a leaf is a list of numbers. Raises ValueError or IndexError."""
    if tokens.pop(0) != "(":
        raise ValueError("no bracket")
    out: list = []
    while True:
        if tokens[0] == "(":
            out.append(_groups(tokens))
        else:
            numbers = []
            while tokens[0] not in ("(", ")", ","):
                numbers.append(float(tokens.pop(0)))
            out.append(numbers)
        if (sign := tokens.pop(0)) == ")":
            return out
        if sign != ",":
            raise ValueError("no comma")


def parse_wkt(text: str | None) -> dict | None:
    """A geometry from well-known text, several and holes included; None for anything that is broken, empty or of another type."""
    try:
        at, tokens = 0, []
        while text[at:].strip():
            m = _WKT.match(text, at)
            tokens.append(m[1] or m[2] or m[3])
            at = m.end()
        kind = tokens.pop(0).upper()
        base = kind.removeprefix("MULTI")
        if base not in _TYPES:
            return None
        body = _groups(tokens)
        if tokens:
            return None
        if base == "POINT":
            parts = [[p[0] if p and isinstance(p[0], list) else p] for p in body]
        elif base == "LINESTRING":
            parts = body if kind != base else [body]
        else:
            parts = body if kind == base else [ring for polygon in body for ring in polygon]
        least = {"POINT": 1, "LINESTRING": 2, "POLYGON": 4}[base]
        for part in parts:
            if len(part) < least or any(len(p) != 2 or not all(map(math.isfinite, p)) for p in part) or (base == "POLYGON" and part[0] != part[-1]):
                return None
        if kind == "POINT" and len(parts) > 1:
            return None
        starts = None if len(parts) == 1 else np.cumsum([0, *map(len, parts[:-1])]).tolist()
        return {"gtype": kind, "pts": [{"x": x, "y": y} for part in parts for x, y in part], "starts": starts}
    except (AttributeError, TypeError, ValueError, IndexError):
        return None


def made_valid(gtype: str, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Without repeated points, with closed rings that do not cross; parts of which too little is left go.

    Rings that cross themselves or one another come back as rings around what lies in an odd number of them.
    """
    out, least = [], {"POINT": 1, "LINESTRING": 2, "POLYGON": 4}[gtype.removeprefix("MULTI")]
    for pts in parts:
        if len(pts):
            pts = pts[np.concatenate([[True], np.any(np.diff(pts, axis=0) != 0, axis=1)])]
        if gtype.endswith("POLYGON") and len(pts) and (pts[0] != pts[-1]).any():
            pts = np.vstack([pts, pts[:1]])
        if len(pts) >= least:
            out.append(pts)
    return overlay.repaired(out) if gtype.endswith("POLYGON") and tangled(out) else out


def tangled(rings: list[np.ndarray]) -> bool:
    """Whether segments of closed rings meet anywhere but at the ends of neighbours."""
    if not rings:
        return False
    a, b = overlay.ends(rings)
    some = lambda pts: len(set(map(tuple, pts.tolist())))
    if sum(some(r[:-1]) for r in rings) != len(a) or some(a) != len(a):
        return True
    return any(len(t) > 2 for t in overlay.cut_places(a, b, a, b, overlay.extent(rings) * overlay.NEAR))


def inside(p: np.ndarray, rings: list[np.ndarray]) -> bool:
    """True for a point strictly inside closed rings."""
    a, b = segments(rings)
    if point_segments(p, a, b)[0].min() < 1e-9:
        return False
    up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return bool(np.count_nonzero(up & (p[0] < at)) % 2)


def pieces(parts: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The middles of the stretches into which other's edges and vertices cut the segments of parts."""
    out = []
    for p, q in zip(*segments(parts), strict=True):
        d = q - p
        n = (d * d).sum()
        cuts = crossings([np.stack([p, q])], other) if n else np.zeros((0, 2))
        t = np.unique(np.clip(np.concatenate([[0, 1], ((cuts - p) * d).sum(1) / n if n else []]), 0, 1))
        out.append(p + ((t[1:] + t[:-1]) / 2)[:, None] * d)
    return np.vstack(out)


def contained(gtype_a: str, a: list[np.ndarray], gtype_b: str, b: list[np.ndarray]) -> bool:
    """Whether the first geometry lies in the second, whose edge it may touch, but not lie on altogether."""
    a, b = made_valid(gtype_a, a), made_valid(gtype_b, b)
    if not a or not b:
        return False
    x, y = segments(b)
    on = lambda p: point_segments(p, x, y)[0].min() < 1e-9
    probes = np.vstack(a) if gtype_a.endswith("POINT") else np.vstack([*a, pieces(a, b)])
    if gtype_b.endswith("POLYGON"):
        deep = [inside(p, b) for p in probes]
        if not all(d or on(p) for d, p in zip(deep, probes, strict=True)):
            return False
        if gtype_a.endswith("POLYGON"):
            # the second one's edges, of holes as well, must not run through the first
            return not any(inside(p, a) for p in pieces(b, a))
        return any(deep)
    if gtype_a.endswith("POLYGON") or not all(map(on, probes)):
        return False
    if gtype_b.endswith("POINT"):
        return gtype_a.endswith("POINT")
    ends = [e for part in b if (part[0] != part[-1]).any() for e in (part[0], part[-1])]
    return gtype_a.endswith("LINESTRING") or any(not any((p == e).all() for e in ends) for p in probes)


def point_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance of a point to each segment, its nearest point there, and how far along."""
    d = b - a
    n = (d * d).sum(1)
    f = np.clip(((p - a) * d).sum(1) / np.where(n == 0, 1, n), 0, 1)
    q = a + f[:, None] * d
    return np.hypot(*(q - p).T), q, f


def segments(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of every segment; a part of one point is a segment of no length."""
    first = [p if len(p) == 1 else p[:-1] for p in parts]
    last = [p if len(p) == 1 else p[1:] for p in parts]
    return np.vstack(first), np.vstack(last)


def crossings(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Points at which the segments of two geometries meet; the ends of a shared stretch count."""
    p, p2 = segments(a)
    q, q2 = segments(b)
    r, s = (p2 - p)[:, None], (q2 - q)[None]
    d = q[None] - p[:, None]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / cross
        u = (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / cross
    hit = (cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, j = np.nonzero(hit)
    found = [p[i] + t[i, j][:, None] * (p2 - p)[i]]
    for own, (x, y) in ((a, (q, q2)), (b, (p, p2))):
        on = [v for part in own for v in part if point_segments(v, x, y)[0].min() < 1e-9]
        found.append(np.array(on).reshape(-1, 2))
    out = np.vstack(found)
    return out[np.unique(np.round(out, 6), axis=0, return_index=True)[1]] if len(out) else out


def shortest_line(gtype_a: str, a: list[np.ndarray], gtype_b: str, b: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance of two geometries and the two nearest points."""
    meet = surface_point(gtype_a, a, gtype_b, b)
    if meet is not None:
        return 0.0, meet, meet
    best = (math.inf, a[0][0], b[0][0])
    for own, other, swap in ((a, b, False), (b, a, True)):
        x, y = segments(other)
        for v in np.vstack(own):
            d, q, _ = point_segments(v, x, y)
            k = int(d.argmin())
            if d[k] < best[0]:
                best = float(d[k]), *((q[k], v) if swap else (v, q[k]))
    return best


def surface_point(gtype_a: str, a: list[np.ndarray], gtype_b: str, b: list[np.ndarray]) -> np.ndarray | None:
    """A point of the intersection: in the middle of its part of the highest dimension; None if they are apart."""
    return overlay.meeting_point(gtype_a, a, gtype_b, b)


def locate(line: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Fraction of a line's length at which it is nearest to a point, and the distance."""
    a, b = segments([line])
    d, _, f = point_segments(p, a, b)
    k, own = int(d.argmin()), np.hypot(*(b - a).T)
    total = own.sum()
    return (float((own[:k].sum() + f[k] * own[k]) / total) if total else 0.0), float(d[k])


def substring(line: np.ndarray, first: float, last: float) -> np.ndarray:
    """The part of a line between two fractions of its length; one point if they are equal."""
    a, b = segments([line])
    ends = np.concatenate([[0], np.cumsum(np.hypot(*(b - a).T))])
    lo, hi = first * ends[-1], last * ends[-1]
    at = lambda x: np.array([np.interp(x, ends, line[:, 0]), np.interp(x, ends, line[:, 1])])
    if lo == hi:
        return at(lo)[None]
    return np.vstack([at(lo), line[(ends > lo) & (ends < hi)], at(hi)])


def merged(lines: list[np.ndarray]) -> np.ndarray | None:
    """Lines joined end to end into one; None if they branch or leave a gap."""
    rest = [x for x in lines if len(x) > 1]
    if not rest:
        return None
    out, rest = rest[0], rest[1:]
    while rest:
        joined = [(i, x, end) for i, x in enumerate(rest) for x, end in ((x, "tail"), (x[::-1], "tail"), (x, "head"), (x[::-1], "head")) if (x[0] == out[-1] if end == "tail" else x[-1] == out[0]).all()]
        tails = {i for i, _, e in joined if e == "tail"}
        if not joined or len(tails) > 1:
            return None
        i, x, end = joined[0]
        out = np.vstack([out, x[1:]]) if end == "tail" else np.vstack([x[:-1], out])
        rest.pop(i)
    return out


@F.pandas_udf(GEOMETRY)
def from_wkt(text: pd.Series) -> pd.DataFrame:
    """Geometries of well-known text; null fields for what cannot be read."""
    none = {"gtype": None, "pts": None, "starts": None}
    return pd.DataFrame([parse_wkt(t) or none for t in text], columns=["gtype", "pts", "starts"])


# a deterministic function would be worked out once for a condition on it and once more for the column, by two workers a task
from_wkt = from_wkt.asNondeterministic()


@F.pandas_udf(GEOMETRY)
def line_merged(gtype: pd.Series, pts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    """Lines of several parts joined end to end; null fields where they branch or leave a gap."""
    found = [merged(_parts(p, s)) for p, s in zip(pts, starts, strict=True)]
    rows = [("LINESTRING", [{"x": x, "y": y} for x, y in m], None) if m is not None else (None, None, None) for m in found]
    return pd.DataFrame(rows, columns=["gtype", "pts", "starts"])


def _shape(kind: str, parts: list[np.ndarray]) -> tuple:
    """The fields of a geometry; null ones for no parts."""
    if not parts:
        return None, None, None
    starts = None if len(parts) == 1 else np.cumsum([0, *map(len, parts[:-1])]).tolist()
    kind = kind if len(parts) == 1 or kind == "POLYGON" else f"MULTI{kind}"
    return kind, [{"x": float(x), "y": float(y)} for part in parts for x, y in part], starts


@F.pandas_udf(GEOMETRY)
def _valid(gtype: pd.Series, pts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    rows = [_shape(k.removeprefix("MULTI"), made_valid(k, _parts(p, s))) if k is not None else (None, None, None) for k, p, s in zip(gtype, pts, starts, strict=True)]
    return pd.DataFrame(rows, columns=["gtype", "pts", "starts"])


def valid(geometry: Column) -> Column:
    """The geometry without repeated points and with rings that are closed and do not cross; null fields if nothing is left."""
    return _valid(geometry["gtype"], geometry["pts"], geometry["starts"])


@F.pandas_udf(GEOMETRY)
def _common(ga: pd.Series, pa_: pd.Series, sa: pd.Series, gb: pd.Series, pb: pd.Series, sb: pd.Series) -> pd.DataFrame:
    rows = []
    for kind_a, a, kind_b, b in _pairs(ga, pa_, sa, gb, pb, sb):
        found = overlay.common(kind_a, a, kind_b, b)
        rows.append(next((_shape(kind, found[kind]) for kind in ("POLYGON", "LINESTRING", "POINT") if found[kind]), (None, None, None)))
    return pd.DataFrame(rows, columns=["gtype", "pts", "starts"])


def intersection(a: Column, b: Column) -> Column:
    """What two geometries share, of its highest dimension only; null fields if they are apart."""
    return _common(*_fields(a, b))


@F.pandas_udf(T.StructType([T.StructField("x", _REAL), T.StructField("y", _REAL)]))
def _point_on(gtype: pd.Series, pts: pd.Series, starts: pd.Series) -> pd.DataFrame:
    found = [overlay.middle(k.removeprefix("MULTI"), _parts(p, s)) if k is not None else (None, None) for k, p, s in zip(gtype, pts, starts, strict=True)]
    return pd.DataFrame([(None, None) if f[0] is None else (float(f[0]), float(f[1])) for f in found], columns=["x", "y"])


def point_on(geometry: Column) -> Column:
    """A point on a geometry, well inside it where it has an inside."""
    return _point_on(geometry["gtype"], geometry["pts"], geometry["starts"])


def midpoint(pts: Column) -> Column:
    """The point of a line at half its length; the point itself of a line without any."""
    own = steps(pts)
    ends_ = F.aggregate(own, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))
    half = F.element_at(ends_, -1) / 2
    k = F.greatest(F.lit(1), F.size(F.filter(F.slice(ends_, F.lit(1), F.size(ends_) - 1), lambda e: e <= half)))
    a, b = F.element_at(pts, k), F.element_at(pts, F.least(k + 1, F.size(pts)))
    f = F.coalesce((half - F.element_at(ends_, k)) / F.nullif(F.get(own, k - 1), F.lit(0.0)), F.lit(0.0))
    return F.struct((a["x"] + f * (b["x"] - a["x"])).alias("x"), (a["y"] + f * (b["y"] - a["y"])).alias("y"))


def buffer(x: Column, y: Column, radius: float, corners: int = 32) -> Column:
    """A polygon of so many corners around a point, on a circle, closed."""
    corner = lambda i: F.struct((x + radius * F.cos(2 * math.pi * (i % corners) / corners)).alias("x"), (y + radius * F.sin(2 * math.pi * (i % corners) / corners)).alias("y"))
    return shape("POLYGON", F.transform(F.sequence(F.lit(0), F.lit(corners)), corner))


def _pairs(*columns: pd.Series) -> Iterator[tuple[str, list[np.ndarray], str, list[np.ndarray]]]:
    for kind_a, a, sa, kind_b, b, sb in zip(*columns, strict=True):
        yield kind_a, _parts(a, sa), kind_b, _parts(b, sb)


@F.pandas_udf(T.StructType([T.StructField(n, _REAL) for n in ("distance", "anchor_x", "anchor_y", "meet_x", "meet_y")]))
def _pair_measures(ga: pd.Series, pa_: pd.Series, sa: pd.Series, gb: pd.Series, pb: pd.Series, sb: pd.Series) -> pd.DataFrame:
    out = []
    for kind_a, a, kind_b, b in _pairs(ga, pa_, sa, gb, pb, sb):
        d, p, q = shortest_line(kind_a, a, kind_b, b)
        meet = p if d == 0 else (None, None)
        out.append((d, *((p + q) / 2), *meet))
    return pd.DataFrame(out, columns=["distance", "anchor_x", "anchor_y", "meet_x", "meet_y"]).astype("Float64")


@F.pandas_udf(T.BooleanType())
def _within(ga: pd.Series, pa_: pd.Series, sa: pd.Series, gb: pd.Series, pb: pd.Series, sb: pd.Series) -> pd.Series:
    return pd.Series([contained(*pair) for pair in _pairs(ga, pa_, sa, gb, pb, sb)], dtype=bool)


def meet(gtype_a: str, a: list[np.ndarray], gtype_b: str, b: list[np.ndarray]) -> bool:
    """Whether two geometries share a point: their edges meet, or one lies in the other."""
    if len(crossings(a, b)):
        return True
    return any(kind.endswith("POLYGON") and any(inside(part[0], own) for part in other) for kind, own, other in ((gtype_a, a, b), (gtype_b, b, a)))


@F.pandas_udf(T.BooleanType())
def _intersects(ga: pd.Series, pa_: pd.Series, sa: pd.Series, gb: pd.Series, pb: pd.Series, sb: pd.Series) -> pd.Series:
    return pd.Series([meet(*pair) for pair in _pairs(ga, pa_, sa, gb, pb, sb)], dtype=bool)


def intersects(a: Column, b: Column) -> Column:
    """Whether two geometries share a point, on their edges or inside."""
    return _intersects(*_fields(a, b))


def _fields(a: Column, b: Column) -> list[Column]:
    return [g[f] for g in (a, b) for f in ("gtype", "pts", "starts")]


def pair_measures(a: Column, b: Column) -> Column:
    """Distance of two geometries, the middle of their shortest connecting line, and a point of their intersection (or null)."""
    return _pair_measures(*_fields(a, b))


def within(a: Column, b: Column) -> Column:
    """Whether the first geometry lies in the second: no vertex and no stretch outside, and not on the edge altogether."""
    return _within(*_fields(a, b))


@F.pandas_udf(T.StructType([T.StructField("fraction", _REAL), T.StructField("distance", _REAL)]))
def line_locate(pts: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(_parts(p, None)[0], np.array([u, v])) for p, u, v in zip(pts, x, y, strict=True)], columns=["fraction", "distance"])


@F.pandas_udf(_POINTS)
def line_part(pts: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in substring(_parts(p, None)[0], a, b)] for p, a, b in zip(pts, first, last, strict=True)])
