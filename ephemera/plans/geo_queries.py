"""Geometry and arbiter queries over the synthetic dictionary, with DuckDB twins for points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import resolve as v
from ..operators import spatial
from ..operators.lineage import large
from ..operators.reports import rounded
from ..sources import tables as t
from .report_queries import r3

SETTINGS = v.Settings(buffer_m=400.0)


def point_places(spark, d):
    p = t.places(spark, d)
    return p.select("id", F.element_at("names", 1).alias("name"), "type", geo.point(F.col("mx"), F.col("my")).alias("geom"))


def line_places(spark, d):
    """Every third place as a line to two further points, every seventh region as a box, so that all kinds meet."""
    p = t.places(spark, d)
    xy = lambda dx, dy: F.struct((F.col("mx") + dx).alias("x"), (F.col("my") + dy).alias("y"))
    ring = F.array(xy(-5000, -5000), xy(5000, -5000), xy(5000, 5000), xy(-5000, 5000), xy(-5000, -5000))
    line = F.array(xy(0, 0), xy(150, 200), xy(300, 100))
    geom = F.when(F.col("type") == "district", geo.shape("POLYGON", ring)).when(F.col("id") % 3 == 0, geo.shape("LINESTRING", line)).otherwise(geo.point(F.col("mx"), F.col("my")))
    return p.select("id", F.element_at("names", 1).alias("name"), "type", geom.alias("geom"))


def r_arbiter_points(spark, d):
    out = v.resolve(t.candidates(spark, d), point_places(spark, d), t.read(spark, d, "orders").selectExpr("o_orderkey AS msg_id"), SETTINGS)
    p = F.col("geom.pts")[0]
    return out.select("msg_id", "strategy", "reason", "geo_id", rounded("confidence").alias("confidence"), rounded(p["x"], 1).alias("x"), rounded(p["y"], 1).alias("y"), "n_members")


ARBITER = f"""WITH {t.CANDIDATES},
 joined AS (SELECT c.*, p.type, p.mx, p.my FROM candidates c JOIN places p ON p.id = c.geo_id WHERE score >= 0.8),
 once AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY msg_id, geo_id ORDER BY score DESC, text) = 1),
 valid AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, geo_id) <= 10),
 region AS (SELECT msg_id, min(geo_id) AS region_id FROM valid WHERE type = 'district' GROUP BY 1),
 kept AS (SELECT v.* FROM valid v WHERE type <> 'district' AND NOT EXISTS (SELECT 1 FROM region r WHERE r.msg_id = v.msg_id)),
 pairs AS (SELECT a.msg_id, a.geo_id AS a, b.geo_id AS b, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) AS d, (a.mx + b.mx) / 2 AS ax, (a.my + b.my) / 2 AS ay FROM kept a JOIN kept b ON a.msg_id = b.msg_id AND a.geo_id < b.geo_id),
 edges AS (SELECT msg_id, a, b FROM pairs WHERE d <= 400 UNION ALL SELECT msg_id, b, a FROM pairs WHERE d <= 400),
 h0 AS (SELECT msg_id, geo_id FROM kept QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, geo_id) = 1),
 h1 AS (SELECT * FROM h0 UNION SELECT h.msg_id, e.b FROM h0 h JOIN edges e ON h.msg_id = e.msg_id AND h.geo_id = e.a),
 h2 AS (SELECT * FROM h1 UNION SELECT h.msg_id, e.b FROM h1 h JOIN edges e ON h.msg_id = e.msg_id AND h.geo_id = e.a),
 h3 AS (SELECT * FROM h2 UNION SELECT h.msg_id, e.b FROM h2 h JOIN edges e ON h.msg_id = e.msg_id AND h.geo_id = e.a),
 members AS (SELECT k.* FROM kept k JOIN h3 USING (msg_id, geo_id)),
 means AS (SELECT msg_id, avg(score) AS mean, count(*) AS n FROM members GROUP BY 1),
 anchors AS (SELECT p.* FROM pairs p JOIN members a ON a.msg_id = p.msg_id AND a.geo_id = p.a JOIN members b ON b.msg_id = p.msg_id AND b.geo_id = p.b WHERE d <= 800),
 centres AS (SELECT msg_id, avg(ax) AS cx, avg(ay) AS cy FROM anchors GROUP BY 1),
 spreads AS (SELECT msg_id, cx, cy, max(sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy))) AS spread FROM anchors JOIN centres USING (msg_id) GROUP BY ALL),
 centroid AS (SELECT msg_id, cx, cy, greatest(0.1, mean * 0.85 - least(0.3, spread * 0.0004)) AS total FROM spreads JOIN means USING (msg_id) WHERE n >= 2 AND spread <= 500),
 single AS (SELECT msg_id, geo_id, score, mx, my FROM members QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, geo_id) = 1),
 best AS (SELECT s.msg_id, c.total IS NOT NULL AS is_c, s.geo_id, s.score, c.total, s.mx, s.my, c.cx, c.cy FROM single s LEFT JOIN centroid c USING (msg_id)),
 far AS (SELECT DISTINCT b.msg_id FROM best b JOIN members m USING (msg_id) WHERE m.score >= 0.85 AND sqrt((coalesce(cx, b.mx) - m.mx) * (coalesce(cx, b.mx) - m.mx) + (coalesce(cy, b.my) - m.my) * (coalesce(cy, b.my) - m.my)) > 3000),
 picked AS (SELECT *, is_c AND msg_id NOT IN (SELECT msg_id FROM far) AS use_c FROM best)
SELECT o.o_orderkey AS msg_id, CASE WHEN p.msg_id IS NULL THEN 'random_null' WHEN use_c THEN 'weighted_centroid' ELSE 'single_match' END AS strategy,
 CASE WHEN p.msg_id IS NOT NULL THEN NULL WHEN o.o_orderkey NOT IN (SELECT msg_id FROM candidates) THEN 'no_candidates' WHEN o.o_orderkey NOT IN (SELECT msg_id FROM valid) THEN 'no_valid_candidates' ELSE 'district_only' END AS reason,
 CASE WHEN p.msg_id IS NULL THEN region_id WHEN NOT use_c THEN p.geo_id END AS geo_id, {r3('coalesce(CASE WHEN use_c THEN total ELSE score END, 0)')} AS confidence,
 floor((CASE WHEN use_c THEN cx ELSE mx END) * 10 + 0.5) / 10 AS x, floor((CASE WHEN use_c THEN cy ELSE my END) * 10 + 0.5) / 10 AS y, coalesce(n, 0) AS n_members
FROM orders o LEFT JOIN picked p ON p.msg_id = o.o_orderkey LEFT JOIN region r ON r.msg_id = o.o_orderkey LEFT JOIN means m ON m.msg_id = o.o_orderkey"""


def r_arbiter_shapes(spark, d):
    """The arbiter over points, lines and regions together."""
    out = v.resolve(t.candidates(spark, d), line_places(spark, d), s=SETTINGS)
    return out.select("msg_id", "strategy", "reason", "geo_id", rounded("confidence").alias("confidence"), F.col("geom.gtype").alias("gtype"), F.size("geom.pts").alias("n_points"), "n_members")


def r_arbiter_older(spark, d):
    out = v.resolve_older(t.candidates(spark, d), point_places(spark, d))
    return out.select("msg_id", "strategy", "geo_id", rounded("confidence").alias("confidence"))


OLDER = f"""WITH {t.CANDIDATES},
 pts AS (SELECT c.msg_id, c.geo_id, c.text, score * CASE WHEN regexp_full_match(text, '[0-9]+') THEN 0.6 WHEN length(text) < 3 THEN 0.7 ELSE 1.0 END AS score, mx AS x, my AS y FROM candidates c JOIN places p ON p.id = c.geo_id),
 once AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY msg_id, round(x / 10), round(y / 10) ORDER BY score DESC, geo_id, text) = 1),
 mid AS (SELECT a.msg_id, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, 2 * a.score * b.score / (a.score + b.score + 0.001) AS pair FROM once a JOIN once b ON a.msg_id = b.msg_id AND a.geo_id < b.geo_id
   WHERE least(a.score, b.score) >= 0.8 AND (least(a.score, b.score) >= 0.85 OR greatest(a.score, b.score) >= 0.95)),
 c AS (SELECT msg_id, avg(mx) AS cx, avg(my) AS cy, max(pair) AS pair FROM mid GROUP BY 1),
 s AS (SELECT msg_id, max(c.pair) AS pair, max(sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy))) AS spread FROM mid JOIN c USING (msg_id) GROUP BY 1 HAVING max(sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy))) <= 1500),
 b AS (SELECT msg_id, geo_id, score FROM once WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, geo_id) = 1)
SELECT m.msg_id, CASE WHEN s.pair IS NOT NULL THEN 'weighted_centroid' WHEN geo_id IS NOT NULL THEN 'single_match' ELSE 'random' END AS strategy, CASE WHEN s.pair IS NULL THEN geo_id END AS geo_id, {r3('coalesce(s.pair, score * 0.4, 0)')} AS confidence
FROM (SELECT DISTINCT msg_id FROM candidates) m LEFT JOIN s USING (msg_id) LEFT JOIN b USING (msg_id)"""


def near_places(spark, d):
    """Pairs of places within 300 m: an equi-join on grid cells, then the exact distance."""
    p = t.places(spark, d).select("id", "mx", "my")
    cx, cy = geo.grid_cell(F.col("mx"), F.col("my"), 300.0)
    # nine rows a place, from files of few bytes: not to be sent to every executor
    a = large(p.withColumns({"cx": cx, "cy": cy}))
    near = p.select(F.col("id").alias("b"), F.col("mx").alias("bx"), F.col("my").alias("by"), F.explode(F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")).select("b", "bx", "by", "c.*")
    dist = geo.point_distance(F.col("mx"), F.col("my"), F.col("bx"), F.col("by"))
    return a.join(near, ["cx", "cy"]).where("id < b").where(dist <= 300).select(F.col("id").alias("a"), "b", rounded(dist, 1).alias("distance"))


NEAR = f"WITH {t.PLACES} SELECT a.id AS a, b.id AS b, floor(sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) * 10 + 0.5) / 10 AS distance FROM places a JOIN places b ON a.id < b.id AND sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) <= 300"


def mercator(spark, d):
    p = t.places(spark, d)
    return p.select("id", rounded("mx", 2).alias("mx"), rounded("my", 2).alias("my"), rounded(geo.longitude(F.col("mx")), 6).alias("lon"), rounded(geo.latitude(F.col("my")), 6).alias("lat"))


def tiles(spark, d):
    tx, ty = geo.tile(F.col("lon"), F.col("lat"), 14)
    return t.places(spark, d).groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.count("*").alias("n"))


def rings(spark, d):
    """Area and compactness of boxes around places; slivers are those that a rule rejects."""
    w, h = (F.col("id") % 7 + 1).cast("double") / 100, (F.col("id") % 5 + 1).cast("double") * 40
    xy = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    ring = F.array(xy(z, z), xy(w, z), xy(w, h), xy(z, h), xy(z, z))
    p = t.places(spark, d).select("id", ring.alias("r"))
    return p.select("id", rounded(geo.ring_area(F.col("r"))).alias("area"), ((geo.ring_area(F.col("r")) < 100) & (geo.compactness(F.col("r")) < 0.03)).alias("sliver"))


_W, _Hh = "(CAST(id % 7 + 1 AS DOUBLE) / 100)", "(CAST(id % 5 + 1 AS DOUBLE) * 40)"


def scattered(spark, d):
    """Mean point and scatter of each type's places."""
    p = t.places(spark, d).select("type", "mx", "my")
    c = p.groupBy("type").agg(F.avg("mx").alias("cx"), F.avg("my").alias("cy"))
    return p.join(c, "type").groupBy("type").agg(rounded(F.max(geo.point_distance(F.col("mx"), F.col("my"), F.col("cx"), F.col("cy"))), 1).alias("scatter_m"), F.count("*").alias("n"))


def fallback_points(spark, d):
    """A point of a disc for every event without a place."""
    x, y = geo.random_point(F.col("id"), 30.5, 46.5, 0.045)
    e = t.events_log(spark, d).where("strategy = 'random'").select("id", x.alias("lon"), y.alias("lat"))
    return e.select("id", "lon", "lat", (geo.point_distance(F.col("lon"), F.col("lat"), F.lit(30.5), F.lit(46.5)) <= 0.045).alias("in_disc"))


def wkt_places(spark, d):
    """Dictionary rows from text: aliases between bars, and well-known text of which some is broken."""
    s = t.read(spark, d, "supplier").selectExpr("s_suppkey AS id", "concat(s_name, '|', lower(s_name)) AS names", "CASE s_suppkey % 4 WHEN 0 THEN concat('POINT(', s_suppkey, ' 46.5)') WHEN 1 THEN 'LINESTRING(0 0, 3 4)' WHEN 2 THEN 'POLYGON((0 0, 4 0, 4 3, 0 3, 0 0))' ELSE 'POINT(broken' END AS wkt")
    g = s.withColumn("geom", geo.from_wkt("wkt"))
    return g.where("geom.gtype IS NOT NULL").select("id", F.size(F.split("names", r"\|")).alias("aliases"), F.col("geom.gtype").alias("gtype"), geo.length(F.col("geom")).alias("length"), F.size("geom.pts").alias("points"))


def _districts(spark, d):
    shapes = line_places(spark, d)
    return shapes.where("type <> 'district'").select("id", "geom"), shapes.where("type = 'district'").select("id", "geom")


def overlapping_districts(spark, d):
    """Pairs of boxes that share a point."""
    own = _districts(spark, d)[1]
    return spatial.join_shapes(own, own).where("a < b")


def shapes_in_districts(how):
    """How many lines and points meet each district, or lie in it."""

    def run(spark, d):
        shapes, own = _districts(spark, d)
        return spatial.tally(shapes.withColumn("gtype", F.col("geom")["gtype"]), own, how, by=("gtype",)).select(F.col("b").alias("district"), "gtype", "n", F.col("total").alias("ids"))

    return run


def shared_regions(spark, d):
    """The area that two overlapping districts have in common, and whether its middle lies in both."""
    own = _districts(spark, d)[1]
    part = F.col("part")["pts"]
    # from a corner of its own, as the figures of the map would swallow the small ones
    near = F.transform(part, lambda q: F.struct((q["x"] - F.get(part, 0)["x"]).alias("x"), (q["y"] - F.get(part, 0)["y"]).alias("y")))
    found = spatial.shared(own, own).where("a < b")
    told = lambda rows, area: rows.select("a", "b", "gtype", rounded(area / 1e6, 2).alias("km2"), "inside")
    return told(found.where("box"), F.col("area")).unionByName(told(found.where("NOT box"), geo.ring_area(near)))


def mended_rings(spark, d):
    """Rings in the form of an eight around places, as polygons that do not cross themselves."""
    xy = lambda dx, dy: F.struct((F.col("mx") + dx).alias("x"), (F.col("my") + dy).alias("y"))
    w = (F.col("id") % 9 + 1) * 20.0
    ring = F.array(xy(-w, -w), xy(w, w), xy(w, -w), xy(-w, w), xy(-w, -w))
    p = t.places(spark, d).select("id", geo.valid(geo.shape("POLYGON", ring)).alias("g"))
    areas = F.transform(geo.part_arrays(F.col("g")), lambda r: geo.ring_area(r))
    return p.select("id", F.size(areas).alias("rings"), rounded(F.aggregate(areas, F.lit(0.0), lambda a, b: a + b), 1).alias("area"))


def line_middles(spark, d):
    """The middle of each line by length along it."""
    p = line_places(spark, d).where("geom.gtype = 'LINESTRING'").select("id", geo.midpoint(F.col("geom")["pts"]).alias("m"))
    return p.select("id", rounded("m.x", 1).alias("x"), rounded("m.y", 1).alias("y"))


def buffers(spark, d):
    """A polygon of 200 metres around each place: its corners and area."""
    ring = geo.buffer(F.col("mx"), F.col("my"), 200.0)["pts"]
    return t.places(spark, d).select("id", F.size(ring).alias("corners"), rounded(geo.ring_area(F.transform(ring, lambda q: F.struct((q["x"] - F.col("mx")).alias("x"), (q["y"] - F.col("my")).alias("y")))), 1).alias("area"))


_SHAPES = f"""{t.PLACES},
 district AS (SELECT id, mx - 5000 AS x0, my - 5000 AS y0, mx + 5000 AS x1, my + 5000 AS y1 FROM places WHERE type = 'district'),
 shapes AS (SELECT id, mx, my, id % 3 = 0 AS line FROM places WHERE type <> 'district'),
 segments AS (SELECT id, mx AS px, my AS py, mx + 150 AS qx, my + 200 AS qy FROM shapes WHERE line UNION ALL SELECT id, mx + 150, my + 200, mx + 300, my + 100 FROM shapes WHERE line)"""
_SIDE = "sign((qx - px) * ({y} - py) - ({x} - px) * (qy - py))"
_CORNERS = ", ".join(_SIDE.format(x=f"d.{x}", y=f"d.{y}") for x in ("x0", "x1") for y in ("y0", "y1"))
MEETING = f"""WITH {_SHAPES}, pairs AS (
 SELECT d.id AS district, 'POINT' AS gtype, s.id FROM shapes s JOIN district d ON NOT line AND mx BETWEEN x0 AND x1 AND my BETWEEN y0 AND y1
 UNION SELECT d.id, 'LINESTRING', s.id FROM segments s JOIN district d ON least(px, qx) <= x1 AND greatest(px, qx) >= x0 AND least(py, qy) <= y1 AND greatest(py, qy) >= y0
   WHERE list_min([{_CORNERS}]) <= 0 AND list_max([{_CORNERS}]) >= 0)
 SELECT district, gtype, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM pairs GROUP BY ALL"""
WITHIN = f"""WITH {_SHAPES} SELECT d.id AS district, CASE WHEN line THEN 'LINESTRING' ELSE 'POINT' END AS gtype, count(*) AS n, CAST(sum(s.id) AS BIGINT) AS ids FROM shapes s JOIN district d
 ON mx > x0 AND my > y0 AND CASE WHEN line THEN mx + 300 ELSE mx END < x1 AND CASE WHEN line THEN my + 200 ELSE my END < y1 GROUP BY ALL"""
_OVERLAP = "FROM district a JOIN district b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"

QUERIES = {
    "j06_overlapping_districts": overlapping_districts, "j06_shapes_meeting_districts": shapes_in_districts("intersects"), "j07_shapes_within_districts": shapes_in_districts("within"),
    "g07_shared_regions": shared_regions, "g03_mended_rings": mended_rings, "g21_line_middles": line_middles, "g23_buffers": buffers,
    "r01_arbiter_points": r_arbiter_points, "r02_arbiter_shapes": r_arbiter_shapes, "r03_arbiter_older_rules": r_arbiter_older, "j05_distance_join": near_places, "g02_mercator": mercator, "g24_tiles": tiles,
    "g22_sliver_polygons": rings, "g14_scatter": scattered, "g20_fallback_points": fallback_points, "s03_wkt_dictionary": wkt_places,
    "g17_geojson": lambda s, d: line_places(s, d).select("id", geo.geojson(F.col("geom")).alias("geojson")),
}
ORACLE_SQL = {
    "j06_overlapping_districts": f"WITH {_SHAPES} SELECT a.id AS a, b.id AS b {_OVERLAP}",
    "j06_shapes_meeting_districts": MEETING,
    "j07_shapes_within_districts": WITHIN,
    "g07_shared_regions": f"WITH {_SHAPES} SELECT a.id AS a, b.id AS b, 'POLYGON' AS gtype, floor((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / 1e6 * 100 + 0.5) / 100 AS km2, true AS inside {_OVERLAP}",
    "g03_mended_rings": f"WITH {t.PLACES} SELECT id, 2 AS rings, floor(2 * pow((id % 9 + 1) * 20.0, 2) * 10 + 0.5) / 10 AS area FROM places",
    "g21_line_middles": f"WITH {t.PLACES}, l AS (SELECT *, ((250 + sqrt(150 * 150 + 100 * 100)) / 2) / 250 AS f FROM places WHERE type <> 'district' AND id % 3 = 0) SELECT id, floor((mx + f * 150) * 10 + 0.5) / 10 AS x, floor((my + f * 200) * 10 + 0.5) / 10 AS y FROM l",
    "g23_buffers": f"WITH {t.PLACES} SELECT id, 33 AS corners, floor(32 * 200 * 200 / 2 * sin(2 * pi() / 32) * 10 + 0.5) / 10 AS area FROM places",
    "r01_arbiter_points": ARBITER,
    "r03_arbiter_older_rules": OLDER,
    "j05_distance_join": NEAR,
    "g02_mercator": f"WITH {t.PLACES} SELECT id, floor(mx * 100 + 0.5) / 100 AS mx, floor(my * 100 + 0.5) / 100 AS my, floor(mx * 180 / 20037508.342789244::DOUBLE * 1000000 + 0.5) / 1000000 AS lon, floor((atan(exp(my / 6378137)) * 360 / pi() - 90) * 1000000 + 0.5) / 1000000 AS lat FROM places",
    "g24_tiles": f"WITH {t.PLACES} SELECT CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS tx, CAST(floor((1 - my / (pi() * 6378137)) / 2 * 16384) AS BIGINT) AS ty, count(*) AS n FROM places GROUP BY ALL",
    "g22_sliver_polygons": f"WITH {t.PLACES} SELECT id, {r3(f'{_W} * {_Hh}')} AS area, {_W} * {_Hh} < 100 AND 4 * pi() * {_W} * {_Hh} / pow(2 * ({_W} + {_Hh}), 2) < 0.03 AS sliver FROM places",
    "g14_scatter": f"WITH {t.PLACES} SELECT type, floor(max(sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy))) * 10 + 0.5) / 10 AS scatter_m, count(*) AS n FROM places JOIN (SELECT type, avg(mx) AS cx, avg(my) AS cy FROM places GROUP BY 1) USING (type) GROUP BY 1",
    "s03_wkt_dictionary": "SELECT s_suppkey AS id, 2 AS aliases, CASE s_suppkey % 4 WHEN 0 THEN 'POINT' WHEN 1 THEN 'LINESTRING' ELSE 'POLYGON' END AS gtype, CASE s_suppkey % 4 WHEN 1 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS length, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END AS points FROM supplier WHERE s_suppkey % 4 < 3",
}
