"""Metric, limit, file and serving queries, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import log as o
from ..operators import metrics as m
from ..operators.lineage import shared_dir
from ..operators.reports import rounded
from ..sources import files
from ..sources import tables as t
from ..streaming import sink
from .report_queries import r3

BOUNDS = (1, 5, 10, 25, 50, 100, 250)
TOGGLES = ("click", "view", "click", "error", "signup", "view", "view")
_START = "strftime(make_timestamp(CAST(floor(epoch(event_time) / {0}) * {0} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _text(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def rates(s, d):
    e = t.events_log(s, d)
    return _text(m.rate(e, ["user_id", "layer"], "layer", "event_time", "k", "id", 21600)).withColumn("rate", rounded("rate", 6))


def gauges(s, d):
    return _text(m.gauge(t.events_log(s, d), "layer", "event_time", "k", "id"))


def log_rates(s, d):
    e = t.events_log(s, d).where("layer IN ('error', 'view')")
    return _text(m.event_rate(e, "layer", "event_time", 3600)).withColumn("rate", rounded("rate", 6))


def fallback_rates(s, d):
    """Confidence of labels that match a pattern, else of all by the same name, as a dashboard's 'or' does."""
    e = t.events_log(s, d)
    own = e.where(F.col("layer").rlike("^(click|view)$") & (F.col("strategy") != "random")).groupBy("layer").agg(F.count("*").alias("n"))
    return m.first_of(own, e.groupBy("layer").agg((-F.count("*")).alias("n")), ["layer"], "n")


def quantiles(s, d):
    e = t.events_log(s, d)
    p = [m.histogram_quantile(e, "layer", "value", BOUNDS, q).select("layer", F.lit(q).alias("q"), rounded("quantile").alias("quantile")) for q in (0.5, 0.95)]
    return p[0].unionByName(p[1])


def toggled(s, d):
    """The log's categories after a list of toggles: those named an odd number of times."""
    active = s.createDataFrame([(x,) for x in TOGGLES], "layer string").groupBy("layer").agg(F.count("*").alias("n")).where("n % 2 = 1").select("layer")
    e = t.events_log(s, d)
    return o.recent(e, t.as_of(e), 30 * 60).join(o.small(active), "layer", "left_semi").select("id", "layer")


def photo_lists(s, d):
    """JSON arrays of two lists one after the other, of which one may be missing."""
    e = t.events_log(s, d)
    a, b = F.when(F.col("id") % 3 > 0, F.array("photo_url", F.col("layer"))), F.when(F.col("id") % 2 > 0, F.array("strategy"))
    none = F.array().cast("array<string>")
    return e.select("id", F.to_json(F.concat(F.coalesce(a, none), F.coalesce(b, none))).alias("urls"))


def etags(s, d):
    """The tag of an answer: of the log's version, the time filter and the sorted categories."""
    sets = s.createDataFrame([(1, 60, ["view", "click"]), (2, 60, ["click", "view"]), (3, 15, ["click"]), (4, 0, [])], "request int, minutes int, layers array<string>")
    version = t.events_log(s, d).agg(F.count("*").alias("version"))
    return o.small(sets).join(version).select("request", F.md5(F.concat_ws("/", F.col("version").cast("string"), F.col("minutes").cast("string"), F.array_join(F.array_sort("layers"), ","))).alias("etag"))


def dictionary_features(s, d):
    p = t.places(s, d)
    g = geo.geojson(geo.point(rounded("lon"), rounded("lat")))
    return p.where("lon IS NOT NULL").select("id", g.alias("geojson"))


def csv_dictionary(s, d):
    """The dictionary written as CSV with well-known text, of which every fifth is broken, and scanned again."""
    path = f"{shared_dir(s)}/dictionary-{uuid.uuid4().hex}"
    p = t.places(s, d)
    wkt = F.when(F.col("id") % 5 == 0, "POINT(broken").otherwise(F.concat(F.lit("MULTIPOINT(("), rounded("lon"), F.lit(" "), rounded("lat"), F.lit("), (0 0))")))
    p.select("id", F.array_join("names", "|").alias("names"), wkt.alias("wkt"), "type").write.option("header", True).csv(path)
    out = files.read_dictionary(s, path)
    return out.select("id", F.size("names").alias("aliases"), F.element_at("names", 1).alias("name"), "type", "geom.gtype", F.col("geom.pts")[0]["x"].alias("lon"))


def csv_words(s, d):
    path = f"{shared_dir(s)}/words-{uuid.uuid4().hex}"
    t.events_log(s, d).select(F.concat(F.lit(" "), F.initcap("layer")).alias("word")).write.option("header", True).csv(path)
    return files.read_words(s, path)


def gzip_features(s, d):
    """Places as compressed GeoJSON lines with rows of other kinds among them, loaded again."""
    path = f"{shared_dir(s)}/features-{uuid.uuid4().hex}"
    p = t.places(s, d)
    kind = F.when(F.col("id") % 7 == 0, "LineString").otherwise("Point")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type"), F.array(rounded("lon"), rounded("lat")).alias("coordinates")).alias("geometry"), F.struct("id", F.element_at("names", 1).alias("name")).alias("properties")))
    p.select(feature.alias("value")).write.option("compression", "gzip").text(path)
    return files.read_point_features(s, path)


def snapshots(s, d):
    """A stream that saves a snapshot of its counts after every batch, and what the newest one holds."""
    root = f"{shared_dir(s)}/snapshots-{uuid.uuid4().hex}"
    state: dict[str, object] = {}

    def save(batch, number):
        seen = batch.groupBy("layer").agg(F.count("*").alias("n"))
        if number:
            seen = files.newest_snapshot(s, root).unionByName(seen).groupBy("layer").agg(F.sum("n").alias("n"))
        files.save_snapshot(seen, root, number)
        state["last"] = number
        return batch.select("id")

    sink.run_to_table(s, sink.events_stream(s, d), "snapshots", each=save)
    return files.newest_snapshot(s, root)


def snapshot_then_live(s, d):
    """What a client has that loads a snapshot up to a mark and then the stream behind it: every row once."""
    e = t.events_log(s, d).select("id", "layer")
    mark = e.agg(F.floor(F.max("id") / 2).alias("mark"))
    before = e.where(F.col("id") <= mark.scalar())
    live = sink.run_to_table(s, sink.events_stream(s, d).select("id", "layer"), "live")
    behind = live.select("id", "layer").where(F.col("id") > mark.scalar())
    return before.withColumn("part", F.lit("snapshot")).unionByName(behind.withColumn("part", F.lit("live"))).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_CUM = ", ".join(f"count(*) FILTER (value <= {b})" for b in BOUNDS)
_QUANTILES = f"""SELECT layer, q, {r3('''CASE WHEN i IS NULL THEN 250 WHEN cum[i] = CASE WHEN i = 1 THEN under ELSE cum[i - 1] END THEN CASE WHEN i = 1 THEN 0 ELSE le[i - 1] END
  ELSE CASE WHEN i = 1 THEN 0 ELSE le[i - 1] END + (le[i] - CASE WHEN i = 1 THEN 0 ELSE le[i - 1] END) * (total * q - CASE WHEN i = 1 THEN under ELSE cum[i - 1] END) / (cum[i] - CASE WHEN i = 1 THEN under ELSE cum[i - 1] END) END''')} AS quantile
  FROM (SELECT *, list_filter(range(1, {len(BOUNDS) + 1}), lambda j: cum[j] >= total * q)[1] AS i FROM (SELECT layer, count(value) AS total, count(*) FILTER (value <= 0) AS under, [{_CUM}] AS cum, {[float(b) for b in BOUNDS]}::DOUBLE[] AS le FROM events_log GROUP BY layer), (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) v(q))"""
_SLIDE = """, ordered AS (SELECT user_id, epoch(event_time) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_time) AS rn FROM events_log),
  fold AS (SELECT user_id, rn, [x] AS kept, 1 AS passed FROM ordered WHERE rn = 1 UNION ALL
    SELECT o.user_id, o.rn, CASE WHEN len(kept) < 2 OR x - kept[1] >= 43200 THEN list_append(CASE WHEN len(kept) < 2 THEN kept ELSE kept[2:] END, x) ELSE kept END, passed + CASE WHEN len(kept) < 2 OR x - kept[1] >= 43200 THEN 1 ELSE 0 END FROM fold f JOIN ordered o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
  SELECT user_id, max(rn) AS requests, CAST(max(passed) AS BIGINT) AS passed FROM fold GROUP BY 1"""
_all = {
    "v01_counter_rate": (rates, f"SELECT layer, {_START.format(21600)} AS start, floor(sum(gain)::DOUBLE / 21600 * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS rate FROM (SELECT layer, event_time, CASE WHEN b IS NULL THEN 0 WHEN k < b THEN k ELSE k - b END AS gain FROM (SELECT layer, event_time, k, lag(k) OVER (PARTITION BY user_id, layer ORDER BY event_time, id) AS b FROM events_log)) GROUP BY 1, 2"),
    "v03_histogram_quantile": (quantiles, _QUANTILES),
    "v04_gauges": (gauges, f"SELECT layer, {_START.format(3600)} AS start, arg_max(k, struct_pack(a := event_time, b := id)) AS last, max(k) AS most FROM events_log GROUP BY 1, 2"),
    "v05_label_fallback": (fallback_rates, "SELECT layer, coalesce(a.n, b.n) AS n FROM (SELECT layer, count(*) AS n FROM events_log WHERE regexp_full_match(layer, 'click|view') AND strategy <> 'random' GROUP BY 1) a FULL JOIN (SELECT layer, -count(*) AS n FROM events_log GROUP BY 1) b USING (layer)"),
    "v06_log_rate": (log_rates, f"SELECT layer, {_START.format(3600)} AS start, floor(count(*)::DOUBLE / 3600 * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE AS rate FROM events_log WHERE layer IN ('error', 'view') GROUP BY 1, 2"),
    "a24_approximate_quantile": (lambda s, d: t.events_log(s, d).groupBy("layer").agg(F.percentile_approx("k", 0.5, 1_000_000).alias("median"), F.percentile_approx("k", 0.95, 1_000_000).alias("p95")), "SELECT layer, quantile_disc(k, 0.5) AS median, quantile_disc(k, 0.95) AS p95 FROM events_log GROUP BY 1"),
    "d15_sliding_limit": (lambda s, d: m.sliding_limits(t.events_log(s, d), "user_id", "event_time", 2, 43200), _SLIDE),
    "e13_toggled_categories": (toggled, "SELECT id, layer FROM events_log, as_of WHERE layer IN ('view', 'error', 'signup') AND event_time >= t - INTERVAL 1800 MINUTE"),
    "u04_json_array_concat": (photo_lists, "SELECT id, CAST(to_json(list_concat(CASE WHEN id % 3 > 0 THEN [photo_url, layer] ELSE []::VARCHAR[] END, CASE WHEN id % 2 > 0 THEN [strategy] ELSE []::VARCHAR[] END)) AS VARCHAR) AS urls FROM events_log"),
    "d18_etags": (etags, "SELECT request, md5(n || '/' || minutes || '/' || layers) AS etag FROM (VALUES (1, 60, 'click,view'), (2, 60, 'click,view'), (3, 15, 'click'), (4, 0, '')) v(request, minutes, layers), (SELECT count(*) AS n FROM events_log)"),
    "e09_dictionary_features": (dictionary_features, """SELECT id, '{"type":"Point","coordinates":[' || floor(lon * 1000 + 0.5) / 1000 || ',' || floor(lat * 1000 + 0.5) / 1000 || ']}' AS geojson FROM places"""),
    "s01_csv_words": (csv_words, "SELECT DISTINCT layer AS word FROM events_log"),
    "s02_csv_dictionary": (csv_dictionary, "SELECT id, 3 AS aliases, names[1] AS name, type, 'MULTIPOINT' AS gtype, floor(lon * 1000 + 0.5) / 1000 AS lon FROM places WHERE id % 5 <> 0"),
    "s13_gzip_features": (gzip_features, "SELECT id, names[1] AS name, floor(lon * 1000 + 0.5) / 1000 AS lon, floor(lat * 1000 + 0.5) / 1000 AS lat FROM places WHERE id % 7 <> 0"),
    "stream_m22_snapshots": (snapshots, "SELECT layer, count(*) AS n FROM events_log GROUP BY 1"),
    "stream_d10_snapshot_then_live": (snapshot_then_live, "SELECT CASE WHEN id <= mark THEN 'snapshot' ELSE 'live' END AS part, count(*) AS n, min(id) AS first FROM events_log, (SELECT floor(max(id) / 2) AS mark FROM events_log) GROUP BY 1"),
}
QUERIES = {k: f for k, (f, _) in _all.items()}
_CTE = f"{t.EVENTS_LOG}, {t.PLACES}"
ORACLE_SQL = {k: f"WITH RECURSIVE {_CTE}{'' if sql.startswith(',') else ' '}{sql}" for k, (_, sql) in _all.items()}
