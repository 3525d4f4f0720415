"""Dictionary and matching queries over synthetic mentions, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import dictionary as dic
from ..operators import match as m
from ..operators.lineage import cut, spread
from ..operators.reports import rounded
from ..sources import tables as t


def mentions(spark, d):
    """Messages that name a place exactly, in another order, in part or with a typo."""
    return spread(t.read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").selectExpr(
        "o_orderkey AS message_id",
        "concat('Seen near ', CASE o_orderkey % 4 WHEN 0 THEN concat('customer ', lpad(o_custkey, 9, '0')) WHEN 1 THEN concat(lpad(o_custkey, 9, '0'), ' customer') WHEN 2 THEN concat('kiln', lpad(o_custkey + 100000, 9, '0')) ELSE concat('custmer ', lpad(o_custkey, 9, '0')) END, ' by noon') AS text",
    )


def named(spark, d):
    """The places with one more alias, none of whose words another place has."""
    own = "concat('Kiln', lpad(CAST(id AS STRING), 9, '0'), ' Yard', lpad(CAST(id AS STRING), 9, '0'))"
    return t.places(spark, d).withColumn("names", F.expr(f"concat(names, array({own}))"))


def grams(spark, d):
    return x.message_ngrams(mentions(spark, d), "message_id")


def source(spark, d):
    """A source table for synchronisation: known places with new aliases and types, new places, repeated aliases and canonical names."""
    s = t.read(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS rn", "s_name AS n")
    own = s.selectExpr("rn", "CASE rn % 3 WHEN 0 THEN array(n, concat(n, ' new')) WHEN 1 THEN array(concat('New ', rn), concat('shared ', rn % 10)) ELSE array(n) END AS names", "CASE WHEN rn % 5 = 0 THEN 'fixed' ELSE NULL END AS type")
    return own.unionByName(s.where("rn % 7 = 0").selectExpr("rn + 1000000 AS rn", "array(n, concat(n, ' again'), concat(n, ' new')) AS names", "'again' AS type"))


SOURCE = """source AS (SELECT rn, CASE rn % 3 WHEN 0 THEN [n, concat(n, ' new')] WHEN 1 THEN [concat('New ', rn), concat('shared ', rn % 10)] ELSE [n] END AS names, CASE WHEN rn % 5 = 0 THEN 'fixed' END AS type FROM (SELECT CAST(s_suppkey AS BIGINT) AS rn, s_name AS n FROM supplier)
  UNION ALL SELECT CAST(s_suppkey AS BIGINT) + 1000000, [s_name, concat(s_name, ' again'), concat(s_name, ' new')], 'again' FROM supplier WHERE s_suppkey % 7 = 0),
 by_name AS (SELECT names[1] AS canonical, first(type ORDER BY rn) AS type, list_distinct(flatten(list(names))) AS names FROM source GROUP BY 1)"""


def _linked(spark, d):
    places, each = named(spark, d), cut(grams(spark, d))
    found = m.surfaces(each)
    return m.link(each, "message_id", m.linked_surfaces(found, dic.aliases(places), places.select(F.col("id").alias("geo_id"), "type")))


def _fast(spark, d):
    """Candidates as the matches of numbered address segments; the best of all stands for the general path."""
    c = t.candidates(spark, d).withColumn("no", F.split("text", " ")[1].cast("int"))
    best = c.groupBy("msg_id").agg(F.max_by("geo_id", F.struct("score", -F.col("no"))).alias("geo_id"))
    return m.first_segment_or_general(c.select("msg_id", "no", "geo_id", "score"), best, "msg_id")


def _forms(spark, d):
    words = spark.createDataFrame([("supplier",), ("customer",)], "word string")
    forms = words.select("word", F.explode(F.array(F.concat("word", F.lit("a")), F.concat("word", F.lit("es")), F.col("word"))).alias("form"))
    return dic.case_forms(dic.aliases(t.places(spark, d)), forms, words)


_all = {
    "m11_sync_inserts": (lambda s, d: dic.to_insert(t.places(s, d), source(s, d)).select("rn"), "SELECT rn FROM source p WHERE NOT EXISTS (SELECT 1 FROM places g WHERE list_has_any(g.names, p.names)) AND NOT EXISTS (SELECT 1 FROM source q WHERE q.rn < p.rn AND list_has_any(q.names, p.names))"),
    "m12_sync_aliases": (lambda s, d: dic.merged_aliases(t.places(s, d), source(s, d)), "SELECT g.id, list_concat(g.names, list_sort(list_filter(p.names, lambda a: NOT list_contains(g.names, a)))) AS names FROM places g JOIN by_name p ON g.names[1] = canonical WHERE NOT list_has_all(g.names, p.names)"),
    "m13_sync_types": (lambda s, d: dic.type_fixes(t.places(s, d), source(s, d)), "SELECT g.id, p.type FROM places g JOIN by_name p ON g.names[1] = canonical WHERE g.type IS DISTINCT FROM p.type"),
    "m15_sync_report": (lambda s, d: dic.sync_report(t.places(s, d), source(s, d)), "SELECT count(*) FILTER (g IS NULL) AS unmatched, count(g) AS present FROM source p LEFT JOIN (SELECT DISTINCT names[1] AS g FROM places) ON g = p.names[1]"),
    "a09_synchronised": (lambda s, d: dic.synchronised(t.places(s, d), source(s, d)).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("names")).alias("aliases")), """SELECT type, count(*) AS n, CAST(sum(len(names)) AS BIGINT) AS aliases FROM (
      SELECT CASE WHEN canonical IS NOT NULL THEN p.type ELSE g.type END AS type, CASE WHEN canonical IS NULL THEN g.names ELSE list_concat(g.names, list_filter(p.names, lambda a: NOT list_contains(g.names, a))) END AS names FROM places g LEFT JOIN by_name p ON g.names[1] = canonical
      UNION ALL SELECT p.type, p.names FROM source p WHERE NOT EXISTS (SELECT 1 FROM places g WHERE list_has_any(g.names, p.names)) AND NOT EXISTS (SELECT 1 FROM source q WHERE q.rn < p.rn AND list_has_any(q.names, p.names))) GROUP BY 1"""),
    "j09_aliases": (lambda s, d: t.places(s, d).select("id", F.posexplode("names").alias("pos", "alias")), "SELECT id, CAST(i - 1 AS INT) AS pos, names[i] AS alias FROM (SELECT id, names, unnest(range(1, len(names) + 1)) AS i FROM places)"),
    "t14_alias_index": (lambda s, d: dic.aliases(t.places(s, d)).select("geo_id", "alias", "key", "sorted_key"), """SELECT DISTINCT geo_id, alias, array_to_string(st, ' ') AS key, array_to_string(list_sort(st), ' ') AS sorted_key FROM (
      SELECT id AS geo_id, alias, list_transform(string_split(alias, ' '), lambda w: CASE WHEN length(regexp_replace(w, '(ing|ers|er|ed|es|s)$', '')) >= 3 THEN regexp_replace(w, '(ing|ers|er|ed|es|s)$', '') ELSE w END) AS st FROM (
        SELECT id, lower(trim(regexp_replace(unnest(names), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS alias FROM places))"""),
    "a22_word_places": (lambda s, d: dic.word_objects(dic.aliases(t.places(s, d))), "SELECT word, count(DISTINCT id) AS places FROM (SELECT id, unnest(string_split(lower(trim(regexp_replace(n, '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' ')) AS word FROM (SELECT id, unnest(names) AS n FROM places)) GROUP BY 1"),
    "j17_exact_matches": (lambda s, d: m.exact(m.surfaces(grams(s, d)), dic.aliases(t.places(s, d))).select("surface", "geo_id").distinct(), "SELECT DISTINCT concat('customer ', lpad(o_custkey::VARCHAR, 9, '0')) AS surface, o_custkey + 100000 AS geo_id FROM orders WHERE o_orderkey % 4 = 0"),
    "j18_reordered_matches": (lambda s, d: m.reordered(m.surfaces(grams(s, d)), dic.aliases(t.places(s, d))).select("surface", "geo_id").distinct(), "SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN concat('customer ', lpad(o_custkey::VARCHAR, 9, '0')) ELSE concat(lpad(o_custkey::VARCHAR, 9, '0'), ' customer') END AS surface, o_custkey + 100000 AS geo_id FROM orders WHERE o_orderkey % 4 IN (0, 1)"),
    "j19_linked_sample": (lambda s, d: _linked(s, d).select("message_id", "geo_id", "name", "surface", "source", "rank"), "SELECT o_orderkey AS message_id, o_custkey + 100000 AS geo_id, c_name AS name, CASE o_orderkey % 4 WHEN 0 THEN 'customer ' || lpad(o_custkey::VARCHAR, 9, '0') WHEN 1 THEN lpad(o_custkey::VARCHAR, 9, '0') || ' customer' WHEN 2 THEN 'kiln' || lpad((o_custkey + 100000)::VARCHAR, 9, '0') ELSE 'custmer ' || lpad(o_custkey::VARCHAR, 9, '0') END AS surface, CASE o_orderkey % 4 WHEN 0 THEN 'stem_exact' WHEN 1 THEN 'stem_reorder' WHEN 2 THEN 'stem_subset' ELSE 'surface_typo' END AS source, 1 AS rank FROM orders JOIN customer ON c_custkey = o_custkey"),
    "t24_linked_places": (lambda s, d: _linked(s, d).groupBy("source").agg(F.countDistinct("message_id").alias("n"), F.sum("geo_id").alias("ids")), "SELECT CASE o_orderkey % 4 WHEN 0 THEN 'stem_exact' WHEN 1 THEN 'stem_reorder' WHEN 2 THEN 'stem_subset' ELSE 'surface_typo' END AS source, count(*) AS n, CAST(sum(o_custkey + 100000) AS BIGINT) AS ids FROM orders GROUP BY 1"),
    "t29_match_tiers": (lambda s, d: m.tier(_linked(s, d), "message_id"), "SELECT o_orderkey AS message_id, CASE o_orderkey % 4 WHEN 2 THEN 'none' WHEN 3 THEN 'tier2' ELSE 'tier1' END AS tier FROM orders"),
    "t27_fast_path": (_fast, "WITH ranked AS (SELECT msg_id, geo_id, score, CAST(string_split(text, ' ')[2] AS INT) AS no FROM candidates), fast AS (SELECT msg_id, arg_min(geo_id, no) AS geo_id FROM ranked WHERE score >= 0.8 GROUP BY 1), slow AS (SELECT msg_id, geo_id FROM ranked QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, no) = 1) SELECT msg_id, coalesce(f.geo_id, s.geo_id) AS geo_id, CASE WHEN f.geo_id IS NULL THEN 'general' ELSE 'fast' END AS path FROM slow s LEFT JOIN fast f USING (msg_id)"),
    "t15_replaced_aliases": (lambda s, d: dic.replaced(dic.aliases(t.places(s, d)), t.places(s, d).where("id % 3 = 0").withColumn("names", F.array(F.concat(F.lit("New "), "id")))).select("geo_id", "alias"), "SELECT DISTINCT id AS geo_id, lower(trim(regexp_replace(n, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS alias FROM (SELECT id, unnest(CASE WHEN id % 3 = 0 THEN ['New ' || id] ELSE names END) AS n FROM places)"),
    "t13_case_forms": (_forms, "SELECT id AS geo_id, 'at ' || w || ' ' || n AS alias, unnest(['at ' || w || ' ' || n, 'at ' || w || 'a ' || n, 'at ' || w || 'es ' || n]) AS phrase FROM (SELECT id, string_split(lower(names[1]), '#')[1] AS w, string_split(lower(names[1]), '#')[2] AS n FROM places) UNION ALL SELECT id, w || ' ' || n, unnest([w || ' ' || n, w || 'a ' || n, w || 'es ' || n]) FROM (SELECT id, string_split(lower(names[1]), '#')[1] AS w, string_split(lower(names[1]), '#')[2] AS n FROM places)"),
    "t19_guarded_surfaces": (lambda s, d: m.guarded(m.surfaces(grams(s, d)), s.createDataFrame([("seen",), ("noon",), ("customer",)], "word string"), dic.aliases(t.places(s, d))).where(F.size("stems") == 1).select("surface"), "SELECT DISTINCT CASE o_orderkey % 4 WHEN 2 THEN 'kiln' || lpad((o_custkey + 100000)::VARCHAR, 9, '0') ELSE lpad(o_custkey::VARCHAR, 9, '0') END AS surface FROM orders UNION SELECT 'customer' UNION SELECT 'custmer'"),
    "m14_geometry_heal": (lambda s, d: dic.healed(t.places(s, d).withColumn("lon", F.when(F.col("id") % 4 > 0, F.col("lon"))), t.places(s, d).select("names", "lon", "lat")).select("id", rounded("lon").alias("lon"), rounded("mx", 1).alias("mx")), "SELECT id, floor(lon * 1000 + 0.5) / 1000 AS lon, floor(mx * 10 + 0.5) / 10 AS mx FROM places"),
}

QUERIES = {k: f for k, (f, _) in _all.items()}
_CTE = f"{t.CANDIDATES}, {SOURCE}"
ORACLE_SQL = {k: f"WITH {_CTE}{sql.replace('WITH ', ', ', 1) if sql.startswith('WITH ') else ' ' + sql}" for k, (_, sql) in _all.items()}
