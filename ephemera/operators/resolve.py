"""The spatial arbiter: one relational plan that resolves the place candidates of every message to one geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from .lineage import cut


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    buffer_m: float = 100.0
    scatter_m: float = 500.0
    anchor_m: float = 800.0
    far_m: float = 3000.0
    far_score: float = 0.85
    most: int = 10
    mask: str = "district"


def _ranked(df: DataFrame, by: list[str], *order: Column, at_most: int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= at_most).drop("_rn")


def valid_candidates(candidates: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """Candidates over the threshold with a geometry: the best of each place, the best of each message. Ids break ties."""
    known = places.where("geom IS NOT NULL").select(F.col("id").alias("geo_id"), "name", "type", "geom")
    joined = candidates.where(F.col("score") >= s.threshold).join(known, "geo_id")
    once = _ranked(joined, ["msg_id", "geo_id"], F.desc("score"), F.col("text"))
    return _ranked(once, ["msg_id"], F.desc("score"), F.col("geo_id"), at_most=s.most)


def masked(valid: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The candidates that the message's region leaves, and the regions. A region only filters and is never an answer."""
    region = _ranked(valid.where(F.col("type") == s.mask), ["msg_id"], F.col("geo_id")).select("msg_id", F.col("geo_id").alias("region_id"), F.col("geom").alias("region"))
    others = valid.where(F.col("type") != s.mask).join(region, "msg_id", "left")
    free = others.where("region_id IS NULL")
    held = others.where("region_id IS NOT NULL").where(geo.within(F.col("geom"), F.col("region")))
    return free.unionByName(held).drop("region_id", "region"), region.drop("region")


def measured_pairs(kept: DataFrame) -> DataFrame:
    """Unordered pairs within each message, with distance, anchor and meeting point; points need no helper."""
    a = kept.select("msg_id", F.col("geo_id").alias("a"), F.col("geom").alias("ga"))
    b = kept.select("msg_id", F.col("geo_id").alias("b"), F.col("geom").alias("gb"))
    pairs = a.join(b, "msg_id").where("a < b")
    both = (F.col("ga.gtype") == "POINT") & (F.col("gb.gtype") == "POINT")
    p, q = F.col("ga.pts")[0], F.col("gb.pts")[0]
    d = geo.point_distance(p["x"], p["y"], q["x"], q["y"])
    points = pairs.where(both).select("msg_id", "a", "b", d.alias("distance"), ((p["x"] + q["x"]) / 2).alias("anchor_x"), ((p["y"] + q["y"]) / 2).alias("anchor_y"), F.when(d == 0, p["x"]).alias("meet_x"), F.when(d == 0, p["y"]).alias("meet_y"))
    rest = pairs.where(~both).withColumn("m", geo.pair_measures(F.col("ga"), F.col("gb"))).select("msg_id", "a", "b", "m.*")
    return points.unionByName(rest)


def main_component(kept: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """msg_id, geo_id of what lies within three steps of the best candidate, itself included."""
    near = pairs.where(F.col("distance") <= s.buffer_m)
    edges = near.select("msg_id", "a", "b").unionByName(near.select("msg_id", F.col("b").alias("a"), F.col("a").alias("b")))
    reached = _ranked(kept, ["msg_id"], F.desc("score"), F.col("geo_id")).select("msg_id", "geo_id")
    for _ in range(3):
        step = reached.join(edges.withColumnRenamed("a", "geo_id"), ["msg_id", "geo_id"]).select("msg_id", F.col("b").alias("geo_id"))
        reached = reached.union(step).distinct()
    return reached


def resolve(candidates: DataFrame, places: DataFrame, messages: DataFrame | None = None, s: Settings = Settings()) -> DataFrame:
    """One row per message: msg_id, strategy, reason, geo_id, confidence, geom, n_members, matches.

    candidates: msg_id, geo_id, score (null counts as 1), text. places: id, name, type, geom (metric; lines of
    several parts are joined where they can be). messages, if
    given, are those of which some have no candidate. Hypotheses: a part of a line between crossings, the centre of
    crossings, the mean of pair anchors, one place; the first in this order wins, then the greater score, then the
    smaller id. A far candidate with a high score makes the best single place win instead.
    """
    candidates = candidates.withColumn("score", F.coalesce("score", F.lit(1.0)))
    valid = cut(valid_candidates(candidates, places, s))
    kept, region = masked(valid, s)
    kept = cut(kept)
    pairs = cut(measured_pairs(kept))
    members = cut(kept.join(main_component(kept, pairs, s), ["msg_id", "geo_id"]))
    inner = pairs.join(members.select("msg_id", F.col("geo_id").alias("a")), ["msg_id", "a"], "left_semi").join(members.select("msg_id", F.col("geo_id").alias("b")), ["msg_id", "b"], "left_semi")
    mean = members.groupBy("msg_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n_members"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "geo_id", "name", "text"))).alias("m"))
    mean = mean.select("msg_id", "mean", "n_members", F.transform("m", lambda x: F.struct(x["geo_id"].alias("geo_id"), x["name"].alias("name"), (-x["order"]).alias("similarity"), x["text"].alias("matched_text"))).alias("matches"))
    inner, mean = cut(inner), cut(mean)
    meets = inner.where("meet_x IS NOT NULL").select("msg_id", "meet_x", "meet_y")

    own = members.where("geom.gtype = 'LINESTRING'")
    several = members.where("geom.gtype = 'MULTILINESTRING'").withColumn("geom", geo.line_merged("geom.gtype", "geom.pts", "geom.starts")).where("geom.gtype IS NOT NULL")
    lines = own.unionByName(several).join(meets, "msg_id").withColumn("at", geo.line_locate("geom.pts", "meet_x", "meet_y"))
    hits = lines.where(F.col("at.distance") <= s.buffer_m).groupBy("msg_id", "geo_id", "score").agg(F.count("*").alias("hits"), F.min("at.fraction").alias("lo"), F.max("at.fraction").alias("hi"), F.first("geom").alias("geom")).where("hits >= 2")
    hits = cut(hits)
    clamp = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col(c)))
    part = hits.withColumn("pts", geo.line_part("geom.pts", clamp("lo"), clamp("hi")))
    segment = part.select("msg_id", F.lit("street_segment").alias("strategy"), F.lit(5).alias("priority"), "geo_id", (F.col("score") * 0.9).alias("total"), geo.shape("LINESTRING", F.col("pts")).alias("geom"))
    has_segment = hits.select("msg_id").distinct()

    def centre(rows: DataFrame, x: str, y: str) -> DataFrame:
        """Mean point of each message's rows, and how far the farthest lies from it."""
        c = rows.groupBy("msg_id").agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))
        far = rows.join(c, "msg_id").groupBy("msg_id", "cx", "cy").agg(F.max(geo.point_distance(F.col(x), F.col(y), F.col("cx"), F.col("cy"))).alias("spread"))
        return far.join(mean, "msg_id").join(has_segment, "msg_id", "left_anti")

    nothing = F.lit(None).cast("long").alias("geo_id")
    crossing = centre(meets, "meet_x", "meet_y").where(F.col("spread") <= 2 * s.buffer_m).select("msg_id", F.lit("intersection").alias("strategy"), F.lit(4).alias("priority"), nothing, F.col("mean").alias("total"), geo.point(F.col("cx"), F.col("cy")).alias("geom"))
    anchors = inner.where(F.col("distance") <= s.anchor_m).join(meets.select("msg_id").distinct(), "msg_id", "left_anti")
    total = F.greatest(F.lit(0.1), F.col("mean") * 0.85 - F.least(F.lit(0.3), F.col("spread") * 0.0004))
    centroid = centre(anchors, "anchor_x", "anchor_y").where((F.col("n_members") >= 2) & (F.col("spread") <= s.scatter_m))
    centroid = centroid.select("msg_id", F.lit("weighted_centroid").alias("strategy"), F.lit(3).alias("priority"), nothing, total.alias("total"), geo.point(F.col("cx"), F.col("cy")).alias("geom"))
    single = members.select("msg_id", F.lit("single_match").alias("strategy"), F.lit(1).alias("priority"), "geo_id", F.col("score").alias("total"), "geom")
    best = cut(_ranked(segment.unionByName(crossing).unionByName(centroid).unionByName(single), ["msg_id"], F.desc("priority"), F.desc("total"), F.col("geo_id")))

    line_first = F.when(F.col("geom.gtype").isin("LINESTRING", "MULTILINESTRING"), 2).otherwise(1)
    alone = _ranked(members.withColumn("_length", geo.length(F.col("geom"))), ["msg_id"], F.desc("score"), line_first.desc(), F.desc("_length"), F.col("geo_id")).select("msg_id", F.col("geo_id").alias("s_id"), F.col("score").alias("s_total"), F.col("geom").alias("s_geom"))
    strong = members.where(F.col("score") >= s.far_score).select("msg_id", F.col("geom").alias("other")).join(best.select("msg_id", "geom"), "msg_id")
    both = (F.col("geom.gtype") == "POINT") & (F.col("other.gtype") == "POINT")
    p, q = F.col("geom.pts")[0], F.col("other.pts")[0]
    near = strong.where(both).select("msg_id", geo.point_distance(p["x"], p["y"], q["x"], q["y"]).alias("d"))
    wide = strong.where(~both).select("msg_id", geo.pair_measures(F.col("geom"), F.col("other"))["distance"].alias("d"))
    far = near.unionByName(wide).where(F.col("d") > s.far_m).select("msg_id").distinct().withColumn("far", F.lit(True))

    chosen = best.join(alone, "msg_id").join(far, "msg_id", "left").withColumn("far", F.coalesce("far", F.lit(False)))
    pick = lambda a, b: F.when(F.col("far"), F.col(a)).otherwise(F.col(b))
    found = chosen.select("msg_id", F.when(F.col("far"), "single_match").otherwise(F.col("strategy")).alias("strategy"), pick("s_id", "geo_id").alias("geo_id"), pick("s_total", "total").alias("confidence"), pick("s_geom", "geom").alias("geom")).join(mean.drop("mean"), "msg_id")
    every = (messages if messages is not None else candidates).select("msg_id").distinct()
    given = candidates.select("msg_id").distinct().withColumn("given", F.lit(1))
    had = valid.select("msg_id").distinct().withColumn("had", F.lit(1))
    out = every.join(found, "msg_id", "left").join(given, "msg_id", "left").join(had, "msg_id", "left").join(region, "msg_id", "left")
    reason = F.when(F.col("strategy").isNotNull(), F.lit(None)).when(F.col("given").isNull(), "no_candidates").when(F.col("had").isNull(), "no_valid_candidates").when(F.col("region_id").isNotNull(), "district_only").otherwise("all_filtered_by_district")
    return out.select(
        "msg_id", F.coalesce("strategy", F.lit("random_null")).alias("strategy"), reason.alias("reason"), F.when(F.col("strategy").isNull(), F.col("region_id")).otherwise(F.col("geo_id")).alias("geo_id"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "geom", F.coalesce("n_members", F.lit(0)).alias("n_members"), "matches",
    )


def adjusted_score(score: Column, text: Column) -> Column:
    """The older rule set's score: texts under three characters and texts of digits alone count less."""
    return score * F.when(text.rlike("^[0-9]+$"), 0.6).when(F.length(text) < 3, 0.7).otherwise(1.0)


def resolve_older(candidates: DataFrame, places: DataFrame, threshold: float = 0.85, scatter_m: float = 1500.0) -> DataFrame:
    """The older rule set over points: msg_id, strategy, geo_id, confidence.

    Candidates with adjusted scores over the threshold; places on the same grid point count once (the best score, then
    the smaller id). Pairs whose scores are both at least 0.85, or 0.95 and 0.8, give a centre of their middles, with
    the harmonic mean as score; without pairs, or if the middles scatter too far, the best place stands alone at 0.4
    of its score; below the threshold nothing is found.
    """
    scored = candidates.withColumn("score", adjusted_score(F.coalesce("score", F.lit(1.0)), F.coalesce("text", F.lit("   "))))
    known = places.select(F.col("id").alias("geo_id"), "geom").where("geom.gtype = 'POINT'")
    pts = scored.join(known, "geo_id").withColumns({"x": F.col("geom.pts")[0]["x"], "y": F.col("geom.pts")[0]["y"]})
    grid = pts.withColumns({"gx": F.round(F.col("x") / 10), "gy": F.round(F.col("y") / 10)})
    once = _ranked(grid, ["msg_id", "gx", "gy"], F.desc("score"), F.col("geo_id"), F.col("text"))
    a = once.where("score >= 0.8").select("msg_id", F.col("geo_id").alias("a"), F.col("score").alias("sa"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = a.toDF("msg_id", "b", "sb", "bx", "by")
    gate = ((F.col("sa") >= 0.85) & (F.col("sb") >= 0.85)) | ((F.greatest("sa", "sb") >= 0.95) & (F.least("sa", "sb") >= 0.8))
    middles = a.join(b, "msg_id").where("a < b").where(gate).select("msg_id", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), (2 * F.col("sa") * F.col("sb") / (F.col("sa") + F.col("sb") + 0.001)).alias("pair"))
    c = middles.groupBy("msg_id").agg(F.avg("mx").alias("cx"), F.avg("my").alias("cy"), F.max("pair").alias("pair_score"))
    spread = middles.join(c, "msg_id").groupBy("msg_id").agg(F.max(geo.point_distance(F.col("mx"), F.col("my"), F.col("cx"), F.col("cy"))).alias("spread"), F.max("pair_score").alias("pair_score")).where(F.col("spread") <= scatter_m)
    best = _ranked(once.where(F.col("score") >= threshold), ["msg_id"], F.desc("score"), F.col("geo_id")).select("msg_id", "geo_id", "score")
    out = candidates.select("msg_id").distinct().join(spread, "msg_id", "left").join(best, "msg_id", "left")
    strategy = F.when(F.col("pair_score").isNotNull(), "weighted_centroid").when(F.col("geo_id").isNotNull(), "single_match").otherwise("random")
    return out.select("msg_id", strategy.alias("strategy"), F.when(strategy == "single_match", F.col("geo_id")).alias("geo_id"), F.coalesce("pair_score", F.col("score") * 0.4, F.lit(0.0)).alias("confidence"))
