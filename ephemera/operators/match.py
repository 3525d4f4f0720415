"""Linking text to places: exact, reordered, partial and typo-tolerant matching of n-grams against the alias index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import partial_ratio_of, ratio_of
from ..functions.text import clean
from .dictionary import word_objects, word_stems
from .lineage import cut, large, spread
from .typo import nearest_typos

#: Least score of a typo match; the boost of an anchored candidate and the score it reaches at most; entities of a message.
TYPO, BOOST, BOOSTED, MOST = 0.9, 0.05, 0.85, 5
#: Place types whose short names are never matched with typos, and how short.
SETTLEMENTS, SHORT = ("village", "town"), 6


def surfaces(grams: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """Distinct surfaces of n-grams with their stems and keys; stop phrases are left out."""
    once = grams.select("surface").distinct()
    if stop is not None:
        once = once.join(stop.select("surface"), "surface", "left_anti")
    # distinct surfaces are few bytes and much work; a condition on stems would have them worked out twice
    each = spread(once, "surface").select("surface", F.explode(F.array(clean(F.col("surface")))).alias("cleaned")).where(F.col("cleaned") != "")
    s = each.select("surface", word_stems(F.col("cleaned")).alias("stems"))
    return large(s).withColumns({"key": F.array_join("stems", " "), "sorted_key": F.array_join(F.array_sort("stems"), " ")})


def guarded(found: DataFrame, other_words: DataFrame, index: DataFrame) -> DataFrame:
    """Surfaces of one word that is no name (other_words: word) go, unless some alias has their stem."""
    found = large(cut(found))
    known = index.select(F.explode("stems").alias("stem")).distinct()
    stop = found.where(F.size("stems") == 1).join(other_words.select(F.col("word").alias("surface")), "surface", "left_semi").select("surface", F.col("stems")[0].alias("stem"))
    return found.join(stop.join(known, "stem", "left_anti").select("surface"), "surface", "left_anti")


def known_surfaces(found: DataFrame, index: DataFrame) -> DataFrame:
    """Surfaces all of whose stems some alias has: others can only be typos, so the exact tiers need not see them."""
    known = index.select(F.explode("stems").alias("stem")).distinct()
    each = found.select("surface", F.explode(F.array_distinct("stems")).alias("stem")).join(known, "stem", "left_anti").select("surface").distinct()
    return found.join(each, "surface", "left_anti")


def exact(found: DataFrame, index: DataFrame) -> DataFrame:
    return found.join(index.select("geo_id", "name", "alias", "key"), "key").select("surface", "geo_id", "name", "alias", F.lit("stem_exact").alias("source"))


def reordered(found: DataFrame, index: DataFrame) -> DataFrame:
    many = found.where(F.size("stems") >= 2)
    return many.join(index.select("geo_id", "name", "alias", "sorted_key"), "sorted_key").select("surface", "geo_id", "name", "alias", F.lit("stem_reorder").alias("source"))


def partial(found: DataFrame, index: DataFrame, generic: tuple[str, ...] = ("street", "road", "park")) -> DataFrame:
    """One-word surfaces that are part of a longer alias none of whose words is generic or shared by places."""
    one = found.where((F.size("stems") == 1) & (F.length("surface") >= 4)).select("surface", F.col("stems")[0].alias("stem"))
    shared = word_objects(index).where("places >= 2").select("word")
    words = index.where(F.size("stems") >= 2).select("geo_id", "name", "alias", "stems").withColumn("word", F.explode(F.split("alias", " ")))
    bad = words.where(F.col("word").isin(*generic)).select("geo_id", "alias").union(words.join(shared, "word", "left_semi").select("geo_id", "alias")).distinct()
    good = index.where(F.size("stems") >= 2).join(bad, ["geo_id", "alias"], "left_anti").select("geo_id", "name", "alias", F.explode(F.array_distinct("stems")).alias("stem"))
    pairs = one.join(good, "stem")
    return pairs.where(partial_ratio_of("surface", "alias") >= 0.95).select("surface", "geo_id", "name", "alias", F.lit("stem_subset").alias("source"))


def typos(found: DataFrame, index: DataFrame, types: DataFrame, least: float = TYPO) -> DataFrame:
    """Surfaces of five letters or more with the most similar alias that begins alike and is about as long.

    Pairs come from the join of near strings, which never lists all pairs that begin alike, nor those of a surface that has a nearer alias. The guards (first letters,
    lengths, no short names of settlements) come before the choice of the best; of equal ones the smallest place.
    """
    settled = types.where(F.col("type").isin(*SETTLEMENTS)).select("geo_id")
    short = index.join(settled, "geo_id", "left_semi").where(F.length("alias") <= SHORT).select("geo_id", "alias")
    # places of one alias score alike, so that one stands for all
    names = large(cut(index.join(short, ["geo_id", "alias"], "left_anti").groupBy("alias").agg(F.min(F.struct("geo_id", "name")).alias("place"))))
    scored = nearest_typos(found.select(F.col("surface").alias("query")), names.select(F.col("alias").alias("name")), least)
    scored = scored.join(names, F.col("name") == F.col("alias")).select(F.col("query").alias("surface"), "place.geo_id", "place.name", "alias", "score")
    best = scored.groupBy("surface").agg(F.max_by(F.struct("geo_id", "name", "alias", "score"), F.struct("score", -F.col("geo_id"))).alias("b"))
    return best.select("surface", "b.*", F.lit("surface_typo").alias("source"))


def linked_surfaces(found: DataFrame, index: DataFrame, types: DataFrame) -> DataFrame:
    """surface, geo_id, name, score, source: each surface's best place. Each tier sees only what the earlier ones left."""
    found, index = large(cut(found)), large(cut(index))
    known = known_surfaces(found, index)
    a = large(cut(exact(known, index)))
    known = known.join(a.select("surface"), "surface", "left_anti")
    b = large(cut(reordered(known, index)))
    c = large(cut(partial(known.join(b.select("surface"), "surface", "left_anti"), index)))
    rest = found.join(a.select("surface").union(b.select("surface")).union(c.select("surface")).distinct(), "surface", "left_anti")
    hits = a.unionByName(b).unionByName(c).withColumns({"r": ratio_of("surface", "alias"), "p": partial_ratio_of("surface", "alias")})
    best = hits.groupBy("surface").agg(F.max_by(F.struct("geo_id", "name", "source", "r", "p"), F.struct("r", "p", -F.col("geo_id"))).alias("b"))
    first = best.select("surface", "b.geo_id", "b.name", F.greatest(F.col("b.r"), F.col("b.p") * 0.85).alias("score"), "b.source")
    return cut(first.unionByName(typos(rest, index, types).drop("alias")))


def link(grams: DataFrame, key: str, linked: DataFrame, most: int = MOST) -> DataFrame:
    """key, geo_id, name, surface, score, source, rank: the places of each message.

    Anchored candidates below BOOSTED gain BOOST; each place counts once with its best score; a match within a longer
    one of the same segment goes; the rest is ranked by score, then length, then id.
    """
    hits = large(grams).join(large(linked), "surface")
    order = Window.partitionBy(key, "geo_id").orderBy(F.desc("score"), "segment", "first", F.desc("n"))
    once = hits.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    gain = F.when(F.col("anchored") & (F.col("score") < BOOSTED), F.least(F.lit(BOOSTED), F.col("score") + BOOST)).otherwise(F.col("score"))
    once = large(cut(once.withColumn("score", gain)))
    wide = once.select(key, "segment", F.col("first").alias("f2"), F.col("n").alias("n2"))
    covered = once.join(wide, [key, "segment"]).where((F.col("f2") <= F.col("first")) & (F.col("first") + F.col("n") <= F.col("f2") + F.col("n2")) & (F.col("n2") > F.col("n"))).select(key, "geo_id")
    kept = once.join(covered.distinct(), [key, "geo_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("n"), "geo_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "geo_id", "name", "surface", "score", "source", "rank")


def tier(linked: DataFrame, key: str) -> DataFrame:
    """key, tier of each message with a match: 1 with an exact or reordered one, else 2 with a typo, else none."""
    sources = linked.groupBy(key).agg(F.collect_set("source").alias("s"))
    any_of = lambda *names: F.arrays_overlap("s", F.array(*map(F.lit, names)))
    return sources.select(key, F.when(any_of("stem_exact", "stem_reorder"), "tier1").when(any_of("surface_typo"), "tier2").otherwise("none").alias("tier"))


def first_segment_or_general(segments: DataFrame, general: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """key, geo_id, path: the first address segment (by no) whose score reaches least, else the general match."""
    order = Window.partitionBy(key).orderBy("no")
    fast = segments.where(F.col("score") >= least).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select(key, F.col("geo_id").alias("fast"))
    return general.select(key, F.col("geo_id").alias("slow")).join(fast, key, "full_outer").select(key, F.coalesce("fast", "slow").alias("geo_id"), F.when(F.col("fast").isNotNull(), "fast").otherwise("general").alias("path"))
