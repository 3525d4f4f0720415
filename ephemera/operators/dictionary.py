"""The place dictionary: alias index, normalised keys, and idempotent synchronisation with a source table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import clean, tokens
from .lineage import cut, large

@dataclass(frozen=True)
class Normaliser:
    """How a language's words become stems: word ends that fall off, the letters that must remain, number words and ordinals' ends.

    Another language, or a morphology with a dictionary, is another instance or a subclass with its own stem.
    """

    endings: str = "(ing|ers|er|ed|es|s)$"
    least: int = 3
    numbers: tuple[tuple[str, str], ...] = (("first", "1"), ("second", "2"), ("third", "3"), ("fourth", "4"), ("fifth", "5"), ("sixth", "6"), ("seventh", "7"), ("eighth", "8"), ("ninth", "9"), ("tenth", "10"))
    ordinals: str = "st|nd|rd|th"

    def stem(self, word: Column) -> Column:
        """A word's stem: digits of number words and ordinals, else the word without its ending if enough letters remain."""
        return self.stem_of_lower(F.lower(word))

    def stem_of_lower(self, w: Column) -> Column:
        """A lower-case word's stem. In an array's lambda every mention is worked out anew, so a lower-case word comes as it is."""
        number = F.coalesce(*(F.when(w == k, F.lit(v)) for k, v in self.numbers), F.when(w.rlike(f"^[0-9]+({self.ordinals})$"), F.regexp_extract(w, "^[0-9]+", 0)))
        cut = F.regexp_replace(w, self.endings, "")
        return F.coalesce(number, F.when(F.length(cut) >= self.least, cut).otherwise(w))


ENGLISH = Normaliser()


def stem(word: Column, language: Normaliser = ENGLISH) -> Column:
    return language.stem(word)


def stems(text: Column, language: Normaliser = ENGLISH) -> Column:
    return word_stems(clean(text), language)


def word_stems(cleaned: Column, language: Normaliser = ENGLISH) -> Column:
    """The stems of a text that clean() has made: it is in lower case, and not empty just where it has a word."""
    own = type(language)
    # a subclass with another stem gets words as before
    return F.transform(tokens(cleaned), language.stem if own.stem is not Normaliser.stem else language.stem_of_lower)


def case_forms(index: DataFrame, forms: DataFrame, proper: DataFrame, most_forms: int = 8, most_products: int = 200, most: int = 50) -> DataFrame:
    """geo_id, alias, phrase: the spellings of each alias with a proper word, of every word's forms in turn.

    forms has word and form, proper has word; a word has itself and its first most_forms - 1 other forms. Aliases with
    more than most_products combinations have only themselves; of the others the first most in order of the alphabet stay.
    """
    index = large(cut(index.select("geo_id", "alias")))
    words = index.select("geo_id", "alias", F.posexplode(F.split("alias", " ")).alias("pos", "word"))
    named = words.join(proper.select("word").distinct(), "word", "left_semi").select("geo_id", "alias").distinct()
    own = forms.where("form <> word").groupBy("word").agg(F.slice(F.array_sort(F.collect_set("form")), 1, most_forms - 1).alias("others"))
    each = words.join(named, ["geo_id", "alias"], "left_semi").join(own, "word", "left").withColumn("options", F.concat(F.array("word"), F.coalesce("others", F.array().cast("array<string>"))))
    lists = each.groupBy("geo_id", "alias").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "options"))), lambda x: x["options"]).alias("options"))
    count = F.aggregate("options", F.lit(1), lambda n, x: n * F.size(x))
    product = F.aggregate("options", F.array(F.lit("")), lambda done, x: F.flatten(F.transform(done, lambda a: F.transform(x, lambda b: F.trim(F.concat(a, F.lit(" "), b))))))
    phrases = F.when(count > most_products, F.array("alias")).otherwise(F.slice(F.array_sort(F.array_distinct(product)), 1, most))
    return lists.select("geo_id", "alias", F.explode(phrases).alias("phrase"))


def canonical_rows(source: DataFrame, *values: str) -> DataFrame:
    """canonical and the values: one row for each canonical name, that of the smallest rn (or of the smallest values without one)."""
    own = F.struct(*[F.col(v).alias(v) for v in values])
    first = F.min_by(own, "rn") if "rn" in source.columns else F.min(own)
    return source.groupBy(F.element_at("names", 1).alias("canonical")).agg(first.alias("own")).select("canonical", "own.*")


def healed(table: DataFrame, source: DataFrame) -> DataFrame:
    """id, lon, lat, mx, my: places without a point take that of the source with their canonical name; metres follow.

    Of several source rows of a name the first that has a point counts.
    """
    new = canonical_rows(source.where("lon IS NOT NULL AND lat IS NOT NULL"), "lon", "lat").toDF("canonical", "_lon", "_lat")
    both = table.select("id", F.element_at("names", 1).alias("canonical"), "lon", "lat").join(new, "canonical", "left")
    found = both.select("id", F.coalesce("lon", "_lon").alias("lon"), F.coalesce("lat", "_lat").alias("lat"))
    return found.withColumns({"mx": geo.mercator_x(F.col("lon")), "my": geo.mercator_y(F.col("lat"))})


def aliases(places: DataFrame, language: Normaliser = ENGLISH) -> DataFrame:
    """geo_id, name, alias, stems, key, sorted_key: one row per alias of each place."""
    each = places.select(F.col("id").alias("geo_id"), F.element_at("names", 1).alias("name"), F.explode(F.transform("names", clean)).alias("alias"))
    # a condition on stems would have them worked out twice
    each = each.where(F.col("alias") != "").withColumn("stems", word_stems(F.col("alias"), language))
    return large(each.withColumns({"key": F.array_join("stems", " "), "sorted_key": F.array_join(F.array_sort("stems"), " ")}).distinct())


def word_objects(index: DataFrame) -> DataFrame:
    """In how many places' aliases each word occurs."""
    return index.select("geo_id", F.explode(F.split("alias", " ")).alias("word")).groupBy("word").agg(F.countDistinct("geo_id").alias("places"))


def replaced(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some places' aliases were replaced by those of changed."""
    new = aliases(changed)
    return index.join(changed.select(F.col("id").alias("geo_id")), "geo_id", "left_anti").unionByName(new)


def to_insert(table: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows (rn, names, ...) that share no alias with the table, nor with an earlier source row.

    Overlap of arrays is an equi-join on single aliases, never a comparison of all pairs.
    """
    alias = source.select("rn", F.explode("names").alias("alias"))
    known = table.select(F.explode("names").alias("alias")).distinct()
    taken = alias.join(known, "alias", "left_semi").select("rn")
    first = alias.groupBy("alias").agg(F.min("rn").alias("first"))
    later = alias.join(first, "alias").where("first < rn").select("rn")
    return source.join(taken.union(later).distinct(), "rn", "left_anti")


def merged_aliases(table: DataFrame, source: DataFrame) -> DataFrame:
    """id, names after the source's missing aliases were appended, in order, to the place with the same canonical name."""
    own = table.select("id", "names", F.element_at("names", 1).alias("canonical"))
    new = source.select(F.element_at("names", 1).alias("canonical"), F.explode("names").alias("alias")).join(own.select("id", "canonical", "names"), "canonical").where(~F.array_contains("names", F.col("alias")))
    more = new.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("more"))
    return own.join(more, "id").select("id", F.concat("names", "more").alias("names"))


def type_fixes(table: DataFrame, source: DataFrame) -> DataFrame:
    """id, type of places whose type differs, null-safely, from that of the source's first row of the same canonical name."""
    new = canonical_rows(source, "type").withColumnRenamed("type", "new")
    return table.select("id", "type", F.element_at("names", 1).alias("canonical")).join(new, "canonical").where(~F.col("type").eqNullSafe(F.col("new"))).select("id", F.col("new").alias("type"))


def synchronised(table: DataFrame, source: DataFrame) -> DataFrame:
    """The table (id, names, type) after inserts, alias merges and type fixes; a second run changes nothing.

    Inserted rows get ids after the greatest, in source order.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = to_insert(table, source).join(F.broadcast(top))
    inserted = fresh.select((F.col("top") + F.col("rn")).alias("id"), "names", "type")
    names = merged_aliases(table, source).withColumnRenamed("names", "new_names")
    types = type_fixes(table, source).withColumnRenamed("type", "new_type").withColumn("fixed", F.lit(True))
    kept = table.select("id", "names", "type").join(names, "id", "left").join(types, "id", "left")
    return kept.select("id", F.coalesce("new_names", "names").alias("names"), F.when(F.col("fixed"), F.col("new_type")).otherwise(F.col("type")).alias("type")).unionByName(inserted)


def sync_report(table: DataFrame, source: DataFrame) -> DataFrame:
    """How many source rows have no place of their canonical name, and how many are present."""
    known = table.select(F.element_at("names", 1).alias("canonical")).distinct().withColumn("there", F.lit(1))
    return source.select(F.element_at("names", 1).alias("canonical")).join(known, "canonical", "left").agg(F.count_if(F.col("there").isNull()).alias("unmatched"), F.count("there").alias("present"))
