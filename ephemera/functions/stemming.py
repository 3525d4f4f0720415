"""Stems and lemmas of distinct words: staged suffix rules as columns, and endings learned from a table of word forms.

Both work on a table of words, each once, which is joined back to wherever the words came from; no Python sees a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the Snowball project's published English stemmer.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
PREFIXES = ("gener", "commun", "arsen")
SECOND = (
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"),
    ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", ""),
)
THIRD = (("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWEL, OTHER, DOUBLED = "[aeiouy]", "[^aeiouy]", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"
SHORT = rf"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _cut(w: Column, letters: int | Column, more: str = "") -> Column:
    left = F.substring(w, F.lit(1), F.length(w) - letters)
    return F.concat(left, F.lit(more)) if more else left


def _longest(w: Column, rules: dict[str, Column]) -> Column:
    """The outcome of the longest suffix that w has; w without any."""
    ordered = sorted(rules, key=len, reverse=True)
    return reduce(lambda out, s: out.when(w.endswith(s), rules[s]), ordered[1:], F.when(w.endswith(ordered[0]), rules[ordered[0]])).otherwise(w)


def english_stems(words: DataFrame) -> DataFrame:
    """word, stem of each distinct word: the published rules, a stage after the other, within the regions that they name.

    Words are taken in lower case. Those of two letters, null ones and empty ones are their own stems.
    """
    w, r1, r2 = F.col("w"), F.col("r1"), F.col("r2")
    inside = lambda region, s: F.length(w) - len(s) >= region
    rows = words.select("word").distinct().withColumn("low", F.lower("word")).withColumn("w", F.regexp_replace("low", "^'", ""))
    rows = rows.withColumn("w", F.regexp_replace(F.regexp_replace("w", "^y", "Y"), "([aeiouy])y", "$1Y"))
    first = F.length(F.regexp_extract(w, rf"^.*?{VOWEL}{OTHER}", 0))
    start = F.coalesce(*[F.when(w.startswith(p), F.lit(len(p))) for p in PREFIXES], F.when(first > 0, first), F.length(w))
    rows = rows.withColumn("r1", start)
    second = F.length(F.regexp_extract(F.substring(w, r1 + 1, F.length(w)), rf"^.*?{VOWEL}{OTHER}", 0))
    rows = rows.withColumn("r2", F.when(second > 0, r1 + second).otherwise(F.length(w)))
    rows = rows.withColumn("w", F.regexp_replace(w, "('s'|'s|')$", ""))
    plural = {
        "sses": _cut(w, 2), "ied": F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)), "ies": F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1)),
        "us": w, "ss": w, "s": F.when(w.rlike(rf"{VOWEL}.+s$"), _cut(w, 1)).otherwise(w),
    }
    rows = rows.withColumn("w", _longest(w, plural)).withColumn("kept", w.isin(*KEPT))
    tense = {s: F.when(inside(r1, s), _cut(w, len(s), "ee")).otherwise(w) for s in ("eed", "eedly")} | {s: F.when(_cut(w, len(s)).rlike(VOWEL), F.concat(_cut(w, len(s)), F.lit("*"))).otherwise(w) for s in ("ed", "edly", "ing", "ingly")}
    rows = rows.withColumn("w", _longest(w, tense))
    # a star stands where an ending fell off, until what is left is mended
    bare = _cut(w, 1)
    mended = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike(DOUBLED), _cut(w, 2)).when((r1 >= F.length(bare)) & bare.rlike(SHORT), F.concat(bare, F.lit("e"))).otherwise(bare)
    rows = rows.withColumn("w", F.when(w.endswith("*"), mended).otherwise(w))
    rows = rows.withColumn("w", F.when(w.rlike(rf".{OTHER}[yY]$"), _cut(w, 1, "i")).otherwise(w))
    more = {"ogi": w.endswith("logi"), "li": w.rlike("[cdeghkmnrt]li$")}
    rows = rows.withColumn("w", _longest(w, {s: F.when(inside(r1, s) & more.get(s, F.lit(True)), _cut(w, len(s), to)).otherwise(w) for s, to in SECOND}))
    rows = rows.withColumn("w", _longest(w, {s: F.when(inside(r2 if s == "ative" else r1, s), _cut(w, len(s), to)).otherwise(w) for s, to in THIRD}))
    rows = rows.withColumn("w", _longest(w, {s: F.when(inside(r2, s) & (w.rlike("[st]ion$") if s == "ion" else F.lit(True)), _cut(w, len(s))).otherwise(w) for s in FOURTH}))
    last = (F.length(w) - 1 >= r2) | ((F.length(w) - 1 >= r1) & ~_cut(w, 1).rlike(SHORT))
    rows = rows.withColumn("w", F.when(w.endswith("e"), F.when(last, _cut(w, 1)).otherwise(w)).when(w.endswith("ll") & (F.length(w) - 1 >= r2), _cut(w, 1)).otherwise(w))
    special = F.coalesce(*[F.when(F.col("low") == k, F.lit(v)) for k, v in EXCEPTIONS.items()], F.when(F.col("kept"), _before_kept()), F.when(F.length("low") <= 2, F.col("low")))
    return rows.select("word", F.coalesce(special, F.lower(w)).alias("stem"))


def _before_kept() -> Column:
    """The kept word that a word is, or was before its plural ending went."""
    return F.coalesce(*[F.when(F.col("low").startswith(k), F.lit(k)) for k in KEPT])


def add_stems(rows: DataFrame, column: str, stems: DataFrame, name: str = "stems") -> DataFrame:
    """rows with the stems of an array column's words, in order; each distinct word is stemmed once and joined back.

    A word that stems(word, stem) does not know stands for itself.
    """
    numbered = rows.withColumn("_row", F.struct(*[F.col(c) for c in rows.columns])).select("_row", F.monotonically_increasing_id().alias("_id"))
    each = numbered.select("_id", "_row", F.posexplode_outer(F.col("_row")[column]).alias("_pos", "word"))
    found = each.join(stems.select("word", "stem"), "word", "left").groupBy("_id").agg(F.first("_row").alias("_row"), F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("_pos", F.coalesce("stem", "word").alias("s"))))).alias("_s"))
    return found.select("_row.*", F.transform("_s", lambda x: x["s"]).alias(name))


def learned_endings(forms: DataFrame, most: int = 5) -> DataFrame:
    """ending, off, put, pos: for each ending of known forms(form, lemma, pos) what most of them do to become lemmas.

    off letters go from a form's end and put is put there; of equally common ways the first in order counts. Endings are
    kept together with as many letters as they say something about, most at the longest: the paths of a trie from a
    word's end, one row each.
    """
    same = F.length(F.regexp_extract(F.concat("form", F.lit("\n"), "lemma"), r"^(.*).*\n\1.*$", 1))
    ways = forms.select("form", "pos", (F.length("form") - same).alias("off"), F.substring("lemma", same + 1, F.length("lemma")).alias("put"))
    ends = ways.select("off", "put", "pos", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.length("form"))), lambda n: F.struct(n.alias("n"), F.right(F.col("form"), n).alias("ending")))).alias("e"))
    counted = ends.where("e.n >= off").groupBy("e.ending", "off", "put", "pos").agg(F.count("*").alias("times"))
    return counted.groupBy("ending").agg(F.min_by(F.struct("off", "put", "pos"), F.struct(-F.col("times"), F.col("off"), F.col("put"), F.col("pos"))).alias("x")).select("ending", "x.*")


def lemmas(words: DataFrame, forms: DataFrame, most: int = 5) -> DataFrame:
    """word, lemma, pos, known of each distinct word: from the table of forms, or else by the longest ending it teaches.

    Of several entries of a form the first in order of lemma and part of speech counts. Without any form to learn from a
    word is its own lemma, of no part of speech.
    """
    once = words.select("word").where("word IS NOT NULL").distinct()
    table = forms.groupBy("form").agg(F.min(F.struct("lemma", "pos")).alias("own"))
    ends = once.select("word", F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.length("word"))), lambda n: F.struct(n.alias("n"), F.right(F.col("word"), n).alias("ending")))).alias("e")).select("word", "e.*")
    best = ends.join(learned_endings(forms, most), "ending").groupBy("word").agg(F.max_by(F.struct("off", "put", "pos"), "n").alias("x"))
    found = once.join(table, once["word"] == table["form"], "left").join(best, "word", "left")
    guess = F.concat(F.substring("word", F.lit(1), F.length("word") - F.col("x.off")), F.col("x.put"))
    known = F.col("own").isNotNull()
    return found.select("word", F.when(known, F.col("own.lemma")).otherwise(F.coalesce(guess, F.col("word"))).alias("lemma"), F.when(known, F.col("own.pos")).otherwise(F.col("x.pos")).alias("pos"), known.alias("known"))
