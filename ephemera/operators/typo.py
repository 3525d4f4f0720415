"""A join of strings that are nearly equal, by equi-joins on what remains of them when letters or words are taken out.

Letters: the strings of a pair whose longest common subsequence is long enough become equal when each loses some letters,
and how many follows from the two lengths alone. So a string is unfolded to its variants of so many letters less, for each
length that the other side has, and equal variants meet. However many strings begin alike, only near ones share a variant.
Where variants would be too many (long strings), the rarest of the name's parts are joined instead, as many as edits cannot all reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import WINDOW, WORDS, weighted_ratio_of
from .lineage import cut, large, spread

#: Variants of one string and length at most, and of an arrangement of words; beyond that, pairs are met by a part.
VARIANTS, ARRANGED_VARIANTS = 1000, 100
#: Letters at the front that must agree, least length of a query, and words left out on either side at most.
HEAD, LEAST_LETTERS, DROPPED = 3, 5, 3


def room(n: Column) -> Column:
    """By how much the length of a name may differ from a query's n letters: a fifth, two at least; from ten letters on a quarter, three at least."""
    return F.when(n >= 10, F.greatest(F.lit(3), F.floor(n * 0.25))).otherwise(F.greatest(F.lit(2), F.floor(n * 0.2))).cast("int")


def without_letters(s: Column, k: int, head: int) -> Column:
    """The distinct strings that remain of s when k letters behind the first head go."""
    out = F.array(s)
    for _ in range(k):
        out = F.array_distinct(F.flatten(F.transform(out, lambda v: F.transform(F.sequence(F.lit(head + 1), F.length(v)), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v)))))))
    return out


def ways(letters: Column, k: Column) -> Column:
    """In how many ways k of the letters can go; null, as for too many, beyond three."""
    n = letters.cast("double")
    return F.when(k == 0, F.lit(1.0)).when(k == 1, n).when(k == 2, n * (n - 1) / 2).when(k == 3, n * (n - 1) * (n - 2) / 6)


def plan(queries: DataFrame, names: DataFrame, rate: float, head: int, most: int = VARIANTS, nearest: int | None = None) -> DataFrame:
    """n, m, edits, a, b, whole: a row for each two lengths that can be near; the query loses a letters, the name b.

    edits bounds the letters that are not common: rate of both lengths, and nearest if it is given. Fewer than a and b are
    never needed: a pair with more in common is still equal with more letters gone.
    """
    n = queries.select(F.length("s").alias("n")).distinct()
    m = names.select(F.length("s").alias("m")).distinct()
    edits = F.floor((F.col("n") + F.col("m")) * rate + 1e-9).cast("int")
    edits = edits if nearest is None else F.least(edits, F.lit(nearest))
    each = n.select("n", F.explode(F.sequence(F.greatest(F.lit(max(head, 1)), F.col("n") - room(F.col("n"))), F.col("n") + room(F.col("n")))).alias("m"))
    near = each.join(m, "m").withColumn("edits", edits).where((F.abs(F.col("n") - F.col("m")) <= F.col("edits")) & (F.col("n") >= head))
    a = F.floor((F.col("edits") - F.col("m") + F.col("n")) / 2).cast("int")
    over = F.greatest(F.lit(0), F.col("a") - (F.col("n") - head), F.col("b") - (F.col("m") - head))
    sized = near.withColumn("a", a).withColumn("b", F.col("a") + F.col("m") - F.col("n")).withColumn("over", over)
    sized = sized.select("n", "m", "edits", (F.col("a") - F.col("over")).alias("a"), (F.col("b") - F.col("over")).alias("b")).where("a >= 0 AND b >= 0")
    few = lambda c, k: F.coalesce(ways(F.col(c) - head, F.col(k)) <= most, F.lit(False))
    return sized.withColumn("whole", few("n", "a") & few("m", "b"))


def _variants(side: DataFrame, lengths: DataFrame, own: str, k: str, head: int) -> DataFrame:
    rows = side.withColumn(own, F.length("s")).join(F.broadcast(lengths.where("whole")), own)
    gone = F.when(F.col(k) == 0, without_letters(F.col("s"), 0, head))
    for i in (1, 2, 3):
        gone = gone.when(F.col(k) == i, without_letters(F.col("s"), i, head))
    return rows.select("id", "n", "m", F.explode(F.transform(gone, lambda v: F.xxhash64(v))).alias("key"))


def _parts(side: DataFrame, lengths: DataFrame, own: str, head: int, shifted: bool) -> DataFrame:
    """Half as many parts again of a name as edits can reach, or what a query has there and up to edits letters beside it."""
    rows = side.withColumn(own, F.length("s")).join(F.broadcast(lengths.where("NOT whole")), own)
    rows = rows.withColumn("parts", F.col("edits") + 1 + F.floor((F.col("edits") + 2) / 2).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    begin = lambda p: F.floor(p * F.col("m") / F.col("parts")).cast("int")
    shift = F.explode(F.sequence(-F.col("edits"), F.col("edits"))) if shifted else F.lit(0)
    rows = rows.withColumns({"at": begin(F.col("part")), "size": begin(F.col("part") + 1) - begin(F.col("part"))}).withColumn("shift", shift)
    rows = rows.where((F.col("at") + F.col("shift") >= 0) & (F.col("at") + F.col("shift") + F.col("size") <= F.length("s")))
    piece = F.substring("s", F.col("at") + F.col("shift") + 1, F.col("size"))
    return rows.select("id", "n", "m", "edits", F.xxhash64("part", "edits", F.substring("s", 1, head), piece).alias("key"))


def _rarest(parts: DataFrame) -> DataFrame:
    """Of each name's parts one more than edits can reach, those that the fewest names have: one of them is whole in a near query."""
    often = parts.groupBy("n", "m", "key").agg(F.count("*").alias("names"))
    each = large(parts).join(often, ["n", "m", "key"]).groupBy("id", "n", "m", "edits").agg(F.array_sort(F.collect_list(F.struct("names", "key"))).alias("found"))
    return each.select("id", "n", "m", F.explode(F.slice("found", F.lit(1), F.col("edits") + 1)).alias("x")).select("id", "n", "m", "x.key")


def near_letters(queries: DataFrame, names: DataFrame, rate: float, head: int, most: int = VARIANTS, nearest: int | None = None) -> DataFrame:
    """q, t: ids of all pairs (id, s) whose letters outside a longest common subsequence are at most rate of both lengths
    (and at most nearest), with head equal letters in front and lengths within room. Pairs met by a part may be further apart.
    """
    lengths = cut(plan(queries, names, rate, head, most, nearest))
    # lengths are few, what they make of the strings is not
    named = lambda df, side: large(df.withColumnRenamed("id", side))
    whole = named(_variants(queries, lengths, "n", "a", head), "q").join(named(_variants(names, lengths, "m", "b", head), "t"), ["n", "m", "key"])
    part = named(_parts(queries, lengths, "n", head, True), "q").join(named(_rarest(cut(_parts(names, lengths, "m", head, False))), "t"), ["n", "m", "key"])
    return whole.select("q", "t").union(part.select("q", "t")).distinct()


def arranged(side: DataFrame) -> DataFrame:
    """id, rest, gone, full: each string's words in order, parted in those that stay and at most DROPPED that do not.

    Words count as often as they occur; full is the length of all together.
    """
    words = F.array_sort(F.filter(F.split("s", " "), lambda w: w != ""))
    part = lambda rest, gone: F.struct(rest.alias("rest"), gone.alias("gone"))
    fewer = lambda x: F.transform(F.sequence(F.lit(1), F.size(x["rest"])), lambda i: part(F.filter(x["rest"], lambda w, k: k != i - 1), F.array_sort(F.concat(x["gone"], F.array(F.element_at(x["rest"], i))))))
    out = level = F.array(part(F.col("words"), F.array().cast("array<string>")))
    for _ in range(DROPPED):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.size(x["rest"]) > 1), fewer)))
        out = F.concat(out, level)
    each = side.select("id", words.alias("words")).where(F.size("words") > 0).select("id", F.length(F.array_join("words", " ")).alias("full"), F.explode(out).alias("x"))
    return each.select("id", F.array_join("x.rest", " ").alias("rest"), F.array_join("x.gone", " ").alias("gone"), "full")


def near_words(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """q, t: pairs whose common words are all of one side, or make up least of it by ratio, the rest within room.

    queries and names are arranged. No more letters go than a pair within room can lose.
    """
    most = 3 + F.floor(F.col("full") * (0.25 + 2 * (1 / least - 1)))
    q, t = (side.withColumn("lost", F.col("full") - F.length("rest")).where(F.col("lost") <= most) for side in (queries, names))
    met = q.select(F.col("id").alias("q"), "rest", F.col("lost").alias("lq")).join(t.select(F.col("id").alias("t"), "rest", F.col("lost").alias("lt")), "rest")
    size = F.length("rest")
    return met.where(2 * size >= least * (2 * size + F.least("lq", "lt"))).select("q", "t").distinct()


def joined(side: DataFrame) -> DataFrame:
    """id, s: the words that stay, then the others; differences in single words stand at the end."""
    return side.select("id", F.when(F.col("gone") == "", F.col("rest")).otherwise(F.concat_ws(" ", "rest", "gone")).alias("s")).distinct()


def within(queries: DataFrame, names: DataFrame) -> DataFrame:
    """q, t: names of HEAD letters or one more that stand whole in a query at least half as long again, within room."""
    parts = queries.withColumn("n", F.length("s")).select("id", F.explode(F.sequence(F.lit(HEAD), F.floor(F.col("n") / 1.5).cast("int"))).alias("size"), "s", "n")
    parts = parts.where(F.col("n") - F.col("size") <= room(F.col("n")))
    pieces = parts.select(F.col("id").alias("q"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda i: F.substring("s", i, F.col("size")))).alias("s")).distinct()
    return pieces.join(names.select(F.col("id").alias("t"), "s"), "s").select("q", "t")


def _sides(queries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, s of the distinct strings on either side that begin as, and are about as long as, one of the other side."""
    each = lambda df, c, least: df.where(F.length(c) >= least).select(F.col(c).alias("s")).distinct().select("s", F.xxhash64("s").alias("id"), F.substring("s", 1, HEAD).alias("head"), F.length("s").alias("n"))
    q, t = large(cut(each(queries, "query", LEAST_LETTERS))), large(cut(each(names, "name", HEAD)))
    sizes = lambda df: df.select("head", "n").distinct()
    reach = sizes(q).select("head", F.col("n").alias("own"), F.explode(F.sequence(F.col("n") - room(F.col("n")), F.col("n") + room(F.col("n")))).alias("n"))
    both = cut(reach.join(sizes(t), ["head", "n"]))
    kept = lambda df, c: large(cut(df.join(F.broadcast(both.select("head", F.col(c).alias("n")).distinct()), ["head", "n"], "left_semi").select("s", "id")))
    return kept(q, "own"), kept(t, "n")


def _scored(found: DataFrame, q: DataFrame, t: DataFrame, least: float) -> DataFrame:
    """query, name, score of the found pairs (q, t) that are near, each once."""
    both = large(found.distinct()).join(q.select(F.col("id").alias("q"), F.col("s").alias("query")), "q").join(t.select(F.col("id").alias("t"), F.col("s").alias("name")), "t")
    both = both.where((F.substring("query", 1, HEAD) == F.substring("name", 1, HEAD)) & (F.abs(F.length("query") - F.length("name")) <= room(F.length("query"))))
    # few bytes a pair, but much work: spread over all cores
    pairs = spread(both.select("query", "name").distinct(), "query", "name")
    return pairs.withColumn("score", weighted_ratio_of("query", "name")).where(F.col("score") >= least)


def _pairs(q: DataFrame, t: DataFrame, least: float) -> DataFrame:
    of_words = 1 - least / WORDS
    by_words = [large(cut(arranged(side))) for side in (q, t)]
    found = near_letters(q, t, 1 - least, HEAD).union(near_letters(*map(joined, by_words), of_words, 0, ARRANGED_VARIANTS)).union(near_words(*by_words, least / WORDS))
    if least == WINDOW:
        found = found.union(within(q, t))
    return _scored(found, q, t, least)


def typo_pairs(queries: DataFrame, names: DataFrame, least: float = 0.9) -> DataFrame:
    """query, name, score of all pairs of distinct strings in queries(query) and names(name) that are near.

    Near means: HEAD equal letters in front, lengths within room, at least LEAST_LETTERS letters in the query, and a weighted ratio of at
    least least, which must be 0.9 or more (below that, other measures come into play). Nulls match nothing. Up to DROPPED
    words of a side may differ from the other's where words count; longer strings could differ in more short words.
    """
    if least < WINDOW:
        raise ValueError(f"least must be {WINDOW} or more")
    return _pairs(*_sides(queries, names), least)


def nearest_typos(queries: DataFrame, names: DataFrame, least: float = 0.9) -> DataFrame:
    """query, name, score: of each query's rows in typo_pairs all with its greatest score, and perhaps others.

    Numbered names have many near ones, and more the more there are, of which one is meant. So pairs that are one letter
    apart come first. What they leave out is two letters apart or more, or near by its words alone, which bounds its score:
    only queries that have nothing better than that go on to all pairs.
    """
    if least < WINDOW:
        raise ValueError(f"least must be {WINDOW} or more")
    q, t = _sides(queries, names)
    first = large(cut(_scored(near_letters(q, t, 1 - least, HEAD, nearest=1), q, t, least)))
    n = F.length("query")
    settled = first.where(F.col("score") > F.greatest(F.lit(max(WORDS, WINDOW)), 1 - 2 / (2 * n + room(n))))
    rest = q.join(settled.select(F.col("query").alias("s")).distinct(), "s", "left_anti").select("s")
    return settled.unionByName(_pairs(*_sides(rest.withColumnRenamed("s", "query"), t.select(F.col("s").alias("name"))), least))
