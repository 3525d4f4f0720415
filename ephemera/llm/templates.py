"""Line dedup with a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, written

#: Leading tokens on a path of the tree, below the level of the token count.
DEPTH = 3
#: A template keeps tokens at this share of its positions at least, those of its path among them.
SIMILARITY = 0.6
#: So many of a leaf's masks that hold the template's rarest token must follow the template.
CONSTANT = 0.5
#: A template that this many documents hold is recurring; lines of PASSAGE words or more are so in PASSAGE_DOCS documents.
MIN_DOCS, PASSAGE, PASSAGE_DOCS = 3, 50, 2
WILD = "<*>"


def masked(line: Column) -> Column:
    """Tokens between runs of ASCII white space, with the wild card for each run of digits in them.

    A line without a letter stays as it stands, as little but digits would be left of it; null for one without tokens.
    Most lines need no rewriting, and are only tested.
    """
    spaced = F.trim(F.regexp_replace(line, r"[ \t\r\x0B\f]+", " "))
    wild = F.when(spaced.rlike(r"\p{L}"), F.regexp_replace(spaced, "[0-9]+", WILD)).otherwise(spaced)
    return F.nullif(F.when(line.rlike(r"[0-9\t\r\x0B\f]|  "), wild).otherwise(F.trim(line)), F.lit(""))


def spaced(text: Column) -> Column:
    """A text with one space for each run of white space within its lines. Most texts need no rewriting, and are only tested."""
    runs = F.contains(text, F.lit("  "))
    for c in "\t\r\x0b\f":
        runs = runs | F.contains(text, F.lit(c))
    return F.when(runs, F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")).otherwise(text)


def masks(text: Column) -> Column:
    """The masked lines, as of masked(), of a text from spaced(); they end at line feeds.

    Digits are sought in the whole text at once, which takes a part of the time that it takes line by line.
    """
    own = lambda line, wild: F.nullif(F.trim(F.when((line == wild) | line.rlike(r"\p{L}"), wild).otherwise(line)), F.lit(""))
    return F.zip_with(F.split(text, "\n", -1), F.split(F.regexp_replace(text, "[0-9]+", WILD), "\n", -1), own)


def n_tokens(mask: Column) -> Column:
    return F.length(mask) - F.length(F.replace(mask, F.lit(" "), F.lit(""))) + 1


def path(mask: Column, n: Column | None = None) -> Column:
    """The path to a line's leaf: the number of its tokens (n, if it is there already), then the first DEPTH of them."""
    return F.concat_ws(" ", (n_tokens(mask) if n is None else n).cast("string"), F.substring_index(mask, " ", DEPTH))


def lines_of(docs: DataFrame, key: str) -> DataFrame:
    """key, line_no, h1, h2, path, long of each line with tokens: 128 bits of its mask and 64 of its path, without text.

    Everything about a line is worked out before the lines are unfolded, once.
    """
    known = docs.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, spaced(F.col("text")).alias("_spaced"))
    # a lambda works out each mention anew: what is used twice is a field before
    counted = F.transform(masks(F.col("_spaced")), lambda m: F.struct(m.alias("mask"), n_tokens(m).alias("n")))
    own = lambda m, n: F.struct(F.xxhash64(m).alias("h1"), F.xxhash64(F.lit(1), m).alias("h2"), F.xxhash64(path(m, n)).alias("path"), (n >= PASSAGE).alias("long"))
    hashed = F.transform(counted, lambda x: F.when(x["mask"].isNotNull(), own(x["mask"], x["n"])))
    return known.select(key, F.posexplode(hashed).alias("line_no", "m")).where("m IS NOT NULL").select(key, "line_no", "m.*")


def generalised(spark: SparkSession, docs: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """h1, h2, g1, g2: masks that fall under a generalised template of their leaf, and that template's hash.

    Only leaves with more than one distinct mask can generalise; only their masks' text is fetched, once each. In a leaf
    each token of each position (behind the path) is counted over the masks. A mask may give up its rarest tokens, down
    to the share SIMILARITY: each way of keeping those of some count and above is a template, with wild cards for the
    rest. A template stands if at least two masks, and the share CONSTANT of those that hold its rarest token, come to
    it; each mask falls under the one of its templates that most masks share (of these the one with the fewest tokens).
    So a leaf has as many templates as it has families of lines, and lines that only share common words have none.
    Masks of DEPTH + 1 tokens or fewer have nothing but their path to go by, and stay as they are.
    """
    distinct = lines.groupBy("path", "h1", "h2").agg(F.min(F.struct(key, "line_no")).alias("at"))
    many = distinct.groupBy("path").agg(F.count("*").alias("leaf_lines")).where("leaf_lines > 1")
    asked = distinct.join(many, "path").groupBy(f"at.{key}").agg(F.collect_set("at.line_no").alias("asked")).withColumnRenamed(key, "_key")
    found = docs.select(key, "text").join(asked.hint("merge"), F.col(key) == F.col("_key"))
    texts = found.select(F.explode(F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(F.array_contains("asked", i), masked(x))), lambda m: m.isNotNull())).alias("mask"))
    # all that is about a whole mask is worked out and written before its tokens are unfolded, once
    once = texts.distinct().where(n_tokens(F.col("mask")) > DEPTH + 1).select(
        F.xxhash64("mask").alias("h1"), F.xxhash64(F.lit(1), "mask").alias("h2"), F.xxhash64(path(F.col("mask"))).alias("path"),
        F.substring_index("mask", " ", DEPTH).alias("head"), F.slice(F.split("mask", " "), DEPTH + 1, n_tokens(F.col("mask"))).alias("rest"),
    )
    each = written(spark, once, "masks").select("h1", "h2", "path", "head", F.posexplode("rest").alias("pos", "token"))
    # as a table of its own: a third of all rows may have one path and token, and Spark can split the join's other side
    counts = written(spark, each.groupBy("path", "pos", "token").agg(F.count("*").alias("n")), "tokens")
    kept = each.join(counts.where("n > 1"), ["path", "pos", "token"], "left")
    rows = kept.groupBy("h1", "h2").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("n", F.lit(1)).alias("n")))).alias("t"))
    levels = F.filter(F.array_distinct(F.transform("t", lambda x: x["n"])), lambda c: (c > 1) & (F.size(F.filter("t", lambda x: x["n"] >= c)) + DEPTH >= (F.size("t") + DEPTH) * SIMILARITY))
    form = lambda c: F.concat(F.lit("~ "), "head", F.lit(" "), F.array_join(F.transform("t", lambda x: F.when(x["n"] >= c, x["token"]).otherwise(WILD)), " "))
    ways = rows.select("h1", "h2", F.explode(F.transform(levels, lambda c: F.struct(c.alias("c"), form(c).alias("form")))).alias("w"))
    ways = written(spark, ways.select("h1", "h2", "w.c", F.xxhash64("w.form").alias("g1"), F.xxhash64(F.lit(1), "w.form").alias("g2")), "ways")
    stands = ways.groupBy("g1", "g2").agg(F.count("*").alias("masks"), F.min("c").alias("least")).where(F.expr(f"masks >= 2 AND masks >= least * {CONSTANT}")).select("g1", "g2", "masks")
    best = ways.join(written(spark, stands, "stands"), ["g1", "g2"]).groupBy("h1", "h2").agg(F.max_by(F.struct("g1", "g2"), F.struct("masks", "c")).alias("g"))
    return best.select("h1", "h2", "g.*")


def recurring(spark: SparkSession, docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, passage_docs: int = PASSAGE_DOCS) -> DataFrame:
    """key, line_no of the lines to drop: those of recurring templates, but for each template's first line.

    First is the smallest key, then line number. Lines without tokens have no template and stay, as do all lines of a
    document whose key is null.
    """
    lines = written(spark, lines_of(docs, key), "lines")
    keyed = lines.join(generalised(spark, docs, lines, key), ["h1", "h2"], "left").select(key, "line_no", "long", F.coalesce("g1", "h1").alias("t1"), F.coalesce("g2", "h2").alias("t2"))
    # a third of all rows may share a template: count documents in two steps, each combined before its shuffle
    seen = keyed.groupBy("t1", "t2", key).agg(F.min("line_no").alias("line_no"), F.max("long").alias("long"))
    least = F.when(F.col("long"), passage_docs).otherwise(min_docs)
    often = seen.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.max("long").alias("long"), F.min(F.struct(key, "line_no")).alias("first")).where(F.col("docs") >= least)
    # as a table of its own, so that Spark can split a template's rows when it joins them
    hit = keyed.join(written(spark, often.select("t1", "t2", "first"), "templates"), ["t1", "t2"])
    return hit.where((F.col(key) != F.col(f"first.{key}")) | (F.col("line_no") != F.col("first.line_no"))).select(key, "line_no")


def dedup_lines(spark: SparkSession, docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, passage_docs: int = PASSAGE_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text reduced to the lines that stay, and two more columns with the names in counts.

    Lines that stay keep their order and are joined by line feeds. A null text stays null with 0 lines; an empty text
    has one empty line. Rows that repeat a key are judged line by line as one document. All other columns pass through;
    own columns of the two names are replaced.
    """
    docs = docs.drop(*counts)
    id_, gone = free_name(docs, "id"), free_name(docs, "gone")
    drop = recurring(spark, docs, key, min_docs, passage_docs).groupBy(F.col(key).alias(id_)).agg(F.collect_set("line_no").alias(gone))
    cut = docs.join(drop.hint("merge"), F.col(key) == F.col(id_), "left")
    lines, none = F.split("text", "\n", -1), F.col("text").isNull()
    stay = F.filter(lines, lambda x, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    own = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    dropped = F.when(none, 0).otherwise(F.coalesce(F.size(gone), F.lit(0)))
    return cut.select(*own, F.when(none, 0).otherwise(F.size(lines)).cast("long").alias(counts[0]), dropped.cast("long").alias(counts[1]))


#: The DuckDB twin over a view documents(doc_id, text): doc_id, n_lines, n_dropped, text_md5.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \t\r\x0B\f]+', ' ', 'g'), ' ') AS spaced FROM lines),
keyed AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(spaced, '\p{L}') THEN regexp_replace(spaced, '[0-9]+', '<*>', 'g') ELSE spaced END AS mask FROM s WHERE spaced <> ''),
once AS (SELECT mask, string_split(mask, ' ') AS tokens FROM (SELECT DISTINCT mask FROM keyed)),
paths AS (SELECT mask, tokens, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:3], ' ') AS path FROM once WHERE len(tokens) > 4),
cells AS (SELECT mask, path, unnest(range(4, len(tokens) + 1)) AS pos, unnest(tokens[4:]) AS token FROM paths),
counted AS (SELECT mask, pos, token, count(*) OVER (PARTITION BY path, pos, token) AS n FROM cells),
forms AS (SELECT mask, list(struct_pack(token := token, n := n) ORDER BY pos) AS t FROM counted GROUP BY mask),
levels AS (SELECT mask, t, unnest(list_distinct(list_transform(t, lambda x: x.n))) AS c FROM forms),
ways AS (
  SELECT mask, c, '~ ' || array_to_string(string_split(mask, ' ')[1:3], ' ') || ' ' || array_to_string(list_transform(t, lambda x: CASE WHEN x.n >= c THEN x.token ELSE '<*>' END), ' ') AS template
  FROM levels WHERE c > 1 AND len(list_filter(t, lambda x: x.n >= c)) + 3 >= (len(t) + 3) * 0.6::DOUBLE),
stands AS (SELECT template, count(*) AS masks FROM ways GROUP BY template HAVING count(*) >= 2 AND count(*) >= min(c) * 0.5),
best AS (SELECT mask, arg_max(template, struct_pack(m := masks, c := c)) AS template FROM ways JOIN stands USING (template) GROUP BY mask),
t AS (SELECT doc_id, line_no, coalesce(template, mask) AS template, len(string_split(mask, ' ')) >= 50 AS long FROM keyed LEFT JOIN best USING (mask)),
often AS (SELECT template, min(struct_pack(d := doc_id, l := line_no)) AS first FROM t GROUP BY template HAVING count(DISTINCT doc_id) >= CASE WHEN bool_or(long) THEN 2 ELSE 3 END),
hit AS (SELECT doc_id, line_no FROM t JOIN often USING (template) WHERE doc_id <> first.d OR line_no <> first.l),
gone AS (SELECT doc_id, list(DISTINCT line_no) AS gone FROM hit GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE coalesce(len(gone), 0) END AS n_dropped,
  md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS text_md5
FROM documents LEFT JOIN gone USING (doc_id)
"""
