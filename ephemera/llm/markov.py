"""Secret scans: known shapes by pattern, and strings that a Markov model of random ones explains better than one of identifiers.

DataFrame functions only: the models are counts of character pairs, and a string's score is a sum over its pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Patterns of the known kinds, the group that holds the secret, and its least length. Letters of words in either case.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: A stretch that the models judge, if it holds a letter and a digit, and the kind it is reported as.
CANDIDATE, RANDOM = r"[A-Za-z0-9+/_-]{16,}", "random"
#: Ordinary identifiers to learn from: words that begin with a letter.
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_]{5,}"
#: Bounds of the labelled sample: distinct secrets of the known kinds, and distinct texts whose identifiers count.
SECRETS, TEXTS = 20000, 2000
#: Symbols that both models spread some weight over evenly, and the weight that the counts keep.
SYMBOLS, RANDOM_WEIGHT, ORDINARY_WEIGHT = 66, 0.5, 0.98
#: Least log-likelihood ratio a pair on average, in thousandths of a nat.
THRESHOLD = 800
SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, whole: Column, pattern: str, value: Column) -> Column:
    """start, end (in characters) and value of each match, from what stands between matches and the matches themselves."""
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    sizes = F.zip_with(between, whole, lambda a, b: F.length(a) + F.length(b))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    after = F.zip_with(F.slice(ends, F.lit(2), F.size(whole)), whole, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))
    found = F.zip_with(after, value, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return F.when(F.size(whole) > 0, found).otherwise(F.array().cast(SPAN))


def long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


#: Runs of this length are all that can count of these kinds, and few texts hold one.
_ASKED = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", RANDOM: CANDIDATE}


def with_spans(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """rows(text, ...) with a column of spans for each of the kinds; short matches are dropped.

    Matches of one kind do not overlap: the leftmost counts, and what it covers is spent even where it is too short.
    """
    patterns = {k: _ASKED.get(k) or KINDS[k][0] for k in kinds}
    every = lambda p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    groups = {k: KINDS[k][1] for k in kinds if k in KINDS and KINDS[k][1]}
    out = rows.withColumns({f"{k}_whole": every(p, 0) for k, p in patterns.items()} | {f"{k}_value": every(patterns[k], g) for k, g in groups.items()})
    spans = {k: located(F.col("text"), F.col(f"{k}_whole"), p, F.col(f"{k}_value" if k in groups else f"{k}_whole")) for k, p in patterns.items()}
    return out.select(*rows.columns, *[long_enough(c, KINDS[k][2] if k in KINDS else 0).alias(k) for k, c in spans.items()])


def pairs(strings: DataFrame) -> DataFrame:
    """pair (128 * the first character's code + the second's), n: how often it stands in strings(s)."""
    codes = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.ascii(F.substring("s", i, F.lit(1))) * 128 + F.ascii(F.substring("s", i + 1, F.lit(1))))
    return strings.where(F.length("s") > 1).select(F.explode(codes).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[int]:
    """For each pair of characters the log-likelihood ratio of the second behind the first, in thousandths of a nat."""

    def chances(counts: dict[int, int], weight: float) -> list[float]:
        behind = [0] * 128
        for pair, n in counts.items():
            behind[pair // 128] += n
        return [weight * counts.get(k, 0) / behind[k // 128] + (1 - weight) / SYMBOLS if behind[k // 128] else 1 / SYMBOLS for k in range(128 * 128)]

    return [math.floor(1000 * math.log(r / o) + 0.5) for r, o in zip(chances(random, RANDOM_WEIGHT), chances(ordinary, ORDINARY_WEIGHT), strict=True)]


def train(secrets: DataFrame, texts: DataFrame) -> list[int]:
    """Ratios from secrets(s), labelled random, and the identifiers of texts(s), labelled ordinary; each counts once.

    Identifiers are learned in their own case and in capitals, with an underscore on either side. What comes to the
    driver is at most a count for each pair of two characters.
    """
    words = texts.select(F.explode(F.regexp_extract_all("s", F.lit(IDENTIFIER), F.lit(0))).alias("w")).distinct()
    ordinary = words.select(F.explode(F.array(F.concat(F.lit("_"), "w", F.lit("_")), F.concat(F.lit("_"), F.upper("w"), F.lit("_")))).alias("s"))
    counts = [{r["pair"]: r["n"] for r in pairs(s).collect()} for s in (secrets, ordinary)]
    return ratios(*counts)


def score(s: Column, table: Column) -> Column:
    """The mean ratio of the pairs of s, rounded down; s holds ASCII characters only."""
    codes = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))))
    steps = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(table, a * 128 + b + 1))
    return F.floor(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x) / (F.length(s) - 1))


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """s of the rows(s) whose md5 is among the smallest, most of them."""
    return rows.distinct().orderBy(F.md5("s"), "s").limit(most)


def scan(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, most_secrets: int = SECRETS, most_texts: int = TEXTS) -> DataFrame:
    """docs with a column spans in place of an own one: kind, start, end of each secret, by start, then kind.

    Positions count characters, the end is exclusive. The known kinds are found by their patterns. On top, a stretch of
    at least 16 characters of CANDIDATE with a letter and a digit is reported as random if its mean ratio reaches the
    threshold and no known span holds it whole. The models learn from the distinct secrets of the known kinds, labelled
    random, and the identifiers of distinct texts without any, labelled ordinary (of each those with the smallest md5,
    within the two bounds). Without labelled samples the even spread stands for that class. Null and empty texts have no
    spans, repeated rows stay, an empty table gives none; all other columns pass through.
    """
    docs, known = docs.drop("spans"), list(KINDS)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    values = F.concat(*[F.transform(k, lambda s: s["value"]) for k in known])
    labels = written(spark, with_spans(texts, known).select(values.alias("secrets"), F.when(F.size(values) == 0, F.md5("text")).alias("plain")), "labels")
    secrets = smallest(labels.select(F.explode("secrets").alias("s")), most_secrets)
    last = labels.where("plain IS NOT NULL").select("plain").distinct().orderBy("plain").limit(most_texts).agg(F.max("plain")).first()[0]
    chosen = with_spans(texts.where(F.md5("text") <= F.lit(last)), known).where(F.size(values) == 0).select(F.col("text").alias("s"))
    model = F.lit(train(secrets, chosen)).cast("array<int>")

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(rows, [*known, RANDOM])
    placed = lambda k, at: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(at).alias("kind"), s["end"].alias("end")))
    based = found.withColumn("base", F.concat(*[placed(k, at) for at, k in enumerate(known)]))
    held = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    # judged one after the other, so that only stretches that can count are scored
    more = based.withColumn("more", F.filter(F.filter(F.filter(RANDOM, mixed), lambda s: ~held(s)), lambda s: score(s["value"], model) >= threshold))
    names = F.array(*[F.lit(k) for k in (*known, RANDOM)])
    every = F.transform(F.array_sort(F.concat("base", placed("more", len(known)))), lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return more.select("row.*", every.alias("spans"))


def said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the known kinds' spans as kind:start:end, comma-joined), spans."""
    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    counts = [F.size(of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


_ASSIGN = KINDS["assign"][0].replace("'", "''")


def _raw(kind: str, at: int) -> str:
    """SQL for every match of a kind: the matches, the values in them, and what stands between."""
    p, value, least = (_ASSIGN, f"regexp_extract_all(text, '{_ASSIGN}', 2)", KINDS[kind][2]) if kind == "assign" else (_ASKED[kind], "NULL", 0)
    return f"SELECT rid, '{kind}' AS kind, {at} AS k, {least} AS least, regexp_extract_all(text, '{p}') AS whole, {value} AS value, string_split_regex(text, '{p}') AS between FROM t"


#: The DuckDB twin of digest(scan(documents)).
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(_raw(k, at) for at, k in enumerate([*KINDS, RANDOM]))}),
each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM raw WHERE len(whole) > 0),
found AS (
  SELECT rid, kind, k, coalesce(value[i], whole[i]) AS value, list_sum(list_transform(between[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS s,
    length(whole[i]) AS size FROM each WHERE length(coalesce(value[i], whole[i])) >= least),
base AS (SELECT rid, kind, k, value, s, s + size AS e FROM found WHERE kind <> '{RANDOM}'),
secrets AS (SELECT value AS s FROM (SELECT DISTINCT value FROM base) ORDER BY md5(value), value LIMIT {SECRETS}),
texts AS (SELECT text FROM (SELECT DISTINCT text FROM t ANTI JOIN base USING (rid)) ORDER BY md5(text) LIMIT {TEXTS}),
identifiers AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENTIFIER}')) AS w FROM texts),
strings AS (SELECT 0 AS label, s FROM secrets UNION ALL SELECT 1, '_' || w || '_' FROM identifiers UNION ALL SELECT 1, '_' || upper(w) || '_' FROM identifiers),
places AS (SELECT label, s, unnest(range(1, length(s))) AS i FROM strings WHERE length(s) > 1),
counts AS (SELECT label, ascii(substr(s, i, 1)) AS a, ascii(substr(s, i + 1, 1)) AS b, count(*) AS n FROM places GROUP BY ALL),
behind AS (SELECT label, a, sum(n) AS total FROM counts GROUP BY label, a),
cells AS (SELECT a, b FROM range(128) x(a), range(128) y(b)),
chances AS (
  SELECT cells.a, cells.b, label, CASE WHEN total IS NULL THEN 1 / {SYMBOLS} ELSE weight * coalesce(n, 0) / total + (1 - weight) / {SYMBOLS} END AS chance
  FROM cells CROSS JOIN (VALUES (0, {RANDOM_WEIGHT}::DOUBLE), (1, {ORDINARY_WEIGHT}::DOUBLE)) w(label, weight) LEFT JOIN counts USING (a, b, label) LEFT JOIN behind USING (a, label)),
ratio AS (SELECT a, b, floor(1000 * ln(r.chance / o.chance) + 0.5)::BIGINT AS ratio FROM (FROM chances WHERE label = 0) r JOIN (FROM chances WHERE label = 1) o USING (a, b)),
asked AS (SELECT rid, s, s + size AS e, value FROM found WHERE kind = '{RANDOM}' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
free AS (SELECT * FROM asked WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = asked.rid AND base.s <= asked.s AND base.e >= asked.e)),
steps AS (SELECT rid, s, e, value, unnest(range(1, length(value))) AS i FROM free),
judged AS (
  SELECT rid, s, e FROM steps JOIN ratio ON a = ascii(substr(value, i, 1)) AND b = ascii(substr(value, i + 1, 1))
  GROUP BY rid, s, e HAVING floor(sum(ratio) / count(*)) >= {THRESHOLD}),
every AS (SELECT rid, kind, k, s, e FROM base UNION ALL SELECT rid, '{RANDOM}', {len(KINDS)}, s, e FROM judged),
said AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE kind <> '{RANDOM}') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN said USING (rid)
"""
