"""Text queries over conversations and documents, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..functions import text as x
from ..operators.log import repeats_within
from ..sources import tables as t

KEYWORDS = (("the", "common", 3), ("was", "past", 2), ("that", "link", 1), ("der", "german", 1), ("les", "french", 1))
_KW = ", ".join(f"('{k}', '{c}', {p})" for k, c, p in KEYWORDS)
#: Text with entities, tags, times, tags and numbers put in, the same in both engines.
NOISY = "concat('<b>', text, '</b> at 12:30 or 7.05, not 99:99 or 24.61, C / P &amp; #', message_id, ' p/O/b Hauptstrasse 5th é')"
_NOISY_MESSAGES = f"noisy AS (SELECT message_id, {NOISY} AS text FROM messages)"
_SPACES = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'))"
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]*>', ' ', 'g'), '\\b([01]?[0-9]|2[0-3])[:.][0-5][0-9]\\b', ' ', 'g'), '\\b[cC]\\s*[/\\\\]\\s*[pP]\\b', 'cp', 'g'), '\\b[pP]\\s*[/\\\\]\\s*[oO]\\s*[/\\\\]\\s*[bB]\\b', 'pob', 'g')"
_RESPELLED = "regexp_replace(regexp_replace(translate({}, 'éèêëàâîïôûùç', 'eeeeaaiiouuc'), '(?i)strasse\\b', 'street', 'g'), '(?i)gatan\\b', 'street', 'g')"
LIGHT = _SPACES.format(_RESPELLED.format(f"replace({_PLAIN.format('text')}, '#', ' ')"))
CLEAN = f"lower({_SPACES.format(_RESPELLED.format('regexp_replace(' + _PLAIN.format('text') + chr(44) + ' $$[^\\p{L}\\p{N}]+$$, $$ $$, $$g$$)'))})"
_RAW = "regexp_extract_all(regexp_replace({}, '([0-9]+)([\\p{{L}}])', '\\1 \\2', 'g'), '[\\p{{L}}\\p{{N}}]+')"
_END = "list_contains(['st','nd','rd','th'], lower({}))"
_DIGITS = "regexp_full_match({}, '[0-9]+')"
TOKENS = f"""toks AS (SELECT message_id, CAST(row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS INT) AS pos, lower(token) AS token FROM (
  SELECT message_id, i, CASE WHEN {_DIGITS.format('w')} AND coalesce({_END.format('nxt')}, false) THEN w || lower(nxt) ELSE w END AS token FROM (
    SELECT message_id, i, w, lead(w) OVER (PARTITION BY message_id ORDER BY i) AS nxt, lag(w) OVER (PARTITION BY message_id ORDER BY i) AS prv FROM (
      SELECT message_id, unnest(r) AS w, unnest(range(len(r))) AS i FROM (SELECT message_id, {_RAW.format('text')} AS r FROM noisy)))
  WHERE NOT ({_END.format('w')} AND coalesce({_DIGITS.format('prv')}, false)))),
 rows_ AS (SELECT message_id, pos, token, sum(CASE WHEN token IN ('at','on','in','near','by','to') THEN 1 ELSE 0 END) OVER w AS segment, coalesce(lag(token IN ('at','on','in','near','by','to')) OVER w, false) AS anchored, token IN ('at','on','in','near','by','to') AS prep
   FROM toks WHERE token NOT IN ('st','str','no','nr') WINDOW w AS (PARTITION BY message_id ORDER BY pos)),
 segs AS (SELECT message_id, pos, token, CAST(segment AS BIGINT) AS segment, anchored FROM rows_ WHERE NOT prep),
 grams AS (SELECT message_id, segment, first, n, array_to_string(list_slice(w, 1, n), ' ') AS surface, anchored FROM (
   SELECT message_id, segment, anchored, row_number() OVER v - 1 AS first, [token, lead(token) OVER v, lead(token, 2) OVER v] AS w, unnest([1, 2, 3]) AS n FROM segs WINDOW v AS (PARTITION BY message_id, segment ORDER BY pos)) WHERE w[n] IS NOT NULL)"""


def _noisy(spark, d):
    return t.messages(spark, d).selectExpr("message_id", f"{NOISY} AS text")


def _grams(spark, d):
    return x.message_ngrams(_noisy(spark, d), "message_id")


def _words(spark, d):
    return t.messages(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


def stem_families(spark, d):
    """How many distinct words of the messages share each stem, and the first of them."""
    return stemming.english_stems(_words(spark, d)).groupBy("stem").agg(F.count("*").alias("words"), F.min("word").alias("first"))


def plural_lemmas(spark, d):
    """Plurals of the messages' words: those of an even number of letters are known, the others follow their endings."""
    words = _words(spark, d)
    forms = words.where(F.length("word") % 2 == 0).select(F.concat("word", F.lit("s")).alias("form"), F.col("word").alias("lemma"), F.lit("noun").alias("pos"))
    return stemming.lemmas(words.select(F.concat("word", F.lit("s")).alias("word")), forms)


def _address(spark, d):
    c = t.read(spark, d, "customer").selectExpr("c_custkey AS id", "concat('Title: Repair Address: ', c_name, ', ', c_custkey, ', Block \"Unit Old ', c_mktsegment, '\", ', c_mktsegment, ' street, 12345 Note: none') AS text")
    return c.withColumn("m", x.structured(F.col("text"))).select("id", "m.title", "m.address", "m.note", x.address_segments(F.col("m.address")).alias("segments"))


_ADDRESS = "SELECT c_custkey AS id, 'Repair' AS title, concat(c_name, ', ', c_custkey, ', Block \"Unit Old ', c_mktsegment, '\", ', c_mktsegment, ' street, 12345') AS address, 'none' AS note, [concat(c_mktsegment, ' street'), c_name, concat('Old ', c_mktsegment)] AS segments FROM customer"
_FOLD = "replace(replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
_dedup = f"CASE WHEN length(regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) >= 4 THEN regexp_replace({_FOLD}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') END"

_all = {
    "t01_strip_tail": (lambda s, d: t.messages(s, d).select("message_id", x.strip_tail(F.concat("text", F.when(F.col("message_id") % 2 == 0, " Send NEWS to us, subscribe").otherwise(" \U0001F310 Show  pin ON map "))).alias("text")), "SELECT message_id, trim(text) AS text FROM messages"),
    "t02_clean_light": (lambda s, d: _noisy(s, d).select("message_id", x.clean_light(F.col("text")).alias("text")), f"SELECT message_id, {LIGHT} AS text FROM noisy"),
    "t03_canonical_form": (lambda s, d: _noisy(s, d).select("message_id", x.clean(F.col("text")).alias("text")), f"SELECT message_id, {CLEAN} AS text FROM noisy".replace("$$", "'")),
    "t04_strip_emoji": (lambda s, d: t.messages(s, d).select("message_id", x.strip_emoji(F.concat(F.lit("📍→ "), "text", F.lit("🏠🇫🇷👨\u200d👩 1\ufe0f\u20e3™ x"))).alias("text")), f"SELECT message_id, {_SPACES.format('concat(text, $$ 1 x$$)')} AS text FROM messages".replace("$$", "'")),
    "t05_promotional": (lambda s, d: t.read(s, d, "pages").select("page_id", x.is_promotional(F.col("html")).alias("promotional")), "SELECT page_id, regexp_matches(regexp_replace(lower(html), '[ \\t\\n\\r]+', ' ', 'g'), 'http://|https://|www[.]|promo code|limited offer|join our group|sponsored post|(^|[^a-z0-9])@[a-z0-9_]{4,}') AS promotional FROM pages"),
    "t06_truncate_middle": (lambda s, d: t.messages(s, d).select("message_id", x.truncate_middle(F.col("text"), 120).alias("text")), "SELECT message_id, CASE WHEN length(text) <= 120 THEN text ELSE concat(regexp_replace(left(text, 60), ' [^ ]*$', ''), ' … ', regexp_replace(right(text, 60), '^[^ ]* ', '')) END AS text FROM messages"),
    "t07_valid_utf8": (lambda s, d: t.messages(s, d).select("message_id", F.length(x.valid_utf8(F.col("text"))).alias("n")), "SELECT message_id, CAST(length(text) AS INT) AS n FROM messages"),
    "t08_dedup_keys": (lambda s, d: t.messages(s, d).select("message_id", x.dedup_key(F.concat("text", F.lit(" Straße ΟΔΟΣ ﬁ"))).alias("key")), f"SELECT message_id, {_dedup.replace('text', "concat(text, ' Straße ΟΔΟΣ ﬁ')")} AS key FROM messages"),
    "t09_tokens": (lambda s, d: _noisy(s, d).select("message_id", F.posexplode(x.tokens(F.col("text"))).alias("pos", "token")).withColumn("token", F.lower("token")), f"WITH {t.MESSAGES}, {_NOISY_MESSAGES}, {TOKENS} SELECT * FROM toks"),
    "t10_plural_lemmas": (plural_lemmas, "SELECT DISTINCT w || 's' AS word, w AS lemma, 'noun' AS pos, length(w) % 2 = 0 AS known FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations)"),
    "t11_stem_families": (stem_families, None),
    "t17_segments": (lambda s, d: x.token_rows(_noisy(s, d), "message_id"), f"WITH {t.MESSAGES}, {_NOISY_MESSAGES}, {TOKENS} SELECT * FROM segs"),
    "t18_ngrams": (lambda s, d: _grams(s, d).groupBy("surface").agg(F.count("*").alias("n"), F.count_if("anchored").alias("anchored"), F.max("segment").alias("last_segment")), f"WITH {t.MESSAGES}, {_NOISY_MESSAGES}, {TOKENS} SELECT surface, count(*) AS n, count(*) FILTER (anchored) AS anchored, max(segment) AS last_segment FROM grams GROUP BY 1"),
    "t20_stop_phrases": (lambda s, d: _grams(s, d).where("n = 1").join(s.createDataFrame([(k,) for k, _, _ in KEYWORDS], "surface string"), "surface", "left_anti").groupBy("message_id").agg(F.count("*").alias("n")), f"WITH {t.MESSAGES}, {_NOISY_MESSAGES}, {TOKENS} SELECT message_id, count(*) AS n FROM grams WHERE n = 1 AND surface NOT IN ({', '.join(repr(k) for k, _, _ in KEYWORDS)}) GROUP BY 1"),
    "t25_structured_messages": (_address, _ADDRESS),
    "t28_categories": (lambda s, d: x.classify(t.messages(s, d), "message_id", s.createDataFrame(list(KEYWORDS), "keyword string, category string, priority int"), F.when(F.length("text") < 20, "short")), f"WITH {t.MESSAGES}, kw(k, c, p) AS (VALUES {_KW}), noisy AS (SELECT * FROM messages), {TOKENS.partition(chr(10) + ' rows_ AS')[0].rstrip(',')}, found AS (SELECT message_id, arg_min(c, (p, c)) AS c FROM toks JOIN kw ON token = k GROUP BY 1) SELECT message_id, CASE WHEN length(text) < 20 THEN 'short' ELSE coalesce(c, 'other') END AS category FROM messages LEFT JOIN found USING (message_id)"),
    "t30_highlighted": (lambda s, d: t.events_log(s, d).select("id", x.highlighted(F.concat(F.lit("clicker "), "description", F.lit(" a.c")), F.col("layer")).alias("text")), f"WITH {t.EVENTS_LOG} SELECT id, concat(CASE WHEN layer = 'click' THEN '<b>clicker</b> <b>click</b>' ELSE concat('clicker <b>', layer, '</b>') END, ' ', user_id, ' a.c') AS text FROM events_log"),
    "t32_quality_decisions": (lambda s, d: t.events_log(s, d).select("id", F.when(F.col("layer") == "error", "promotional").when(F.col("candidate_count") == 0, "no_geo").otherwise("geo_match").alias("source")).groupBy("source").agg(F.count("*").alias("n")), f"WITH {t.EVENTS_LOG} SELECT CASE WHEN layer = 'error' THEN 'promotional' WHEN candidate_count = 0 THEN 'no_geo' ELSE 'geo_match' END AS source, count(*) AS n FROM events_log GROUP BY 1"),
    "d01_text_repeats": (lambda s, d: t.messages(s, d).withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("message_id") % 7 * 900 + F.col("turn"))).transform(lambda m: repeats_within(m, x.dedup_key(F.col("text")), "at")).groupBy("duplicate").agg(F.count("*").alias("n")), f"SELECT coalesce(a - b <= 1800 AND key IS NOT NULL, false) AS duplicate, count(*) AS n FROM (SELECT key, a, lag(a) OVER (PARTITION BY key ORDER BY a, message_id) AS b FROM (SELECT message_id, {_dedup} AS key, message_id % 7 * 900 + turn AS a FROM messages)) GROUP BY 1"),
}

QUERIES = {k: f for k, (f, _) in _all.items()}
ORACLE_SQL = {k: sql if sql.startswith("WITH") else f"WITH {t.MESSAGES}, {_NOISY_MESSAGES} {sql}" for k, (_, sql) in _all.items() if sql}
