"""Stems equal those published with the rules; lemmas come from known forms or from the endings that they teach."""

from pyspark.sql import functions as F

from ephemera.functions import stemming
from ephemera.operators import dictionary, match

#: Words and stems of the sample that is published with the rules, and of single rules. Fixed values.
PUBLISHED = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid",
    "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol", "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "consorted": "consort", "consorting": "consort",
    "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci", "conspirator": "conspir", "conspirators": "conspir", "conspire": "conspir", "conspired": "conspir", "conspiring": "conspir",
    "constable": "constabl", "constables": "constabl", "constance": "constanc", "constancy": "constanc", "constant": "constant", "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knag": "knag", "knave": "knave",
    "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel", "kneeling": "kneel", "kneels": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt",
    "knew": "knew", "knick": "knick", "knif": "knif", "knife": "knife", "knight": "knight", "knightly": "knight", "knights": "knight", "knit": "knit", "knits": "knit", "knitted": "knit", "knitting": "knit", "knives": "knive",
    "knob": "knob", "knobs": "knob", "knock": "knock", "knocked": "knock", "knocker": "knocker", "knockers": "knocker", "knocking": "knock", "knocks": "knock", "knopp": "knopp", "knot": "knot", "knots": "knot",
    "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "hopped": "hop", "hoping": "hope", "hoped": "hope", "cry": "cri", "by": "by", "say": "say", "dying": "die",
    "news": "news", "inning": "inning", "innings": "inning", "proceeded": "proceed", "generate": "generat", "generous": "generous", "communism": "communism", "sensational": "sensat", "probably": "probabl", "relational": "relat",
    "hopefulness": "hope", "apology": "apolog", "at": "at", "agreed": "agre", "youth": "youth", "boy": "boy", "boys": "boy", "happily": "happili", "controlling": "control", "roll": "roll",
}


def test_stems_equal_the_published_ones(spark):
    words = spark.createDataFrame([(w,) for w in [*PUBLISHED, "Knights", "", None, "knots"]], "word string")
    out = stemming.english_stems(words)
    got = {r["word"]: r["stem"] for r in out.collect()}
    wrong = {w: (got[w], s) for w, s in PUBLISHED.items() if got[w] != s}
    assert not wrong and got["Knights"] == "knight" and got[""] == "" and got[None] is None and len(got) == len(PUBLISHED) + 3
    assert "Python" not in out._jdf.queryExecution().toString()


def test_stems_are_joined_back_in_order(spark):
    rows = spark.createDataFrame([(1, ["knights", "of", "knights"]), (2, []), (3, None), (1, ["knights", "of", "knights"])], "id long, w array<string>")
    stems = stemming.english_stems(rows.select(F.explode("w").alias("word")))
    assert sorted((r["id"], r["stems"]) for r in stemming.add_stems(rows, "w", stems).collect()) == [(1, ["knight", "of", "knight"])] * 2 + [(2, []), (3, [])]


FORMS = [("cities", "city", "noun"), ("parties", "party", "noun"), ("stations", "station", "noun"), ("nations", "nation", "noun"), ("roads", "road", "noun"), ("walked", "walk", "verb"), ("talked", "talk", "verb"), ("ran", "run", "verb"), ("quick", "quick", "adjective")]


def test_lemmas_from_forms_and_from_endings(spark):
    forms = spark.createDataFrame(FORMS, "form string, lemma string, pos string")
    words = spark.createDataFrame([(w,) for w in ["ran", "bounties", "rations", "balked", "quick", "x", "", None, "ran"]], "word string")
    got = {r["word"]: (r["lemma"], r["pos"], r["known"]) for r in stemming.lemmas(words, forms).collect()}
    assert got["ran"] == ("run", "verb", True) and got["quick"] == ("quick", "adjective", True)
    assert got["bounties"] == ("bounty", "noun", False) and got["rations"] == ("ration", "noun", False) and got["balked"] == ("balk", "verb", False)
    assert None not in got and got["x"][2] is False and len(got) == 7
    none = {r["word"]: (r["lemma"], r["pos"]) for r in stemming.lemmas(words, forms.limit(0)).collect()}
    assert none["bounties"] == ("bounties", None)


def test_the_guard_takes_parts_of_speech_from_the_lemmas(spark):
    places = spark.createDataFrame([(1, ["Walked Lane"], "street")], "id long, names array<string>, type string")
    found = match.surfaces(spark.createDataFrame([(s,) for s in ["walked", "talked", "stations"]], "surface string"))
    forms = spark.createDataFrame(FORMS, "form string, lemma string, pos string")
    other = stemming.lemmas(found.select(F.col("surface").alias("word")), forms).where("pos <> 'noun'").select("word")
    # an alias knows the stem of walked, so it stays although it is a verb
    assert sorted(r["surface"] for r in match.guarded(found, other, dictionary.aliases(places)).collect()) == ["stations", "walked"]
