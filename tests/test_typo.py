"""The join of near strings gives the pairs that a comparison of all pairs gives; similarity measures equal plain ones."""

import random

import numpy as np
import pytest

from ephemera.functions import similarity, text
from ephemera.operators.typo import near_letters, nearest_typos, typo_pairs
from ephemera.plans import match_queries

WORDS = ["oak", "hill", "street", "mill", "lane", "north", "old", "park", "a", "of", "the", "river", "stone", "meadow", "saint", "ann", "bridge", "upper", "kirk"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(here, row[j])
            last = here
    return row[-1]


def room(n):
    return max(3, int(n * 0.25)) if n >= 10 else max(2, int(n * 0.2))


def changed(rng, s):
    letters = list(s)
    for _ in range(rng.randint(0, 4)):
        i, kind = rng.randrange(3, max(4, len(letters))), rng.randrange(4)
        if kind == 0 and len(letters) > 4:
            del letters[min(i, len(letters) - 1)]
        elif kind == 1:
            letters.insert(i, rng.choice("abcdest "))
        elif kind == 2 and len(letters) > i:
            letters[i] = rng.choice("abcdest")
        else:
            words = "".join(letters).split(" ")
            words.insert(rng.randrange(len(words) + 1), words.pop(rng.randrange(len(words))))
            letters = list(" ".join(words))
    return " ".join("".join(letters).split())


def test_common_subsequences_equal_plain_ones():
    rng = random.Random(5)
    a, b = (["".join(rng.choice("abcd é") for _ in range(rng.choice([0, 1, 5, 12, 30, 63, 64, 65, 90]))) for _ in range(500)] for _ in range(2))
    assert similarity.common(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.common([], []).tolist() == []


def test_weighted_ratio_takes_the_best_measure():
    one = lambda f, a, b: float(f([a], [b])[0])
    assert one(similarity.word_sort_ratio, "mill lane", "lane mill") == 1 and one(similarity.weighted_ratio, "mill lane", "lane mill") == 0.95
    assert one(similarity.word_set_ratio, "old mill lane", "mill lane") == 1 and one(similarity.weighted_ratio, "old mill lane", "mill lane") == 0.95
    assert one(similarity.weighted_ratio, "mill", "old mill lane") == pytest.approx(0.9) and one(similarity.weighted_ratio, "mill", "old mill lane " * 4) == pytest.approx(0.6)
    assert one(similarity.weighted_ratio, "", "x") == 0 and one(similarity.weighted_ratio, "custmer", "customer") == pytest.approx(14 / 15)
    assert one(similarity.word_set_ratio, "the the hill", "the hill") == 1 and one(similarity.word_set_ratio, "the the", "the hill") == pytest.approx(max(2 * 5 / 15, 2 * 3 / 10, 2 * 3 / 11, 6 / 11, 8 / 15), abs=0.2)


@pytest.mark.parametrize("seed", [5, 6])
def test_near_strings_equal_a_comparison_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(250)} | {"gre", "gree", "aaaa"})
    queries = sorted({changed(rng, rng.choice(names)) for _ in range(350)} | {"green", "greens", "aaaaab"})
    pairs = [(q, t) for q in queries if len(q) >= 5 for t in names if len(t) >= 3 and q[:3] == t[:3] and abs(len(q) - len(t)) <= room(len(q))]
    want = {p: s for p, s in zip(pairs, similarity.weighted_ratio(*map(list, zip(*pairs, strict=True))), strict=True) if s >= 0.9}
    df = lambda rows, c: spark.createDataFrame([(r,) for r in [*rows, rows[0], None]], f"{c} string")
    out = typo_pairs(df(queries, "query"), df(names, "name")).collect()
    assert {(r["query"], r["name"]): r["score"] for r in out} == want and len(out) == len(want) > 100
    assert typo_pairs(df(queries, "query"), df(names, "name").limit(0)).count() == 0
    with pytest.raises(ValueError):
        typo_pairs(df(queries, "query"), df(names, "name"), 0.8)


def test_names_that_begin_alike_make_no_pairs_unless_near(spark):
    names = spark.range(3000).selectExpr("concat('warehouse ', md5(cast(id as string))) AS s", "id")
    queries = names.selectExpr("concat(substring(s, 1, 20), substring(s, 22)) AS s", "-id AS id")
    for q, t in ((queries, names), (queries.selectExpr("substring(s, 1, 19) AS s", "id"), names.selectExpr("substring(s, 1, 20) AS s", "id"))):
        found = {(-r["q"], r["t"]) for r in near_letters(q, t, 0.1, 3).collect()}
        # long strings meet by parts, short ones by variants
        assert {(i, i) for i in range(3000)} <= found and len(found) < 400 * 3000


def _best(rows):
    top = {}
    for r in rows:
        top.setdefault(r["query"], []).append((r["score"], r["name"]))
    return {q: sorted(x for x in found if x[0] == max(found)[0]) for q, found in top.items()}


@pytest.mark.parametrize("seed", [5, 7])
def test_nearest_names_are_the_best_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(200)} | {"gre", "aaaa", *(f"mill lane {i:03d}" for i in range(60))})
    queries = sorted({changed(rng, rng.choice(names)) for _ in range(300)} | {"green", "aaaaab", "mil lane 017", *names[:5]})
    q, t = spark.createDataFrame([(x,) for x in [*queries, None]], "query string"), spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    want, got = typo_pairs(q, t).collect(), nearest_typos(q, t).collect()
    assert _best(got) == _best(want) and len(_best(got)) > 100
    assert {tuple(r) for r in got} <= {tuple(r) for r in want} and len(got) == len(set(map(tuple, got)))
    assert nearest_typos(q, t.limit(0)).count() == 0


def test_numbered_names_are_not_compared_with_all_their_neighbours(spark):
    names = spark.range(2000).selectExpr("concat('customer ', lpad(id, 9, '0')) AS name")
    queries = names.selectExpr("concat('custmer ', substring(name, 10)) AS query")
    got = nearest_typos(queries, names)
    assert got.count() == 2000 and got.where("substring(query, 9) = substring(name, 10)").count() == 2000
    few = queries.where("query LIKE '%77'")
    assert typo_pairs(few, names).count() > 10 * few.count()


def test_message_ngrams_equal_those_of_token_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["at", "on", "near", "st", "No", "Mill", "lane", "5th", "5", "th", "x,y", "3a", "by"]) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "k int, text string")
    want = text.ngrams(text.token_rows(df, "k"), "k")
    got = text.message_ngrams(df, "k")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_tier_links_something(spark, sf):
    got = {r["source"]: r["n"] for r in match_queries.QUERIES["t24_linked_places"](spark, sf).collect()}
    assert set(got) == {"stem_exact", "stem_reorder", "stem_subset", "surface_typo"} and min(got.values()) > 100


def test_null_strings_have_no_similarity(spark):
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(similarity.ratio_of("a", "b")).collect()] == [1.0, None, None]
    assert np.isclose(df.select(similarity.weighted_ratio_of("a", "b")).first()[0], 1)
