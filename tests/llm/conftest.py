import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines string, score string, shard string, key string, k string, line_no string, _key string"


def words(rng, n):
    return " ".join(rng.choice(["oak", "elm", "Ash", "river", "stone", "hill", "lane", "north", "wind"]) + rng.choice(["", "s", "ed", "ing", "land", "wood"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and columns whose names operators use themselves."""
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(6)]
    texts = [*base, base[0], base[0], base[1] + " tail", base[2].replace("oak", "fir", 1), None, "", " \n\t ", "one two", "one two", "ab" * 6000, "x" * 30000, "é" * 400, "\n".join(["same line of text here", "other " + base[3][:40], "same line of text here"]), words(rng, 9000), "&&& *** ###", "日本語のテキスト", "tab\tand\r\nreturn " + base[4]]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[5], None, None, None), (None, None, None, None, None), rows[3], rows[3], (4, "another text under the same id", "en", "s", 1)]
    return spark.createDataFrame([(*r, *["z"] * 8) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
