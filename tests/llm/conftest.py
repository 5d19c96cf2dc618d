import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=4000):
    """n invented words in lines of about ten."""
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "\n".join(" ".join(words[i:i + 10]) for i in range(0, n, 10))


def changed(rng, text, n):
    """``text`` with n words replaced."""
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared lines, nulls, empty and long texts, repeated rows and keys, null keys."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.choice((30, 60, 200))), "en", f"s{i % 3}", 0) for i in range(10, 40)]
    rows += [(i, base, "en", "s0", 1) for i in (100, 50, 101)]
    rows += [(200 + i, changed(rng, base, 1 + i % 3), "en", "s0", 2) for i in range(40)]
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), (302, " \n\t ", "de", "s1", 4), (303, "one two", "de", None, 7), (304, "one two", "de", None, 7)]
    rows += [(305, prose(rng, 3000), "en", "s2", 5), (306, "One TWO\nshared line of ten words that many documents have here", "fr", "s2", 5)]
    rows += [(307, "shared line of ten words that many documents have here\n" + prose(rng, 40), None, "s2", 5)] * 2
    rows += [(None, base, "en", "s1", 1), (None, prose(rng, 50), "en", "s1", 1), (400, "é漢字 \U0001f600 <|endoftext|> it's 12,5.", "fr", "s0", 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
