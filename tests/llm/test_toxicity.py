import random

from barloom.llm.toxicity import Ftrl, features, fit, score
from tests.llm.conftest import prose


def labelled(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(rng, 60).split()
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["vile!", "Rotten,", "FOUL"])
        rows.append((seed * 10**6 + i, " ".join(words), int(bad)))
    return rows


def test_held_out(spark):
    schema = "doc_id long, text string, label int"
    model = fit(spark.createDataFrame([*labelled(1500, 1), (1, None, 0), (2, "", None)], schema))
    rows = score(spark.createDataFrame(labelled(500, 2), schema), model).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in rows) > 0.97 * len(rows)
    assert len(model) < 2000
    again = fit(spark.createDataFrame([*labelled(1500, 1), (1, None, 0), (2, "", None)], schema).repartition(5))
    assert model.equals(again)


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame(labelled(200, 3), "doc_id long, text string, label int")
    assert len(fit(rows, Ftrl(most_rows=10, l1=0.0))) <= 1 + 10 * 3 * 60


def test_edges(spark, none):
    model = fit(none.selectExpr("doc_id", "text", "cast(null as int) as label"))
    assert score(none, model).count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x")], "doc_id long, text string, score string")
    assert [r.score for r in score(rows, model).collect()] == [0.5] * 3
    assert len(features(b"a")) == 1 and len(features(b"")) == 0 and len(features(b"a, b a")) == len(features(b"A B! A"))
