import random

import numpy as np
from pyspark.sql import functions as F

from barloom.llm.passage_quality import Attention, Model, Words, bags, fit, score, together
from tests.llm.conftest import prose

SMALL = Attention(bits=10, passes=4, passage_words=12)


def documents(n, seed):
    """Prose; every fourth text has one passage of junk between clean ones."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = prose(rng, 72).split()
        if i % 4 == 0:
            at = 12 * rng.randrange(6)
            words[at:at + 12] = [w + rng.choice(("###", "$$$", "%%%")) for w in words[at:at + 12]]
        rows.append((seed * 10**6 + i, " ".join(words), int(i % 4 != 0)))
    return rows


def test_gradients():
    model, rng = Model(Attention(bits=5, width=3, hidden=4, gates=3)), np.random.default_rng(1)
    model.embed = model.embed.astype(float)
    model.parts = {k: v.astype(float) for k, v in model.parts.items()}
    x, y = bags([b"a b C! c c c d 9", b"", b"x y z w a b c d e f g"], Words(5), 5), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    def slope(array, at):
        kept = array[at]
        array[at] = kept + 1e-5
        up = loss()
        array[at] = kept - 1e-5
        down = loss()
        array[at] = kept
        return (up - down) / 2e-5

    dense, places, rows = model.gradients(x, model.forward(x), y)
    for name, grad in dense.items():
        at = tuple(rng.integers(s) for s in grad.shape)
        assert abs(slope(model.parts[name], at) - grad[at]) < 1e-6
    for place, row in zip(places[:6], rows, strict=False):
        assert abs(slope(model.embed, (place, 1)) - row[1]) < 1e-6


def test_bags_add_up():
    known, texts = Words(8), [b"one two", b"", b"a b " * 30]
    whole, apart = bags(texts, known, 7), together([bags([t], known, 7) for t in texts])
    assert (whole.places == apart.places).all() and (whole.starts == apart.starts).all() and (whole.docs == apart.docs).all()
    assert np.allclose(whole.stats, apart.stats)
    assert whole.stats[0, 7] == 0 and whole.stats[3, 7] > 0.9


def test_held_out(spark):
    schema = "doc_id long, text string, label int"
    docs = spark.createDataFrame(documents(600, 1), schema)
    labels = docs.select("doc_id", "label").union(spark.createDataFrame([(None, 1), (5, 0), (10**6, None)], "doc_id long, label int"))
    model = fit(labels, docs, SMALL)
    rows = score(spark.createDataFrame(documents(300, 2), schema), model).collect()
    assert sum((r.score >= 0.5) == bool(r.label) for r in rows) > 0.97 * len(rows)
    junk = [r for r in rows if not r.label]
    hits = sum("#" in w or "$" in w or "%" in w for r in junk for w in r.text.split()[r.top_word:r.top_word + 12])
    assert hits > 0.8 * 12 * len(junk)  # attention lies on the junk passage, which no label named
    again = fit(labels.repartition(3), docs.repartition(5), SMALL)
    assert np.allclose(model.embed, again.embed) and all(np.allclose(model.parts[k], again.parts[k]) for k in model.parts)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(documents(50, 3), "doc_id long, text string, label int")
    one = fit(docs, docs, Attention(bits=8, passes=1, most_rows=1))
    assert (one.embed != Model(Attention(bits=8)).embed).any(axis=1).sum() <= 2 * 72


def test_edges(spark, docs, corpus, none):
    labels = none.selectExpr("doc_id", "cast(null as int) as label")
    model = fit(labels, none, SMALL)
    assert score(none, model).count() == 0
    rows = score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(corpus)
    by_text = {}
    for r in rows:
        assert 0 <= r.score <= 1 and 0 <= r.top_word < max(1, len((r.text or "").split())) and r.n_passages == max(1, -(-len((r.text or "").split()) // 12))
        by_text.setdefault((r.text or "").strip(), set()).add(round(r.score, 5))
    assert all(len(v) == 1 for v in by_text.values())
    long = spark.createDataFrame([(1, "word and more " * 200_000)], "doc_id long, text string")
    assert score(long, model).first().n_passages == 50_000
