from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barloom.llm.mixing import mix, mix_report, split_quotas


def filled(sizes, weights, most):
    """Targets by handing out what is left, round after round, until no source is above its cap."""
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped and sizes[s] and weights[s]]
        target = {s: most * sizes[s] for s in capped} | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return {s: target.get(s, 0.0) for s in sizes}
        capped |= over


def corpus_of(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), "big") for i in range(900)]
    rows += [(1000 + i, "a b c " * (1 + i % 9), "mid") for i in range(300)] + [(2000 + i, "x " * 5, "tiny") for i in range(6)]
    rows += [(3000 + i, "n " * (i % 30), None) for i in range(100)] + [(4000, None, "void"), (None, "k k", "mid"), (5000, "", "mid")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_and_copies(spark):
    docs, rows = corpus_of(spark)
    got = mix_report(docs, shards=5).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = filled(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 5
    again = {(r.doc_id, r.source): r.taken for r in mix_report(docs.repartition(7), shards=5).collect()}
    assert again == {(r.doc_id, r.source): r.taken for r in got}


def test_rows_of_the_mix(spark):
    docs, _ = corpus_of(spark)
    want = Counter((r.doc_id, s) for r in mix_report(docs, shards=4).collect() for s in r.shards)
    rows = mix(docs.withColumn("_sk", F.lit(1)), shards=4, shard="shard")
    assert rows.columns == ["doc_id", "text", "source", "_sk", "shard"]
    assert Counter((r.doc_id, r.shard) for r in rows.collect()) == want
    per_shard = Counter(s for (_, s), n in want.items() for _ in range(n))
    assert set(per_shard) == {0, 1, 2, 3}


def test_given_weights(spark):
    docs, _ = corpus_of(spark)
    weights = spark.createDataFrame([("mid", 1.0), ("tiny", 0.0)], "source string, weight double")
    got = mix_report(docs, weights, shards=1).collect()
    assert all(r.taken == 0 for r in got if r.source != "mid") and all(len(r.shards) == 3 for r in got if r.source == "mid")


def test_quotas_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), ("c", 333)], "sk string, n long")
    parts = split_quotas(quotas, 6, 1).collect()
    assert Counter({k: sum(r.n for r in parts if r.sk == k) for k in "abc"}) == Counter(a=1000, b=7, c=333)
    assert {sum(r.n for r in parts if r.shard == s) for s in range(6)} <= {223, 224}
    assert sorted(parts) == sorted(split_quotas(quotas.repartition(3), 6, 1).collect())


def test_empty(none):
    assert mix_report(none).count() == 0 and mix(none).count() == 0
