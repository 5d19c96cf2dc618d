import re

from barloom.llm.components import components
from barloom.llm.jaccard import jaccard_groups, one_per_group


def brute(rows, k, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = {d: d for d, _ in rows if d is not None}
    moved = True
    while moved:
        moved = False
        for i, (d, _) in enumerate(rows):
            for j, (e, _) in enumerate(rows[:i]):
                if d is None or e is None or label[d] == label[e] or not sets[i] or not sets[j]:
                    continue
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[d] = label[e] = min(label[d], label[e])
                    moved = True
    known = {s: label[d] for s, (d, _) in zip(sets, rows, strict=True) if d is not None}
    return sorted(((d, len(s), (label[d] if d is not None else known.get(s) if s else None)) for s, (d, _) in zip(sets, rows, strict=True)), key=str)


def test_against_all_pairs(docs, corpus):
    rows = [(r[0], r[1]) for r in corpus]
    for k, percent in ((3, 90), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(docs, k, percent).collect()), key=str)
        assert got == brute(rows, k, percent)
        assert len({c for d, _, c in got if d is not None and 200 <= d < 240}) < 30


def test_one_stays(docs, corpus):
    kept = one_per_group(docs).collect()
    label = {(d, n): c for d, n, c in brute([(r[0], r[1]) for r in corpus], 5, 80)}
    want = {d for (d, n), c in label.items() if d is not None and (n == 0 or c == d)}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert one_per_group(docs).columns == docs.columns


def test_edges(spark, none):
    assert jaccard_groups(none).count() == 0 and one_per_group(none).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 1, 2)], "doc_id long, text string, _gone int, rep int")
    assert one_per_group(clash).collect() == [(1, "a b c", 1, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
