import hashlib
import struct

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barloom.llm.cells import with_next
from barloom.llm.fingerprints import as_text, containment, edited_pairs, fingerprints, merged, sketch


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute(text, k=5, scale=16):
    h = [signed(xxh64_intdigest(w.encode(), 42)) for w in (text or "").lower().replace("\n", " ").split(" ") if w.strip("\t")]
    every = set()
    for i in range(max(len(h) - k + 1, 1 if h else 0)):
        s = 42
        for x in h[i:i + k]:
            s = xxh64_intdigest(struct.pack("<q", x), s)
        every.add(signed(s))
    low = sorted(x for x in every if x < -(2**63) + 2**64 // scale)
    return low or sorted(every)[:1]


def test_sketches(docs):
    for r in fingerprints(docs).collect():
        assert list(r.fingerprint) == brute(r.text)


def test_pairs(docs, corpus):
    rows = edited_pairs(docs).collect()
    ordered = sorted(((r[0], r[1] or "") for r in corpus), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in rows) == [(d is not None, d or 0, t) for d, t in ordered]
    want = set()
    for (d, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(t) // 2
        want.add((d, t[:len(t) - half] + u[:half]))
    assert {(r.doc_id, r.edited) for r in rows} == want
    assert all(list(r.edited_sketch) == brute(r.edited) for r in rows)


def test_next_over_many_runs(spark):
    keys = [3, 9, 10, 11, 400, 401, 9000, 9001, 2**40]
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    for size in (1, 2, 100):
        got = {r.k: r.next_k for r in with_next(df, "k", ["k"], [], size).collect()}
        assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True))


def test_union_and_containment(spark):
    words = [f"v{i}" for i in range(4000)]
    docs = spark.createDataFrame([(0, " ".join(words), "a"), (1, " ".join(words[:800]), "b"), (2, " ".join(words[:2000]), "m"), (3, " ".join(words[1996:]), "m")],
                                 "doc_id long, text string, g string")
    whole, part, both = (list(r.fingerprint) for r in [*fingerprints(docs.filter("doc_id < 2")).orderBy("doc_id").collect(), *merged(fingerprints(docs.filter("g = 'm'")), "g").collect()])
    assert set(part) <= set(whole) and both == whole
    near = fingerprints(docs.filter("doc_id < 2")).groupBy().pivot("doc_id", [0, 1]).agg(F.first("fingerprint"))
    assert near.select(containment(F.col("0"), F.col("1"))).first()[0] == 1.0


def test_edges(spark, none):
    assert fingerprints(none).count() == 0 and edited_pairs(none).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert edited_pairs(one).select(as_text(F.col("sketch")), "edited").collect() == [("", "")]
    clash = spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, fingerprint int")
    assert fingerprints(clash).select(F.size("fingerprint")).first()[0] == 1
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    assert spark.range(1).select(containment(sketch(F.lit("a b")), sketch(F.lit("a b")))).first()[0] == 1.0
