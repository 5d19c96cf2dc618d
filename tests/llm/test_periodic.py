import hashlib
import random

from pyspark.sql import functions as F

from barloom.llm.periodic import find_runs, kept_words, periodic_runs, word_numbers
from barloom.llm.structure_queries import looped, op12_runs


def brute(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            smaller = any(all(words[x] == words[x - d] for x in range(start + d, start + length)) for d in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def with_loops(rng):
    n = rng.randrange(160)
    words = [str(rng.randrange(rng.choice((1, 2, 3, 10, 50)))) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 5 else 0):
        a, p = rng.randrange(n), rng.randrange(1, n // 3 + 2)
        for i in range(a + p, rng.randrange(a, n)):
            words[i] = words[i - p]
    return words


def test_against_all_lags():
    rng, found = random.Random(1), 0
    for _ in range(1600):
        words = with_loops(rng)
        runs = brute(words)
        assert [tuple(r) for r in find_runs(word_numbers([w.encode() for w in words])).tolist()] == runs
        stay = kept_words(len(words), find_runs(word_numbers([w.encode() for w in words])))
        assert [w for w, s in zip(words, stay, strict=True) if s] == kept(words, runs)
        found += len(runs)
    assert found > 200


def test_long_text():
    assert find_runs(word_numbers([b"a"] * 300_000)).tolist() == [[0, 300_000, 1]]
    assert find_runs(word_numbers([str(i % 70_000).encode() for i in range(300_000)])).tolist() == [[0, 300_000, 70_000]]
    assert len(find_runs(word_numbers([str(i % 70_000).encode() for i in range(209_999)]))) == 0


def test_rows(spark, docs, corpus, none):
    rows = periodic_runs(docs.withColumn("Runs", F.lit("clash"))).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        words = (r.text or "").split()
        assert [tuple(x) for x in r.runs] == brute(words) and r.collapsed == " ".join(kept(words, brute(words)))
    assert periodic_runs(none).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " \n".join(with_loops(rng) + [f"u{rng.randrange(10**6)}" for _ in range(60)])) for i in range(150)]
    rows += [(None, "x " * 30), (200, None), (201, ""), (202, "y  " * 40), (202, "y  " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    changed = 0
    for r in frame.select("doc_id", "text", looped(F.col("doc_id"), F.col("text")).alias("new")).collect():
        changed += r.text != r.new
    assert changed > 5
    import re
    import zlib

    want = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = (zlib.crc32(str(doc).encode()) if doc is not None else 1), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if runs else (None, None, None)
        want.append((doc, len(runs), *top, None if not runs else 1000 * top[1] // top[2],
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(" ".join(kept(words, runs)).encode()).hexdigest()))
    assert sorted(map(tuple, op12_runs(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
