import re
from collections import Counter

from pyspark.sql import functions as F

from barloom.llm.quality import _bin, _lower_edge, quality_filter, quality_verdicts


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_counts(spark, docs):
    extra = spark.createDataFrame([(900, "a b c d e f g h " * 9 + "\nz\nz\n#*", "en", "s0", 1), (901, "x y " * 30, "en", "s0", 1)], docs.schema)
    rows = quality_verdicts(docs.unionByName(extra)).collect()
    texts = {(r.doc_id, counts(r.text)) for r in docs.unionByName(extra).collect()}
    got = {(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in rows}
    assert got == texts and len(rows) == docs.count() + 2
    assert not any(r.kept for r in rows if r.base_failed)


def test_limits_follow_the_source(spark):
    clean = "word and some more of them besides "
    texts = [clean + " ".join(f"q{i}{j}" for j in range(20)) for i in range(300)]
    rows = [(i, t, "en", "plain", 0) for i, t in enumerate(texts)]
    rows += [(1000 + i, t.replace(" ", " | "), "en", "tables", 0) for i, t in enumerate(texts)]
    rows.append((5000, texts[0].replace(" ", " | "), "en", "plain", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality_filter(docs).collect()}
    assert kept == {r[0] for r in rows} - {5000}


def test_edges(spark, docs, none):
    assert quality_filter(none).count() == 0 and quality_verdicts(none).count() == 0
    clash = docs.withColumns({"kept": F.lit("k"), "n_words": F.lit(1), "_w": F.lit(2), "kl": F.lit(3), "docs": F.lit(4)})
    out = quality_filter(clash)
    assert out.columns == clash.columns
    assert sorted(map(str, out.drop("kept", "n_words", "_w", "kl", "docs").collect())) == sorted(map(str, quality_filter(docs).collect()))


def test_bins(spark):
    values = [*range(200), 12345, 2**40 + 17]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", _lower_edge(_bin(F.col("v")).cast("bigint")).alias("e")).collect()
    assert all(r.e <= r.v <= r.e * 33 / 32 for r in rows)
