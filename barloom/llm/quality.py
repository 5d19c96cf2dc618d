"""Quality rules with limits learned from the corpus.

Every document gets a few counts from its whole text. Four ratios of them are kept as quantile sketches per language and
source: a histogram whose bins grow in proportion to the value, so that sketches of parts add up to the sketch of the whole and
any quantile is known to within 1/32. A group's limit lies a few interquartile ranges beyond its quartiles. Small groups take the
merged sketch of their language, or of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.columns import WORD_CHAR, fresh, let, stored, whole, window_hashes, words

RUN = 8
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Ratio in thousandths: numerator, denominator, least distance of the limit from the quartile, and whether low values fail too.
RATIOS = {
    "length": ("word_chars", "n_words", 2000, True),
    "symbols": ("n_symbols", "word_chars", 50, False),
    "dup_lines": ("n_dup_lines", "n_lines", 300, False),
    "repeats": ("n_repeat_words", "n_words", 150, False),
}
BITS = 5


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the sorted ``starts``."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(RUN)), F.lit(RUN)))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _repeated(runs: Column) -> Column:
    """Words under runs that occur twice or more. Sorting (run, place) pairs puts equal runs side by side."""
    def flagged(sorted_runs: Column) -> Column:
        n = F.size(sorted_runs)
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(sorted_runs, 1, F.greatest(n - 1, F.lit(0))))
        after = F.slice(sorted_runs, 2, n)
        near = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
        same = F.zip_with(sorted_runs, near, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    pairs = F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(let(F.sort_array(pairs), flagged), _covered)


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts of each text under names that clash with no column; the second result maps them."""
    names = dict(zip((*COUNTS, "base_failed"), fresh(docs, [*COUNTS, "base_failed"]), strict=True))
    w, runs, lines = fresh(docs, ["_w", "_runs", "_lines"])
    n = F.size(w)
    split = docs.select("*", words(F.col(text)).alias(w),
                        F.filter(F.split(whole(F.col(text)), "\n", -1), lambda x: x.rlike(WORD_CHAR)).alias(lines))
    split = split.withColumn(runs, let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: window_hashes(h, F.size(h), RUN)))
    repeated = F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("bigint")).otherwise(_repeated(F.col(runs)))
    counts = {
        "n_words": n.cast("bigint"),
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole(F.col(text)), F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated,
        "n_lines": F.size(lines).cast("bigint"),
    }
    # One exploded row each: later filters can't be moved below it, where they would count the texts again.
    once = F.explode(F.array(F.struct(*[v.alias(k) for k, v in counts.items()])))
    counted = split.select(*docs.columns, once.alias(runs)).select(*docs.columns, *[F.col(f"{runs}.{k}").alias(names[k]) for k in counts])
    failed = (F.col(names["n_words"]) < 20) | (100 * F.col(names["n_repeat_words"]) > 30 * F.col(names["n_words"]))
    return counted.withColumn(names["base_failed"], failed), names


def _bin(value: Column) -> Column:
    """Values under 2^BITS have bins of their own; above, each power of two has 2^BITS bins. Integer arithmetic only."""
    shift = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0))
    return shift * 2**BITS + F.call_function("shiftright", value, shift)


def _lower_edge(bin_: Column) -> Column:
    shift = F.greatest(F.floor(bin_ / 2**BITS) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", bin_ - shift * 2**BITS, shift)


def _key(value: Column) -> Column:
    """Null and every string get keys of their own."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), value.cast("string")))


def sketches(counted: DataFrame, names: dict[str, str], lang: str = "lang", source: str = "source") -> DataFrame:
    """Sketches (kl, ks, ratio, bin, n) per language and source. Add n over parts, sources or languages to merge them."""
    bins = F.array(*[
        F.struct(F.lit(r).alias("ratio"),
                 _bin(F.floor(1000 * F.col(names[top]) / F.greatest(F.col(names[bottom]), F.lit(1)))).cast("bigint").alias("bin"))
        for r, (top, bottom, _, _) in RATIOS.items()])
    return (counted.filter(~F.col(names["base_failed"]))
            .select(_key(F.col(lang)).alias("kl"), _key(F.col(source)).alias("ks"), F.explode(bins).alias("x"))
            .groupBy("kl", "ks", "x.ratio", "x.bin").agg(F.count("*").alias("n")))


def quartiles(sketch: DataFrame) -> DataFrame:
    """First and third quartile of each (kl, ks, ratio): lower edges of the bins that hold them."""
    group = W.partitionBy("kl", "ks", "ratio")
    at = sketch.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "all": F.sum("n").over(group)})
    return at.groupBy("kl", "ks", "ratio").agg(
        F.max("all").alias("docs"),
        _lower_edge(F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bin")))).alias("q1"),
        _lower_edge(F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bin")))).alias("q3"))


def limits(sketch: DataFrame, reach: int = 3, min_docs: int = 50) -> DataFrame:
    """The least and largest allowed ratio per (kl, ks). Groups under ``min_docs`` take the sketch of their language, else of all."""
    levels = [sketch]
    for kl, ks in ((F.col("kl"), F.lit("*")), (F.lit("*"), F.lit("*"))):
        levels.append(sketch.groupBy(kl.alias("kl"), ks.alias("ks"), "ratio", "bin").agg(F.sum("n").alias("n")))
    bounds = quartiles(levels[0].unionByName(levels[1]).unionByName(levels[2]))
    cells = []
    for r, (_, _, least, two_sided) in RATIOS.items():
        far = F.greatest(reach * (F.col("q3") - F.col("q1")), F.lit(least))
        cells.append(F.max(F.when(F.col("ratio") == r, F.col("q3") + far)).alias(f"most_{r}"))
        if two_sided:
            cells.append(F.max(F.when(F.col("ratio") == r, F.col("q1") - far)).alias(f"least_{r}"))
    table = bounds.groupBy("kl", "ks").agg(F.max("docs").alias("docs"), *cells)
    own = table.filter(F.col("ks") != "*").select("kl", "ks", "docs")
    in_lang = F.sum("docs").over(W.partitionBy("kl"))
    chosen = own.select(
        "kl", "ks",
        F.when(in_lang >= min_docs, F.col("kl")).otherwise("*").alias("from_kl"),
        F.when(F.col("docs") >= min_docs, F.col("ks")).otherwise("*").alias("from_ks"))
    found = table.withColumnsRenamed({"kl": "from_kl", "ks": "from_ks"}).drop("docs")
    return chosen.join(found, ["from_kl", "from_ks"]).drop("from_kl", "from_ks")


def judged(counted: DataFrame, names: dict[str, str], table: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, str]:
    """``counted`` with a verdict; the second result is the verdict's column. A group whose documents all fail the base rule has no limits."""
    (kept,) = fresh(counted, ["kept"])
    inside = ~F.col(names["base_failed"])
    for r, (top, bottom, _, two_sided) in RATIOS.items():
        ratio = F.floor(1000 * F.col(names[top]) / F.greatest(F.col(names[bottom]), F.lit(1)))
        inside &= F.coalesce(ratio <= F.col(f"_limits.most_{r}"), F.lit(True))
        if two_sided:
            inside &= F.coalesce(ratio >= F.col(f"_limits.least_{r}"), F.lit(True))
    table = table.alias("_limits")
    same = (_key(F.col(lang)) == F.col("_limits.kl")) & (_key(F.col(source)) == F.col("_limits.ks"))
    return counted.join(table, same, "left").select(*[counted[c] for c in counted.columns], inside.alias(kept)), kept


def quality_verdicts(docs: DataFrame, reach: int = 3, min_docs: int = 50, text: str = "text", lang: str = "lang",
                     source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, counts, base_failed, kept) of every row of ``docs``; a null text counts as empty and fails the base rule.

    Null languages and sources are groups of their own; repeated rows count as often as they stand there; an empty table gives
    none. The counts are written once to the shared folder, so whole texts are read once.
    """
    counted, names = with_counts(docs.select(key, lang, source, text), text)
    counted = stored(counted.drop(text))
    result, _ = judged(counted, names, limits(sketches(counted, names, lang, source), reach, min_docs), lang, source)
    return result


def quality_filter(docs: DataFrame, reach: int = 3, min_docs: int = 50, text: str = "text", lang: str = "lang",
                   source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only. Texts are read twice: for the sketch, which is written to the shared
    folder, then for the verdicts."""
    counted, names = with_counts(docs, text)
    slim = counted.select(lang, source, *names.values())
    result, kept = judged(counted, names, limits(stored(sketches(slim, names, lang, source)), reach, min_docs), lang, source)
    return result.filter(F.col(kept)).select(*[result[c] for c in docs.columns])
