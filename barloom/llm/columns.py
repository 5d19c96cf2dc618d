"""Column expressions over whole texts, and small frame helpers that every operator here shares."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_folder

GAP = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space, in order; none for null."""
    return F.array_remove(F.split(whole(text), GAP), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(hashes: Column, n: Column, k: int) -> Column:
    """A 64-bit hash of each run of ``k`` neighbours among the ``n`` hashes; empty where n < k."""
    spans = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    runs = F.transform(spans, lambda i: F.xxhash64(F.slice(hashes, i, k)))
    return F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(word_hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; a shorter, non-empty text is one shingle."""
    n = F.size(word_hashes)
    return (F.when(n >= k, window_hashes(word_hashes, n, k))
            .when(n > 0, F.array(F.xxhash64(word_hashes)))
            .otherwise(F.array().cast("array<bigint>")))


def fresh(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Working column names that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet to a new shared folder and read again: computed once, and safe when executors go."""
    spark: SparkSession = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


MARKS = 2**24


def _mark(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MARKS))


def with_mark(df: DataFrame, keys: list[str], ids: DataFrame, into: str) -> DataFrame:
    """``df`` with a flag that is true for every row whose ``keys`` are in ``ids`` (the same columns), and by chance for some others.

    The table of marks that every task holds has at most 2^24 bits in 2^18 rows, whatever the number of ids; it thins what goes
    into a join, which stays exact.
    """
    place, bits = fresh(df, ["_place", "_bits"])
    marks = ids.select(_mark(*map(F.col, keys)).alias("m")).groupBy(F.shiftright("m", 6).alias(place)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("m").bitwiseAND(63).cast("int"))).alias(bits))
    rows = df.withColumn(place, F.shiftright(_mark(*map(F.col, keys)), 6)).join(F.broadcast(marks), place, "left")
    bit = F.call_function("shiftrightunsigned", F.col(bits), _mark(*map(F.col, keys)).bitwiseAND(63).cast("int")).bitwiseAND(1)
    return rows.withColumn(into, F.coalesce(bit == 1, F.lit(False))).select(*df.columns, into)
