"""Queries of the operators on conversations, word runs and passages; ``queries`` registers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import passage_quality, periodic, repair
from barloom.llm.columns import let, words


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows (nulls: one space) with planted faults: of twenty, one is dropped, one emptied, one loses its stops, one is
    repeated and one goes to the user. ``present`` is false for a dropped row."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(draw == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
                       (draw != 0).alias("present"), copies.alias("copy"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{folder}/conversations.parquet"))
    found = repair.digests(repair.repair_conversations(rows, present=F.col("present")))
    return found.withColumnRenamed("conv", "conv_id")


def looped(doc_id: Column, text: Column) -> Column:
    """The text; for one document in ten, with a stretch of its own words over and over from some word on."""
    draw = F.crc32(doc_id.cast("string"))
    g = F.floor(draw / 10)

    def loop(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(w, lambda word, i: F.when(i >= a, F.element_at(w, a + (i - a) % p + 1)).otherwise(word)), " ")

    return F.when((draw % 10 == 0) & text.rlike("[^\\x20\\x09-\\x0D]"), let(words(text), loop)).otherwise(text)


def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs).drop("text")
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", nothing, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label")).filter(~held_out)
    found = passage_quality.score(docs, passage_quality.fit(labels, docs))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                        "n_passages", "top_word", "top_weight")


def _plus(way: str, cost: str, edit: str) -> str:
    """SQL for a way (nine digits of cost, then its edits) with one edit more."""
    return f"printf('%09d', {way}[1:9]::BIGINT + {cost}) || {way}[10:] || '{edit}'"


def _inserts(x: str) -> str:
    """SQL for the ways ``x`` after inserts, which lead to the user's and to the assistant's turn."""
    user = f"least({x}.u, {_plus(f'{x}.n', '3', 'I')}, {_plus(f'{x}.s', '3', 'I')}, {_plus(f'{x}.a', '3', 'I')})"
    return (f"list_transform([{user}], lambda w: {{'n': {x}.n, 's': {x}.s, 'u': w, 'a': least({x}.a, {_plus(f'{x}.u', '3', 'I')}, {_plus('w', '3', 'I')})}})[1]")


def _to_user(cost: str, edit: str) -> str:
    return f"least({_plus('y.n', cost, edit)}, {_plus('y.s', cost, edit)}, {_plus('y.a', cost, edit)})"


REPAIR_SQL = rf"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS codes FROM conversations),
c AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE draw <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                     WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1:1] AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'n': NULL::VARCHAR, 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR,
                    'go': fault IN ('blank', 'duplicate'), 'more': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'i': role[1:1]}} ORDER BY place) AS rows FROM f GROUP BY conv_id),
w AS (SELECT * EXCLUDE (rows), list_reduce(list_prepend({{'n': '000000000', 's': NULL::VARCHAR, 'u': NULL::VARCHAR, 'a': NULL::VARCHAR, 'go': false, 'more': 0, 'i': ''}}, rows),
        lambda x, r: list_transform([{_inserts('x')}], lambda y: {{
          'n': {_plus('y.n', '4', 'D')},
          's': least({_plus('y.s', '4', 'D')}, CASE WHEN NOT r.go AND r.i = 's' THEN {_plus('y.n', 'r.more', 'K')} END),
          'u': least({_plus('y.u', '4', 'D')}, CASE WHEN NOT r.go AND r.i = 'u' THEN {_to_user('r.more', 'K')} END, CASE WHEN NOT r.go THEN {_to_user('3 + r.more', 'R')} END),
          'a': least({_plus('y.a', '4', 'D')}, CASE WHEN NOT r.go AND r.i = 'a' THEN {_plus('y.u', 'r.more', 'K')} END, CASE WHEN NOT r.go THEN {_plus('y.u', '3 + r.more', 'R')} END),
          'go': false, 'more': 0, 'i': ''}})[1]) AS x FROM g),
v AS (SELECT * EXCLUDE (x), list_transform([{_inserts('x')}], lambda y: least(y.n, y.a))[1] AS way FROM w),
e AS (SELECT conv_id, j, edit, CASE WHEN edit <> 'I' THEN sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) END AS place,
             sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS m
      FROM (SELECT conv_id, unnest(string_split(way[10:], '')) AS edit, unnest(range(length(way) - 9)) AS j FROM v WHERE length(way) > 9)),
z AS (SELECT e.*, o.role, o.text, max(CASE WHEN m = 1 AND edit = 'K' AND o.role[1:1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS shift
      FROM e LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM e.conv_id AND o.place = e.place),
s AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS body
      FROM z WHERE edit <> 'D' GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(way[1:9]::BIGINT, 0) AS cost, coalesce(way[10:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM a LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
"""
