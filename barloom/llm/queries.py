"""The numbered operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import fingerprints, jaccard, lines, mixing, passages, pieces, quality, records, structure_queries, toxicity, url_lists
from barloom.llm.columns import stored
from barloom.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang = lang, false) AS has_lang, coalesce(source = source, false) AS has_source, lang, source,
                  coalesce(text, '') AS text, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS c FROM runs) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS d FROM lines GROUP BY r),
c AS (SELECT t.r, doc_id, CASE WHEN has_lang THEN '=' || lang ELSE 'null' END AS kl, CASE WHEN has_source THEN '=' || source ELSE 'null' END AS ks,
             len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM t LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
v AS (SELECT r, kl, ks, base_failed, unnest(['length', 'symbols', 'dup_lines', 'repeats']) AS ratio,
             unnest([1000 * word_chars // greatest(n_words, 1), 1000 * n_symbols // greatest(word_chars, 1),
                     1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1)]) AS x FROM b),
e AS (SELECT *, CASE WHEN x < 64 THEN x ELSE (x // s) * s END AS edge
      FROM (SELECT *, (2 ** greatest(length(bin(x)) - 6, 0))::BIGINT AS s FROM v WHERE NOT base_failed)),
lv AS (SELECT kl, ks, ratio, edge FROM e UNION ALL SELECT kl, '*', ratio, edge FROM e UNION ALL SELECT '*', '*', ratio, edge FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY kl, ks, ratio ORDER BY edge) AS k, count(*) OVER (PARTITION BY kl, ks, ratio) AS n FROM lv),
q AS (SELECT kl, ks, ratio, max(n) AS docs, min(edge) FILTER (4 * k >= n) AS q1, min(edge) FILTER (4 * k >= 3 * n) AS q3 FROM o GROUP BY ALL),
g AS (SELECT kl, ks, max(docs) AS docs, sum(max(docs)) OVER (PARTITION BY kl) AS in_lang FROM q WHERE ks <> '*' GROUP BY kl, ks),
p AS (SELECT g.kl, g.ks, q.ratio, q3 + greatest(3 * (q3 - q1), m.least_gap) AS most,
             CASE WHEN q.ratio = 'length' THEN q1 - greatest(3 * (q3 - q1), m.least_gap) END AS least
      FROM g JOIN q ON q.kl = CASE WHEN in_lang >= 50 THEN g.kl ELSE '*' END AND q.ks = CASE WHEN g.docs >= 50 THEN g.ks ELSE '*' END
      JOIN (VALUES ('length', 2000), ('symbols', 50), ('dup_lines', 300), ('repeats', 150)) AS m(ratio, least_gap) ON m.ratio = q.ratio),
bad AS (SELECT DISTINCT v.r FROM v JOIN p ON p.kl = v.kl AND p.ks = v.ks AND p.ratio = v.ratio WHERE x > most OR x < least)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM b
"""


@query("op3_quality", QUALITY_SQL)
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = quality.quality_verdicts(table(spark, folder, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, folder, "documents"))
    mine, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(mine).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.containment(mine, edited).alias("near_edited"), fingerprints.containment(mine, after).alias("near_next"),
        fingerprints.resemblance(mine, edited).alias("resemblance_edited"), fingerprints.resemblance(mine, after).alias("resemblance_next"))


@query("op6_lines")
def op6_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, dropped="n_dropped").withColumn("n_chars", F.length("text").cast("bigint"))


JACCARD_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 190 * count(*) >= 90 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (WITH RECURSIVE r(node, c) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node WHERE r.c < e.b) SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM t LEFT JOIN n USING (doc_id) JOIN r ON r.node = t.doc_id
"""


@query("op10_jaccard", JACCARD_SQL)
def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, folder, "documents"), k=3, percent=90)


MIXING_SQL = r"""
WITH t AS (SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE '=' || source END AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY starts_with(sk, '~'), sk) - 1) % 3 + 1 AS w
      FROM (SELECT sk, sum(size)::BIGINT AS source_size, count(*) AS n FROM t GROUP BY sk)),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY cap::DOUBLE / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w, sum(source_size) OVER () AS total FROM s WHERE source_size > 0),
f AS (SELECT capped, rest_w FROM o WHERE (total - capped) * w <= cap * rest_w ORDER BY capped LIMIT 1),
g AS (SELECT s.sk, source_size, n, CASE WHEN o.sk IS NULL THEN 0.0 WHEN o.capped < f.capped THEN s.cap::DOUBLE
             ELSE least(((o.total - f.capped) * s.w)::DOUBLE / f.rest_w, s.cap::DOUBLE) END AS target FROM s LEFT JOIN (SELECT sk, capped, total FROM o) o USING (sk) LEFT JOIN f ON true),
p AS (SELECT *, greatest(1, least(4096, (n + 255) // 256)) AS n_blocks, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM g),
q AS (SELECT *, greatest(target - passes * source_size, 0.0) AS rest FROM p),
b AS (SELECT t.*, source_size, target, passes, rest, ((u >> 20) * n_blocks) >> 40 AS block FROM t JOIN q USING (sk)),
tot AS (SELECT *, sum(bs) OVER (PARTITION BY sk ORDER BY block) AS upto FROM (SELECT sk, block, sum(size) AS bs, max(rest) AS rest FROM b GROUP BY sk, block)),
cut AS (SELECT sk, min(block) AS cut, min_by(rest - upto + bs, block) AS part FROM tot WHERE upto > rest GROUP BY sk),
i AS (SELECT b.sk, doc_id, size, u, part, sum(size) OVER (PARTITION BY b.sk ORDER BY size DESC, u DESC) <= part AS large,
             sum(size) OVER (PARTITION BY b.sk ORDER BY size, u) - size / 2.0 AS below FROM b JOIN cut ON cut.sk = b.sk AND cut.cut = b.block),
e AS (SELECT sk, doc_id FROM (SELECT *, coalesce(sum(size) FILTER (large) OVER (PARTITION BY sk), 0) AS filled FROM i) WHERE large OR below <= part - filled)
SELECT b.doc_id, size, source_size, target, (size * (passes + CASE WHEN rest > 0 AND (cut.cut IS NULL OR block < cut.cut OR e.doc_id IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b LEFT JOIN cut ON cut.sk = b.sk LEFT JOIN e ON e.sk = b.sk AND e.doc_id = b.doc_id AND b.block = cut.cut
"""


@query("op2_mixing", MIXING_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_report(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_records")
def op8_records(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path, files = public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark)
    index = records.write_records(table(spark, folder, "documents"), files, path, end_id=1)
    digests = records.read_records(index, files, path).select("shard", "place", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return records.with_start(stored(digests)).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_pieces")
def op7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = pieces.decode_pieces(pieces.encode_pieces(docs, model), model)
    return decoded.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size("ids").cast("bigint").alias("n_pieces"),
                          F.xxhash64("ids").alias("ids_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.join(labels, "doc_id").filter(~held_out))
    slim = toxicity.score(docs, model).select("doc_id", "score")
    return slim.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_passages")
def op5_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def fetched_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a fetch day, spread over two years by their id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"))
    return table(spark, folder, "pages").select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own sites: of every third host, first path part and domain, drawn by a digest, an addition, for
    most of them a later removal, and for some a second addition."""
    host = url_lists.host_of(F.col("url"))
    step = F.regexp_extract(url_lists.path_of(F.col("url")), "^(/[^/]*)", 1)
    rules = F.array(F.concat(F.lit("domain:"), host), F.concat(F.lit("prefix:"), host, step),
                    F.concat(F.lit("domain:"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)))
    sites = pages.select(F.explode(rules).alias("rule")).distinct()
    draw = lambda at, n: F.conv(F.substring(F.md5("rule"), at, 6), 16, 10).cast("int") % n
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first, gone, again = draw(7, 500), draw(13, 120) + 1, draw(19, 200) + 1
    entry = lambda action, n: F.struct(F.lit(action).alias("action"), day(n).alias("day"))
    dated = F.array(entry("add", first), F.when(draw(25, 4) > 0, entry("remove", first + gone)),
                    F.when(draw(25, 4) > 1, entry("add", first + gone + again)))
    return sites.filter(draw(1, 3) == 0).select(F.lit("drawn").alias("list"), "rule", F.explode(F.array_compact(dated)).alias("e")).select("list", "rule", "e.*")


URL_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS fetched,
                  regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT DISTINCT unnest(['domain:' || host, 'prefix:' || host || regexp_extract(path, '^(/[^/]*)', 1), 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1)]) AS rule FROM p),
d AS (SELECT rule, ('0x' || substr(md5(rule), 1, 6))::BIGINT % 3 AS pick, ('0x' || substr(md5(rule), 7, 6))::BIGINT % 500 AS first,
             ('0x' || substr(md5(rule), 13, 6))::BIGINT % 120 + 1 AS gone, ('0x' || substr(md5(rule), 19, 6))::BIGINT % 200 + 1 AS again,
             ('0x' || substr(md5(rule), 25, 6))::BIGINT % 4 AS more FROM s),
v AS (SELECT rule, first AS since, CASE WHEN more > 0 THEN first + gone ELSE 100000 END AS until FROM d WHERE pick = 0
      UNION ALL SELECT rule, first + gone + again, 100000 FROM d WHERE pick = 0 AND more > 1),
k AS (SELECT page_id, fetched - DATE '2024-01-01' AS n, 'domain:' || array_to_string(l[i:], '.') AS rule
      FROM (SELECT page_id, fetched, string_split(host, '.') AS l, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM p WHERE host <> '')
      UNION SELECT page_id, fetched - DATE '2024-01-01', 'prefix:' || host || array_to_string(l[1:i], '/')
      FROM (SELECT page_id, fetched, host, string_split(path, '/') AS l, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM p WHERE host <> '')),
h AS (SELECT page_id, count(*) AS n_rules, min(v.rule) AS first_rule FROM k JOIN v ON v.rule = k.rule AND since <= n AND n < until GROUP BY page_id)
SELECT page_id, url, fetched, coalesce(n_rules, 0)::INTEGER AS n_rules, first_rule, n_rules IS NOT NULL AS blocked FROM p LEFT JOIN h USING (page_id)
"""


@query("op1_url_lists", URL_SQL)
def op1_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = fetched_pages(spark, folder)
    judged = url_lists.listed(pages, derived_entries(pages))
    return judged.select("page_id", "url", "fetched", F.size("listed").alias("n_rules"), F.get("listed", F.lit(0))["rule"].alias("first_rule"),
                         (F.size("listed") > 0).alias("blocked"))


query("op11_repair", structure_queries.REPAIR_SQL)(structure_queries.op11_repair)
query("op12_runs")(structure_queries.op12_runs)
query("op13_passages")(structure_queries.op13_passages)
QUERIES["pipeline"] = corpus_pipeline.run
