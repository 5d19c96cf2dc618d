from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from barloom.llm.queries import QUERIES, SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(SQL[name]).df())


def test_stages_keep_columns(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert out and ids <= {r.doc_id for r in docs.collect()} and not ids & {300, 301, 302, 303}
    assert all(r.n_pieces == len(r.ids) for r in out)


def test_empty(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
