"""The registered queries on the smallest data set: against DuckDB text, or against what their contract says of every row."""

import os

import duckdb
import pytest

import corpus_pipeline
from lociary.llm import queries

DATA = os.environ.get("LOCIARY_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")

COLUMNS = {
    "op2": ["page_id", "host", "path", "rule", "verdict"], "op4": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["doc_id", "held_out", "score", "predicted"], "op9": ["doc_id", "n_shingles", "component_id"],
    "op10": ["vec_id", "n_links", "component_id", "kept"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}
NOT_BY_ROW = ("op1", "op12")
TABLE = {"op2": "pages", "op3": "conversations", "op6": "pages", "op10": "embeddings"}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_one_row_per_row_of_the_table(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    number = name.split("_")[0]
    assert df.columns[: len(COLUMNS.get(number, []))] == COLUMNS.get(number, [])
    if number not in NOT_BY_ROW:
        assert df.count() == spark.read.parquet(f"{DATA}/{TABLE.get(number, 'documents')}.parquet").count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    known = lambda row: tuple(("", "") if v is None else ("v", round(v, 9) if isinstance(v, float) else v) for v in row)
    assert sorted(known(r[c] for c in columns) for r in df.collect()) == sorted(map(known, cursor.fetchall()))


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
