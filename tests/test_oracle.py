"""Registered queries against their DuckDB SQL on the smallest scale factor."""
import duckdb
import pytest

import __spark_entry__ as E
from quill.sources.tables import TABLES
from tests.conftest import SF_SMALL

KEYS = ["tokenize", "clean_text", "stratified_split", "fit_vocabulary", "bow_train", "random_oversample",
        "smote_dense", "encode_sequences", "classification_report", "coherence_cv",
        "abbreviations", "tokenize_abbreviated", "csv_round_trip", "oversample_strategies", "balance_fallback"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _v(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return v


def _canon(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(_v(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF_SMALL).toPandas()
    dd = con.execute(E.oracle_sql()[key]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert _canon(sp) == _canon(dd)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "processed_content" in df.columns
