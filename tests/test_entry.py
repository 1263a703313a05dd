"""The driver's contract: every query runs, and agrees with its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from sedge import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, data, name):
    out = catalog.QUERIES[name](spark, data).toPandas()
    assert len(out)
    if name in catalog.SQL:
        db = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
        want = db.execute(catalog.SQL[name]).df()
        assert sorted(want.columns) == sorted(out.columns)
        by = sorted(out.columns)
        plain = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df[by].itertuples(index=False))
        assert plain(out) == plain(want)
