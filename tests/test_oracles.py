"""Every registered query against its SQL on the same tables."""

from __future__ import annotations

import duckdb
import pytest

from loomgraph.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    columns = sorted(pdf.columns)

    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, float) else int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v

    return columns, sorted(str([plain(v) for v in r]) for r in pdf[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    found = rows(QUERIES[name](spark, small).toPandas())
    if name in ORACLES:
        assert found == rows(db.sql(ORACLES[name]).df())
