"""Every query that has SQL gives the rows of its SQL."""

import duckdb
import pytest

from leakscan.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = [tuple(None if v != v else v for v in r) for r in got[columns].itertuples(index=False)]
    assert sorted(got, key=key) == sorted(want, key=key)
