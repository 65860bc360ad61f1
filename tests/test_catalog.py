"""Every registered query runs and, where it has SQL, gives the same rows."""

from __future__ import annotations

import duckdb
import pytest

from lodestone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    from compare import plain

    df = catalog.QUERIES[name](spark, sf_dir)
    got = sorted(repr(sorted(zip(df.columns, map(plain, r)))) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    assert got == sorted(repr(sorted(zip(cols, map(plain, r)))) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
