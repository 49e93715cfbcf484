"""The registered queries of the subpackage against their SQL."""

import datetime
from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda x: round(x, 6) if isinstance(x, float) else str(x) if isinstance(x, datetime.datetime) else x
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def views(sf_dir=SF):
    db = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    return db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    want = views().execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)
