"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from strandline.plans import api
from strandline.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier nation part orders lineitem events documents"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None or v != v else str(round(float(v), 6)) if not isinstance(v, str) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns and ours
    assert ours == sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())


def test_flagship_has_no_window(spark, duck, monkeypatch):
    monkeypatch.setattr(api, "GROUP_MOST", 20)
    ours = sorted(tuple(r) for r in QUERIES["damage_by_actor"](spark, DIR).collect())
    assert sum(r[1] for r in ours) > 20
    assert ours == sorted(duck.execute(f"SELECT key, events, damage, crits, crit_damage FROM ({ORACLE_SQL['damage_by_actor']})").fetchall())
