"""Every registered query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lexmill.plans import derived, dictionary, files, more, ranges  # noqa: F401
from lexmill.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query(spark, con, name):
    run, sql = REGISTRY[name]
    ours, theirs = run(spark, SF), con.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    assert Counter(tuple(plain(r[c]) for c in names) for r in ours.collect()) == Counter(tuple(map(plain, r)) for r in theirs.fetchall())
