"""Every plan on the smallest tables, against its SQL where it has some."""

import math

import duckdb
import pytest

from inkwell import plans

MODULES = {m.__name__.rsplit(".", 1)[-1]: m for m in plans.query_modules()}


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return float(value) if isinstance(value, int) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    import os

    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return c


@pytest.mark.parametrize("module", MODULES)
def test_plans(spark, sf, duck, module):
    m = MODULES[module]
    assert set(m.ORACLES) <= set(m.QUERIES)
    for name, query in m.QUERIES.items():
        df = query(spark, sf)
        columns = sorted(df.columns)
        rows = df.select(*columns).collect()
        if name in m.ORACLES:
            answer = duck.execute(m.ORACLES[name])
            order = [x[0] for x in answer.description]
            assert sorted(order) == columns, name
            want = [tuple(plain(r[order.index(c)]) for c in columns) for r in answer.fetchall()]
            got = [tuple(plain(v) for v in r) for r in rows]
            assert sorted(got, key=repr) == sorted(want, key=repr), name
