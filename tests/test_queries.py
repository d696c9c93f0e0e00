"""Every registered query of the document engine against its SQL."""

import math

import pytest
from compare import connect, differences
from conftest import SF

from foliant.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLE_SQL
    assert differences(spark, con, QUERIES[name], ORACLE_SQL[name], SF) is None


def test_blend_fold_takes_all_paints(spark):
    """By brute force over every event of each user, far more than four."""
    painted, n = {}, {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: r.event_id):
        d, c, a = painted.get(r.user_id, 255), math.floor(r.value) % 256, r.event_id % 256
        painted[r.user_id], n[r.user_id] = (d * (255 - a) + c * a + 127) // 255, n.get(r.user_id, 0) + 1
    assert max(n.values()) > 4
    assert {r.user_id: r.painted for r in QUERIES["alpha_blend_fold_all"](spark, SF).collect()} == painted


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
