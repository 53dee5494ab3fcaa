"""Every registered query against its SQL; queries without SQL must run and return rows."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry
from gridweave.catalog import all_oracles, all_queries, inputs
from gridweave.plans import train

QUERIES, SQL = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, sf):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert len(QUERIES[name](spark, sf).toPandas()) > 0


def test_shared_pass_equals_separate_fits(spark, sf):
    wide = inputs.stored_wide(spark, sf)
    data, shared = train.fit_wide(wide, inputs.VALIDATION_START, inputs.TRAIN_END)
    alone = train.fit_horizons(list(data.values()))
    for h, d in data.items():
        both = [{r["split"]: (r["rows"], r["rmse"]) for r in train.fit_diagnostics(train.score_fit_data(d, m[h]), d.target).collect()} for m in (shared, alone)]
        assert both[0].keys() == both[1].keys() and len(both[0]) == 3
        for split, (n, rmse) in both[0].items():
            assert both[1][split][0] == n and both[1][split][1] == pytest.approx(rmse, rel=1e-6)
