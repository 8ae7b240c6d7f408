"""Every registered query against its oracle SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
import check
from fieldloom.plans import catalog
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return check.oracle(SMALL)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    text = entry.oracle_sql().get(name)
    if text is None:
        assert df.count() > 0
    else:
        assert check.compare(df, con, text) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rec_id", "win_logit", "win_probability"] and df.count() > 0


def test_only_fits_are_without_oracle():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"fit_network", "fit_win", "fit_two_sample"}
