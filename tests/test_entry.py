import pytest

import __spark_entry__ as entry

from .helpers import same

CORE = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.mark.parametrize("name", [k for k in CORE if k in entry.oracle_sql()])
def test_against_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    same(got, duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [k for k in CORE if k not in entry.oracle_sql()])
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).schema.names[0] == "mutantName"
