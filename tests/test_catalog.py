"""Views and table functions for SQL."""

import pytest

from votecount import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def names(spark):
    return catalog.register_folder(spark, SF)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_view_and_function_is_there(spark, names):
    assert names == [*catalog.VIEWS, *catalog.FUNCTIONS]
    assert set(catalog.VIEWS) <= {t.name for t in spark.catalog.listTables()}


def test_filters_reach_the_scan(spark, names):
    plan = _plan(spark.sql("SELECT codigo_acta FROM high_abstention(30.0) WHERE recinto = 'Customer#000000005'"))
    assert "c_name,Customer#000000005" in plan and "EqualTo" in plan
    plan = _plan(spark.sql("SELECT * FROM mesas WHERE codigo_recinto = 5"))
    assert "EqualTo(o_custkey,5)" in plan


def test_a_limit_by_parameter_is_a_limit(spark, names):
    assert "TakeOrderedAndProject(limit=3" in _plan(spark.sql("SELECT * FROM top_precincts('P1', 3)"))


def test_parameters(spark, names):
    count = lambda q: spark.sql(f"SELECT count(*) FROM {q}").first()[0]
    assert count("top_precincts('P3', 4)") == 4
    assert count("top_precincts('P3')") == count("top_precincts('P3', 0)") == 5
    assert spark.sql("SELECT max(votos) FROM top_precincts('nobody', 9)").first()[0] == 0
    assert count("high_abstention()") == count("high_abstention(20.0)") == count("high_abstention(-1.0)")
    assert count("high_abstention(1000.0)") == 0
    assert count("votes_below('La Paz')") == spark.sql(
        "SELECT count(DISTINCT municipio) FROM transcripciones WHERE departamento = 'La Paz'").first()[0]
    assert count("votes_below(NULL, 'BUILDING')") == 1


def test_functions_need_their_views(spark):
    assert catalog.register(spark, {"mesas": spark.range(1)}) == ["mesas"]
    catalog.register_folder(spark, SF)
