import pytest
from oracle import DATA, compare

from tessella import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs_and_repeats(spark, name):
    run = lambda: sorted(map(str, registry.queries()[name](spark, DATA).collect()))
    first = run()
    assert first
    if name not in ("kmeans_routed",):
        assert first == run()
