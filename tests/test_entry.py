import __spark_entry__
from callgauge.plans import registry


def test_registry_is_consistent(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and set(registry.queries()) <= set(known)
    assert __spark_entry__.entry(spark).count() > 0
