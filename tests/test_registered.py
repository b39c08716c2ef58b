"""Every registered query against its SQL twin, and the flagship query."""

import __spark_entry__ as entry
import pytest

from suite.check import compare

SMALLEST = "/root/testdata/sf0.001"


OWN = {name for module in entry.MODULES for name in module.register.queries}


@pytest.mark.parametrize("name", sorted(OWN))
def test_equals_sql(spark, name):
    message, _, _ = compare(spark, SMALLEST, name)
    assert message.startswith("ok"), message


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert OWN <= set(entry.oracle_sql())
