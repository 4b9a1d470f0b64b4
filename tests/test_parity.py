"""Every query with SQL agrees with DuckDB over whole tables; the others give rows."""

import pytest
from parity import difference

from kgloom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, small, name):
    assert difference(spark, small, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_lines_parse_again(spark, small):
    lines, back = QUERIES["export_triples"](spark, small), QUERIES["nt_roundtrip"](spark, small)
    from kgloom.operators.rdf import ntriples

    assert ntriples(back).exceptAll(lines).isEmpty() and back.count() == lines.count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
