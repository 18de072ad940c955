import pytest

import __spark_entry__ as entry
from rolescope.plans import catalogue
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    oracle.check(spark, catalogue.queries(), catalogue.oracle_sql(), name, data)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    assert df.columns and (df.count() > 0 or name in ("audit_near", "audit_review"))  # the smallest tables may hold no near names


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_optional_package():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"(?:import|from)\s+[\w.]*\bllm\b", path.read_text()), path
