"""Every core query with SQL against DuckDB; the others at least run."""

import pytest

from helpers import compare
from tallyforge.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, data, name):
    compare(spark, duck, data, registry.QUERIES[name], registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).collect() is not None


def test_oracle_has_only_known_names():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_core_does_not_import_llm():
    from pathlib import Path

    import tallyforge

    for p in Path(tallyforge.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "tallyforge.llm" not in p.read_text(), p
