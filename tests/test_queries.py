import subprocess
import sys
from pathlib import Path

import pytest

from timbrel.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL.get(name))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_core_does_not_import_the_optional_package():
    root = Path(__file__).resolve().parents[1]
    code = "import sys, timbrel, timbrel.plans.registry, timbrel.streaming.scoring, timbrel.sources.corpora; assert not any('llm' in m for m in sys.modules if m.startswith('timbrel'))"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["feature", "bin", "n"] and df.count() > 0
