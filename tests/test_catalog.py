"""Every registered query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from hustings.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 9))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3


def test_optional_parts_may_be_missing(monkeypatch):
    real = __spark_entry__.importlib.util.find_spec
    monkeypatch.setattr(__spark_entry__.importlib.util, "find_spec", lambda n, *a: None if n.startswith("hustings.llm") or n == "corpus_pipeline" else real(n, *a))
    assert set(__spark_entry__.queries()) == set(catalog.queries())
    assert set(__spark_entry__.oracle_sql()) == set(catalog.oracle_sql())


def test_the_library_imports_nothing_optional():
    from pathlib import Path

    import hustings

    root = Path(hustings.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text(encoding="utf-8")]
