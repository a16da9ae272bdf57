"""The driver's contract: queries, oracles and the guard around the corpus operators."""

import importlib
import sys

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def registry():
    from listwright.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if type(v).__name__.startswith(("int", "float", "uint")):
        return format(float(v), ".11g")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry()[0]))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    queries, oracles = registry()
    got = queries[name](spark, SF).toPandas()
    if name in oracles:
        expected = duck.execute(oracles[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_rest_works_without_the_corpus_operators(monkeypatch):
    import __spark_entry__

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith(("listwright.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name="listwright.llm" if name.startswith("listwright") else name)
        return real(name, *a)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    queries = __spark_entry__.queries()
    assert queries and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in queries)
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_a_broken_import_inside_is_no_absence(monkeypatch):
    import __spark_entry__

    def broken(name, *a):
        raise ModuleNotFoundError(name="listwright.llm.simhash")

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_nothing_else_imports_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__file__).parents[1]
    for path in (root / "listwright").rglob("*.py"):
        if "llm" not in path.parts:
            assert "listwright.llm" not in path.read_text(encoding="utf-8"), path
    assert sys.modules["listwright"].__file__
