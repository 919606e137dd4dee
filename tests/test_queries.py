"""Every registered query against its SQL in DuckDB; the others run and give rows."""

import glob
import os

import pytest

from tidemark import plans

DATA = "/root/testdata/sf0.001"
MODULES = plans.MODULES


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def same(df):
    """Rows with columns by name, every value as text; floats to six significant digits."""

    def told(v):
        if v is None or v != v:
            return None
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    names = sorted(df.columns)
    return names, sorted((tuple(told(v) for v in row) for row in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("module", MODULES)
def test_queries(spark, duck, module):
    import importlib

    m = importlib.import_module(f"tidemark.plans.{module}")
    assert set(m.ORACLE_SQL) <= set(m.QUERIES)
    for name, query in m.QUERIES.items():
        got = query(spark, DATA)
        if name in m.ORACLE_SQL:
            assert same(got.toPandas()) == same(duck.execute(m.ORACLE_SQL[name]).df()), name
        else:
            assert got.count() > 0, name


def test_entry_works_without_the_llm_folders(spark):
    """The entry point must import and list the other queries when the llm subpackage is gone."""
    import subprocess
    import sys

    code = (
        "import sys; sys.modules['tidemark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\n"
        "assert 'past_window_counts' in q and not any(k.startswith('op') or k == 'pipeline' for k in q), q\nassert set(o) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_text_stats_on_odd_words(spark, tmp_path):
    """Syllables of odd words, and words without end: no pattern may recurse once for each sign."""
    import random

    import duckdb

    from tidemark.plans import text

    r = random.Random(4)
    words = ["absentee", "employee", "banana", "e", "ee", "idea", "eye", "queue", "Été", "a-b", "x1y2", "separate", "bureaucracy", "rhythm"]
    rows = [" ".join(r.choice(words) + r.choice(["", ".", "! ", "e", "ate"]) for _ in range(80)) for _ in range(60)] + ["ba" * 500_000 + " word" * 60, "e" * 1_000_000 + " word" * 60, "word " * 60 + "." * 1_000_000, "1" * 1_000_000 + " is one" * 60]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert same(text.QUERIES["text_stats"](spark, str(tmp_path)).toPandas()) == same(c.execute(text.ORACLE_SQL["text_stats"]).df())
    for name in ("text_flags", "text_flags2", "tone"):
        assert text.QUERIES[name](spark, str(tmp_path)).count() >= 0
