"""Every query of the catalogue against its SQL on the smallest tables, and the plans of a few."""

from __future__ import annotations

import glob
import os

import pytest

from pagewright.plans import catalogue

D = "/root/testdata/sf0.001"


def plain(value):
    if value is None:
        return ("",)
    if isinstance(value, bool):
        return ("b", value)
    return ("n", round(float(value), 9)) if isinstance(value, int | float) else ("s", str(value))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, D)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()) == rows


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    scan = plan(catalogue.queries()["q01_scan_filter_project"](spark, D))
    assert "PushedFilters: [IsNotNull(lang), IsNotNull(n_chars), EqualTo(lang,en), GreaterThanOrEqual(n_chars,200)]" in scan and "text" not in scan
    for name in ("q11_detect_language", "q16_split_sentences", "q21_parse_reply", "q31_hit_test"):
        assert "Python" not in plan(catalogue.queries()[name](spark, D)) and "Arrow" not in plan(catalogue.queries()[name](spark, D))
    for name, query in catalogue.queries().items():
        if name not in ("q34_translate",):
            text = plan(query(spark, D))
            assert "CartesianProduct" not in text, name


def test_flagship(spark):
    assert catalogue.flagship(spark, D).count() > 5


def test_everything_else_stands_without_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/pagewright/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path, encoding="utf-8") as file:
                text = file.read()
            assert "from .llm" not in text and "from ..llm" not in text and "pagewright.llm" not in text, path
