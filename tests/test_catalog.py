"""Every registered query with reference SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from conftest import ROOT, SF
from docquarry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return repr(round(float(value), 9)) if isinstance(value, int | float) else str(value)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_entry_points_without_the_training_data_operators(tmp_path):
    """The other queries stay when that subpackage is gone and the pipeline's file is not."""
    shutil.copytree(f"{ROOT}/docquarry", tmp_path / "docquarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalog.QUERIES), set(e.oracle_sql()) == set(e.catalog.ORACLES))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True"], said.stderr


def test_scan_is_pruned_and_pushed(spark):
    plan = catalog.filter_doc(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_top_k_needs_no_full_sort(spark):
    plan = catalog.vector_nearest(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
