"""Every registered query against its check SQL, and the coverage of the inventory."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from compare import difference, oracle_connection
from tidelog.plans.registry import load_all

QUERIES = {name: query.run for name, query in load_all().items()}
ORACLES = {name: query.oracle for name, query in load_all().items() if query.oracle}
INVENTORY = ([f"SRC-{i}" for i in range(1, 8)] + [f"SNK-{i}" for i in range(1, 4)] + [f"ING-{i}" for i in range(1, 17)]
             + [f"SCP-{i}" for i in range(1, 7)] + [f"SRH-{i}" for i in range(1, 12)] + [f"AN-{i}" for i in range(1, 14)]
             + [f"AC-{i}" for i in range(1, 13)] + [f"DET-{i}" for i in range(1, 11)] + [f"RT-{i}" for i in range(1, 4)]
             + [f"INC-{i}" for i in range(1, 9)] + [f"LC-{i}" for i in range(1, 7)] + [f"ST-{i}" for i in range(1, 9)])


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_check(name, spark, sf_dir, con):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_check_gives_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_inventory_entry_has_a_query():
    assert set(INVENTORY) == {q.inventory for q in load_all().values()}


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


def test_names_are_plain():
    assert not [n for n in QUERIES if re.search(r"pipeline|^op\d+_", n)]


def test_every_query_is_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("gone", [["tidelog/llm", "tests/llm"], ["tidelog/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_stands_without_the_corpus_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(os.path.dirname(os.path.abspath(contract.__file__)), copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"],
                         cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]


def test_entry_does_not_hide_a_broken_import(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(os.path.dirname(os.path.abspath(contract.__file__)), copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    (copy / "corpus_pipeline.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module" in out.stderr
