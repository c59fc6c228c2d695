import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_match():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert len(entry.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["uri", "rule_id", "severity", "n", "first_line"]


def test_imports_without_a_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 50"], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root})


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_release(spark):
    entry.queries()["graph_best_root"](spark, SF).count()
    paths = [p.removeprefix("file:") for p in entry.graph._written]
    assert paths
    entry.release(spark)
    assert not entry.graph._written and not any(map(os.path.exists, paths))
