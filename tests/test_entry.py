from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent
DATA = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert {*sql} <= {*queries} and len(queries) > 50


def test_flagship(spark):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    assert entry.entry(spark).count() > 0


def test_library_stands_without_the_training_data_operators(tmp_path):
    for name in ("crawlgrain", "__spark_entry__.py"):
        src = ROOT / name
        subprocess.run(["cp", "-r", str(src), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "crawlgrain" / "llm")], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in e.queries()) and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    assert not [p for p in (ROOT / "crawlgrain").rglob("*.py") if "llm" not in p.parts and "crawlgrain.llm" in p.read_text()]
