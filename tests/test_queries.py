"""Every registered query of the library against its SQL twin, and the entry point."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from feedlens.plans import registry
from tests.compare import oracle, same

NAMES = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        same(found, oracle(sf_dir, registry.ORACLES[name]))
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_subpackage(tmp_path):
    """A copy of the repository without its folders still lists every query of the library."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "feedlens", tmp_path / "feedlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert int(told.stdout) == len(registry.QUERIES)
