"""The driver's contract, with the training-data subpackage and without it."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom import storage
from sparkloom.plans.catalogue import QUERIES

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, keep_pipeline):
    """In a copy of the repository without the folder, with corpus_pipeline.py left behind or not."""
    shutil.copytree(REPO / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ["__spark_entry__.py", *(["corpus_pipeline.py"] if keep_pipeline and (REPO / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(REPO / f, tmp_path / f)
    code = "import __spark_entry__ as e; assert not e.HAS_PIPELINE and not e.HAS_LLM; e.oracle_sql(); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)


def test_scratch_tables_go(spark):
    with storage.scratch(spark):
        gone, path = storage.reread(spark.range(10).toDF("a"), "test-gone")
        kept = storage.materialize(gone.filter("a > 3"), "test-kept", outlive=True)
    assert kept.count() == 6
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_held_bytes_grow_with_lists(spark):
    rows = spark.range(100).select("id", F.sequence(F.lit(1), F.lit(1000)).alias("xs"), F.lit("abc").alias("s"))
    assert 100 * 8000 < storage.held_bytes(rows) < 100 * 9000
    assert storage.held_bytes(rows.limit(0)) == 0
