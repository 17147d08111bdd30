"""Paths that clean-up may delete, the entry's guard, and fonts that can't be parsed."""

import subprocess
import sys
from pathlib import Path

from quire.operators import jobs
from quire.sources import ttf

TOP = Path(__file__).resolve().parents[1]


def test_safe_paths(spark):
    from pyspark.sql import functions as F

    want = {"/tmp/a": True, "/tmp/a/../b": True, "/tmp/./a//b": True, "/tmp": False, "/tmp/": False, "/tmp//": False, "/tmp/..": False, "/tmp/a/..": False, "/tmp/../etc": False, "/tmp_evil/x": False, "tmp/a": False, "../tmp/a": False, "/x/../tmp/a": True, "": False, "/": False, None: False}
    rows = spark.createDataFrame([(p,) for p in want], "p string").select("p", jobs.safe_path(F.col("p"), "/tmp", "/data/app/").alias("safe"))
    assert {r.p: r.safe for r in rows.collect()} == want


def test_entry_hides_only_an_absent_subpackage(tmp_path):
    """Without the subpackage the entry imports; with a broken one it must not."""
    import shutil

    for name in ("quire", "__spark_entry__.py"):
        (shutil.copytree if (TOP / name).is_dir() else shutil.copy)(TOP / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "quire/llm", ignore_errors=True)
    assert run().returncode == 0
    (tmp_path / "quire/llm").mkdir()
    (tmp_path / "quire/llm/__init__.py").touch()
    (tmp_path / "quire/llm/registry.py").write_text("from quire.llm import gone\nimport quire.llm.gone_too\n")
    assert run().returncode != 0


def test_unreadable_fonts_are_used_whole():
    assert ttf.subset_or_whole(b"no font at all", "abc") == b"no font at all"
