"""The package works without its optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from larkspur.operators import graph

ROOT = Path(__file__).parent.parent


def test_queries_without_the_text_subpackage(tmp_path):
    for name in ("larkspur", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name) if (ROOT / name).exists() else None
    shutil.rmtree(tmp_path / "larkspur/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="checkpoint"):
        graph.cut(Frame())
