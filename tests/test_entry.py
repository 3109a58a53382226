from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_everything_else_works_without_the_corpus_operators(tmp_path):
    for name in ("quillgraph", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for pipeline in (True, False):
        for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if pipeline else [])):
            shutil.copy(ROOT / name, tmp_path / name)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q); assert 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
