"""Without the training-data subpackage and its pipeline the rest imports and registers its queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_rest_stands_alone(tmp_path):
    for name in ("reelframe", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "reelframe/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_retrieve' in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "reelframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
