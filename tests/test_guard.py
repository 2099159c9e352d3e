"""Nothing outside the training-data subpackage imports it; the entry point works with and without it."""

import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "voxelmill").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_entry_point_without_the_subpackage(tmp_path):
    """Also that no module needs a session to be imported."""
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if "llm" in rel.parts or rel.name == "corpus_pipeline.py" or rel.parts[0] not in ("voxelmill", "__spark_entry__.py"):
            continue
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(p.read_text())
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(s) <= set(q) and not any(n.startswith('op') for n in q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert "fine" in done.stdout, done.stderr


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["l_suppkey", "score_total", "selected"] and df.where("selected").count() == 1
