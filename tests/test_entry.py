"""The entry module works with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "orderflow_daily" in e.queries()


def test_without_subpackage(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("tidemark", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tidemark").mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidemark" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'orderflow_daily' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), **{k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA")}})
