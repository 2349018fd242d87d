import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_subpackage(tmp_path):
    """What is left when the subpackage and the pipeline are deleted still imports, and nothing in it mentions them."""
    import shutil

    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    n, ten = map(int, out.stdout.split())
    assert n > 80 and ten == 0
    for p in (tmp_path / "repo/pressroom").rglob("*.py"):
        assert "llm" not in p.read_text(), p
