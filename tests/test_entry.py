"""The registered queries, and that the library stands without its text subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_stands_without_the_text_subpackage(tmp_path):
    shutil.copytree(ROOT / "talus", tmp_path / "talus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_entry_stands_without_optional_packages(tmp_path):
    shutil.copytree(ROOT / "talus", tmp_path / "talus", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    (tmp_path / "ahocorasick.py").write_text("raise ModuleNotFoundError('gone', name='ahocorasick')\n")
    run = lambda code, **more: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120, **more)
    run("import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q)", check=True)
    (tmp_path / "talus" / "llm" / "hashing.py").unlink()  # a fault of its own is raised
    (tmp_path / "ahocorasick.py").unlink()
    assert run("import __spark_entry__ as e; e.queries()", capture_output=True).returncode != 0


def test_nothing_else_imports_the_text_subpackage():
    for path in (ROOT / "talus").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "talus").parts:
            assert "talus.llm" not in path.read_text(), path
