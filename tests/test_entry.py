import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_a_stable_schema(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "text"]
    assert got.take(1)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    for name in ("millrace", "__spark_entry__.py", "bench.py"):
        at = ROOT / name
        if at.is_dir():
            shutil.copytree(at, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(at, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80, len(q); assert not [n for n in q if n.startswith('op1') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("llm_", ""), path
