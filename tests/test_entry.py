import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "mailglass", tmp_path / "mailglass", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 50, out.stderr


def test_nothing_outside_imports_llm():
    for p in (ROOT / "mailglass").rglob("*.py"):
        if "llm" not in p.parts:
            assert "mailglass.llm" not in p.read_text(), p
