import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_registered():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 50


def test_base_stands_without_the_text_operators(tmp_path):
    """A copy without them imports, and keeps every other query."""
    for p in ("__spark_entry__.py", "readloom"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    if (tmp_path / "readloom/llm").exists():
        (tmp_path / "readloom/llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') and n[2].isdigit()])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip().endswith("[]")


def test_flagship(spark):
    assert __spark_entry__.entry(spark).columns == ["region", "start", "end", "depth"]
