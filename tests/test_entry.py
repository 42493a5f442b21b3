"""The driver contract, with and without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


def test_entry_without_the_text_operators(tmp_path):
    for part in ROOT.iterdir():
        if part.name in ("__spark_entry__.py", "spanloom"):
            target = tmp_path / part.name
            if part.is_dir():
                target.mkdir()
                for inner in part.iterdir():
                    if inner.name not in ("llm", "__pycache__"):
                        (target / inner.name).symlink_to(inner)
            else:
                target.write_text(part.read_text())
    code = "import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; assert len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
