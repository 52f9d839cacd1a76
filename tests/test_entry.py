"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "count"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    hide = "import sys; sys.modules['crawlspan.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); print('fine')"
    out = subprocess.run([sys.executable, "-c", hide], cwd=REPO, capture_output=True, text=True, timeout=100)
    assert out.stdout.strip() == "fine", out.stderr
