"""The driver's entry can be read without a session, and runs."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 250; print(*q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6, 7)} <= set(said.stdout.split())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["device_id", "gap_start_ms", "gap_end_ms"] and entry.entry(spark).count() > 0
