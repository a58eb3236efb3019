"""The driver's contract without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "b11_stats_by" in names and len(names) > 160
assert {present!r} == ("op1_line_dedup" in names), sorted(names)
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("blocked", ["xxhash", "regex", "claimweave.llm", "corpus_pipeline", "public_tokenizers"])
def test_queries_without_an_optional_module(blocked):
    root = Path(__file__).resolve().parent.parent
    # Without the operators' folder nothing of them can be there.
    present = blocked in ("corpus_pipeline", "public_tokenizers") and (root / "claimweave/llm/queries.py").exists()
    done = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked, present=present)], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
