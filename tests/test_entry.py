from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(before: str) -> list[str]:
    code = f"import sys; {before}; import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()


def test_entry_works_without_the_training_data_package():
    """The other queries are the same with and without it."""
    without = names("sys.modules['corpus_pipeline'] = None; sys.modules['panelloom.llm'] = None")
    whole = names("pass")
    assert "M6_pooled_wape" in without and not [n for n in without if n == "pipeline" or n.startswith("op")]
    assert whole[: len(without)] == without
