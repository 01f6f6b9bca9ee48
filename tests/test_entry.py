"""The entry module with and without the optional part."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(code: str) -> list[str]:
    script = f"import sys; sys.path.insert(0, {ROOT!r}); {code}; import __spark_entry__ as e; print('NAMES', *e.queries())"
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd="/", timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split("NAMES")[1].split()


def test_entry_works_without_the_corpus_part():
    for gone in ("stationflow.llm", "corpus_pipeline"):
        got = names(f"sys.modules[{gone!r}] = None")
        assert "hourly_flows" in got and "pipeline" not in got
        assert not [n for n in got if n.startswith("op") and n[2].isdigit()]


def test_other_import_errors_are_not_hidden():
    script = f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules['stationflow.session'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd="/", timeout=120)
    assert out.returncode != 0 and "stationflow.session" in out.stderr
