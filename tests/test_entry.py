"""The entry works without the corpus part."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_corpus_part():
    code = ("import sys; sys.modules['precursor.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql()\n"
            "assert len(q) >= 62 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
