"""Every registered query against its DuckDB oracle at sf0.01 (what the driver checks)."""

from __future__ import annotations

import os

import oracle_compare
import pytest

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="test data missing")
def test_all_queries_match_oracle(spark):
    import __spark_entry__ as E

    queries, oracles = set(E.queries()), set(E.oracle_sql())
    assert oracles <= queries
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}  # the corpus part has its own tests
    assert own <= oracles, "every query of the analysis has an oracle"
    res = oracle_compare.compare(spark, SF, sorted(own), verbose=False)
    bad = {k: {x: y for x, y in r.items() if not x.startswith("_")} for k, r in res.items() if r["status"] != "match"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["target_id", "rank", "freq", "n_runs", "share_pct", "length", "pattern_text", "display"]
    assert len(rows) >= 0
