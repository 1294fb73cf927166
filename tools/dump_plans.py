"""Print the physical plans of the pipeline's stages (input to PLANS.md).

Usage: python tools/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from precursor.operators import anchors as AN  # noqa: E402
from precursor.operators import evidence as EV  # noqa: E402
from precursor.operators import mining as MN  # noqa: E402
from precursor.operators import sequences as SQ  # noqa: E402
from precursor.plans.config import adapter_config  # noqa: E402
from precursor.plans.analysis import Analysis  # noqa: E402
from precursor.session import local_session  # noqa: E402
from precursor.sources.adapter import read_adapted  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    iv, jobs = read_adapted(spark, sf)
    a = Analysis(spark, iv, jobs, adapter_config())
    c = a.cfg
    stages = {
        "anchors": AN.find_anchors(a.flat_in_range, a.jobs, c.targets, c.start, c.end, c.job_includes, c.job_excludes,
                                   c.excluded_origin),
        "context": a.context_plan(),
        "events": SQ.token_events(a.context, mappings=a.name_map),
        "sequences": SQ.build_sequences(a.events),
        "closed_sequences": MN.closed_sequences(MN.frequent_sequences_by_key(a.sequences, 2)),
        "pattern_support": EV.pattern_support(a.sequences, a.patterns),
        "window_rows": EV.window_rows(a.flat_in_range, a.anchors, c.lookback, c.lookahead),
    }
    for name, df in stages.items():
        print(f"\n### {name}\n")
        print("```")
        df.explain("simple")
        print("```")


if __name__ == "__main__":
    main()
