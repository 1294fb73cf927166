"""precursor - what usually happens just before something goes wrong, on Spark.

Given a table of time-stamped intervals with JSON payloads and a table of job
runs, pick the first interval per run that meets a target, join the other
intervals of that run inside a search window round it, normalise them, turn
each run into an ordered sequence of event tokens and mine the top-k closed
frequent sequential patterns, with the runs and rows that support them.

Entry points: :class:`precursor.plans.analysis.Analysis` and
:func:`precursor.plans.analysis.run`; criteria in
:mod:`precursor.functions.criteria`; presets in :mod:`precursor.plans.config`.
"""

from precursor.functions.criteria import (Field, FieldLike, NamespaceIs, NoiseRule, Target,
                                          disruption_target)
from precursor.plans.config import AnalysisConfig, adapter_config, reference_config
from precursor.plans.analysis import Analysis, run

__all__ = ["Field", "FieldLike", "NamespaceIs", "NoiseRule", "Target", "disruption_target",
           "AnalysisConfig", "adapter_config", "reference_config", "Analysis", "run"]
