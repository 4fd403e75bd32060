"""lexmill: DataFrame operators for labelled multilingual text.

Profiling, duplicate grouping, leakage-free splits, evaluation metrics,
open-set scoring, drift tests and experiment comparison, all stated as
Spark plans.
"""
