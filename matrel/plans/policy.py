"""The validated matrix-level rule, kept as a named option of ``auto``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The one validated adaptive region; dense-only is disabled.
ADAPTIVE_MIN_WORK = 0.1
ADAPTIVE_MAX_WORK = 0.6
ADAPTIVE_MIN_DENSE_ROWS = 8
ADAPTIVE_MIN_MERGE_RATIO = 16
# The two narrow regimes of the earlier gate, as (least and most dense work, least dense rows, merge rows a dense row).
MIXED_REGIME = (0.10, 0.20, 128, 4)
BIMODAL_REGIME = (0.75, 0.90, 1024, 2)


def policy_decision(work: Column, merge_rows: Column, dense_rows: Column) -> Column:
    region = (
        (dense_rows >= ADAPTIVE_MIN_DENSE_ROWS)
        & work.between(ADAPTIVE_MIN_WORK, ADAPTIVE_MAX_WORK)
        & (merge_rows >= ADAPTIVE_MIN_MERGE_RATIO * dense_rows)
    )
    return F.when(region, "ADAPTIVE").otherwise("MERGE_ONLY")


def calibrated_mode(light_mode: Column, work: Column, merge_rows: Column, dense_rows: Column, unclear_rows: Column) -> Column:
    """The earlier gate: ADAPTIVE only in a sparse mix, or in two kinds of rows of which none is unclear."""
    inside = lambda low, high, rows, ratio: work.between(low, high) & (dense_rows >= rows) & (merge_rows >= ratio * dense_rows)
    admitted = inside(*MIXED_REGIME) | (inside(*BIMODAL_REGIME) & (unclear_rows == 0))
    return F.when((light_mode == "ADAPTIVE") & admitted, "ADAPTIVE").otherwise("MERGE_ONLY")
