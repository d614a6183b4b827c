"""Run parameters of the timeline pipeline and the evaluation jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from chronoline import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    train_start: str = "2011-01-01"
    train_end: str = "2020-12-31"
    test_start: str = "2021-01-01"
    test_end: str = "2022-12-31"
    train_size: float = 0.8
    val_size: float = 0.1
    numeric_bins: int = 501
    td_small_step: int = 10
    td_large_step: int = 60
    td_sections: tuple = fv.TIME_BIN_SECTIONS
    max_length: int = 2048
    min_length: int = 50
    demographic_rows: int = 2
    max_horizon_days: int = 7
    max_days: int = 30
    eval_minute: int = 12 * 60
    merge_med_types: bool = True
    # Width of the pieces a patient's rows are cut into for ordered scans; None where
    # stage tables lie in patient blocks without an oversized patient.
    segment_minutes: int | None = 7 * 1440
    seed: int = 0
    token_width: int = 10
    segment_sizes: dict = field(default_factory=dict)
