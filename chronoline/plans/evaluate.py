"""Windows times tasks: observed against simulated timelines, then metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.operators import metrics, simeval, stays
from chronoline.settings import Settings


def admission_windows(event_view: DataFrame, settings: Settings, order: Sequence[str] = stays.EVENT_ORDER
                      ) -> DataFrame:
    """Evaluation windows of the complete admissions of the test period."""
    admissions = stays.complete_admissions(event_view, order, segment_minutes=settings.segment_minutes)
    return stays.admission_day_snapshots(admissions, settings.eval_minute, settings.max_days)


def evaluate_tasks(event_view: DataFrame, simulations: DataFrame, settings: Settings,
                   rules: simeval.TaskRules = simeval.TaskRules(), windows: DataFrame | None = None
                   ) -> DataFrame:
    """Probability rows of every (window, horizon, task)."""
    windows = admission_windows(event_view, settings) if windows is None else windows
    return simeval.event_probabilities(windows, event_view, simulations, rules,
                                       settings.max_horizon_days)


def task_metrics(probabilities: DataFrame, by: Sequence[str] = ("task", "horizon")) -> DataFrame:
    """AUROC, AUPRC and O/E per task and horizon."""
    counts = metrics.probability_counts(probabilities, by, label="actual")
    confusion = metrics.confusion_by_threshold(counts, by)
    by = list(by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_events"))
    return (totals.join(metrics.auroc(confusion, by), by, "left")
            .join(metrics.auprc(confusion, by), by, "left").join(metrics.oe_ratio(counts, by), by, "left"))
