"""In-hospital stays per patient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.functions import order_stats as q
from chronoline.functions import ordered as o
from chronoline.operators import stays as st


def stay_report(events: DataFrame, segment_minutes: int = 7 * 1440) -> DataFrame:
    """Number, mean and median length and deaths of stays, and events inside them.

    Events inside are counted with and without stays cut off at either end.
    """
    state, marker = st.admitted_markers()
    scanned = o.ordered_scan(events, ["patient_id"], st.EVENT_ORDER,
                             o.time_segment("age_min", segment_minutes), {
        "__state": o.last_before(state, inclusive=True), "__next": o.first_after(marker)})
    either = st.admitted_value(F.col("__state"), F.col("__next"))
    both = st.admitted_value(F.col("__state"), F.col("__next"), ignore_truncated=True)
    inside = scanned.groupBy("patient_id").agg(
        F.sum(either).alias("events_inside"), F.sum(both).alias("events_inside_complete"))
    pairs = st.stays(events, segment_minutes=segment_minutes)
    lengths = q.value_counts(pairs.select("patient_id", F.col("los_days").cast("double").alias("los")),
                             ["patient_id"], "los")
    middle = q.percentiles(lengths, ["patient_id"], "los", {"median_los": 0.5}).drop("n")
    totals = pairs.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_stays"), F.round(F.avg("los_days"), 6).alias("mean_los"),
        F.count_if(F.col("outcome") == "[DSC_EXP]").alias("n_died"))
    return (inside.join(totals, "patient_id", "left").join(middle, "patient_id", "left")
            .select("patient_id", F.coalesce("n_stays", F.lit(0)).alias("n_stays"), "mean_los",
                    F.round("median_los", 6).alias("median_los"),
                    F.coalesce("n_died", F.lit(0)).alias("n_died"), "events_inside",
                    "events_inside_complete"))
