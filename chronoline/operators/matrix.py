"""Numeric timeline matrices and training windows.

A matrix is kept as blocks of at most `max_length` rows, so the rows gathered
into one array are bounded however long a patient's timeline is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators.clean import events_in_windows

PARTS = ("years", "months", "days", "hours", "minutes")
DAY = 1440


def valid_row(split: str = "split") -> Column:
    """Row lies in the split's own period or is demographic."""
    own = F.when(F.col(split) == "test", F.col("test_period")).otherwise(F.col("train_period"))
    return (own == 1) | (F.col("type") == fv.DEMOGRAPHICS)


def matrix_rows(labelled: DataFrame) -> DataFrame:
    """(patient_id, row_no, age_min, vector, label): one numeric row per timeline row.

    Labels outside the split's period become the ignored label.
    """
    numbers = [F.col(p).cast("float") for p in PARTS] + [F.col("numeric").cast("float")]
    vector = F.concat(F.array(*numbers), F.transform("tokens", lambda t: t.cast("float")),
                      F.array(F.col("admitted").cast("float")))
    label = F.when(valid_row(), F.col("label")).otherwise(F.lit(fv.IGNORED_LABEL))
    return labelled.select("patient_id", "row_no", "age_min", vector.alias("vector"),
                           label.cast("int").alias("label"))


def padding_vector(width: int) -> Column:
    nulls = [F.lit(None).cast("float")] * (len(PARTS) + 1)
    return F.array(*nulls, *[F.lit(0.0).cast("float")] * (width + 1))


def _gather(df: DataFrame, keys: Sequence[str], pad_to: int, width: int) -> DataFrame:
    """Ordered arrays of at most `pad_to` rows per key, padded to that length."""
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("row_no", "vector", "label"))).alias("__r"))
    short = F.lit(pad_to) - F.size("__r")
    return grouped.select(
        *keys, F.size("__r").alias("n_rows"),
        F.concat(F.transform("__r", lambda r: r["vector"]),
                 F.array_repeat(padding_vector(width), short)).alias("rows"),
        F.concat(F.transform("__r", lambda r: r["label"]),
                 F.array_repeat(F.lit(fv.IGNORED_LABEL), short)).alias("labels"))


def timeline_matrix(labelled: DataFrame, max_length: int, width: int) -> DataFrame:
    """(patient_id, block_no, n_rows, rows, labels), every block padded to `max_length`."""
    rows = matrix_rows(labelled).withColumn(
        "block_no", F.floor(F.col("row_no") / max_length).cast("int"))
    return _gather(rows, ["patient_id", "block_no"], max_length, width)


def slice_points(labelled: DataFrame, max_length: int, head: int = 2) -> DataFrame:
    """First and last window start of each patient's timeline."""
    body = F.when(valid_row() & (F.col("row_no") >= head), F.col("row_no"))
    spans = labelled.groupBy("patient_id").agg(
        (F.max("row_no") + 1).alias("length"), F.min(body).alias("__lo"), F.max(body).alias("__hi"))
    long_enough = (F.col("length") > max_length) & F.col("__lo").isNotNull()
    low = F.greatest(F.lit(head), F.col("__lo") - max_length + head + 1)
    high = F.greatest(low, F.col("__hi") - max_length + head + 1)
    return spans.select(
        "patient_id", "length",
        F.when(long_enough, low).otherwise(F.lit(head)).cast("int").alias("min_start"),
        F.when(long_enough, high).otherwise(F.lit(head)).cast("int").alias("max_start"))


def slice_point_rows(points: DataFrame) -> DataFrame:
    return points.select("patient_id", F.explode(F.sequence("min_start", "max_start")).alias("start"))


def time_pairs(labelled: DataFrame, segment_minutes: int | None = 7 * DAY) -> DataFrame:
    """(this age, previous row's age) of every time row."""
    scanned = o.ordered_scan(labelled, ["patient_id"], ["age_min", "row_no"],
                             o.time_segment("age_min", segment_minutes),
                             {"shifted": o.lag(F.col("age_min"))})
    return scanned.filter(F.col("years").isNotNull()).select(
        "patient_id", "row_no", F.col("age_min").alias("original"), "shifted")


def update_subset(labelled: DataFrame, update: tuple[str, str], min_length: int) -> DataFrame:
    """Train and validation rows under an update period, with its own inclusion."""
    from chronoline.operators.clean import flag_periods
    rows = flag_periods(labelled.filter(F.col("split").isin("train", "validation")),
                        {"update_period": update})
    kept = ((F.col("update_period") == 1) | (F.col("type") == fv.DEMOGRAPHICS)).cast("int")
    lengths = rows.groupBy("patient_id").agg(F.sum(kept).alias("update_length"))
    rows = rows.join(lengths, "patient_id")
    return rows.withColumn("included", (F.col("update_length") >= min_length).cast("int"))


def timeline_metadata(labelled: DataFrame, max_length: int, min_length: int, death_label: int
                      ) -> DataFrame:
    """Effective length, death flag and sampling points per patient."""
    lengths = labelled.groupBy("patient_id", "split").agg(
        F.count_if(valid_row()).alias("effective_length"),
        F.max((F.col("label") == death_label).cast("int")).alias("died"))
    return lengths.withColumns({
        "sampling_points": F.ceil(F.col("effective_length") / max_length).cast("int"),
        "included": (F.col("effective_length") >= min_length).cast("int")})


def training_windows(labelled: DataFrame, points: DataFrame, max_length: int, width: int,
                     head: int = 2, epoch: int = 0, seed: int = 0) -> DataFrame:
    """One window of `max_length` rows per patient, labels shifted by one.

    The start is the first point, the last point or a random one; the choice
    is a digest of patient and epoch. Demographic rows stay in front, the label
    at the cut is ignored, and the last position predicts the row after the
    window.
    """
    effective = F.col("max_start") - F.col("min_start") + 1 + max_length - 1
    n_windows = F.ceil(effective / max_length)
    pick = c.digest_index(c.stable_digest(seed, F.lit(epoch), "patient_id", F.lit("kind")), n_windows + 1)
    spot = F.col("min_start") + c.digest_index(
        c.stable_digest(seed, F.lit(epoch), "patient_id", F.lit("spot")),
        F.col("max_start") - F.col("min_start") + 1).cast("int")
    start = (F.when(F.col("length") <= max_length, F.lit(head)).when(pick == 0, F.col("min_start"))
             .when(pick == 1, F.col("max_start")).otherwise(spot))
    chosen = points.withColumn("start", start.cast("int")).withColumns({
        "__from": F.col("start") - 1, "__to": F.col("start") + max_length - head})
    rows = matrix_rows(labelled)
    body = events_in_windows(rows.filter(F.col("row_no") >= head), chosen, ["patient_id"],
                             "__from", "__to", age="row_no", bucket=max_length)
    top = chosen.join(rows.filter(F.col("row_no") < head), "patient_id")
    every = body.unionByName(top)
    slot = F.when(F.col("row_no") < head, F.col("row_no")).otherwise(F.col("row_no") - F.col("start") + head)
    cut = (F.col("row_no") == F.col("start")) & (F.col("start") != head)
    every = every.withColumn("label", F.when(cut, F.lit(fv.IGNORED_LABEL)).otherwise(F.col("label"))) \
        .withColumn("row_no", slot)
    keys = ["patient_id", "start"]
    gathered = every.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("row_no", "vector", "label"))).alias("__r"))
    inside = F.slice("__r", 1, max_length)
    ahead = F.transform("__r", lambda r: r["label"])
    shifted = F.slice(ahead, 2, max_length)
    return gathered.select(
        *keys, F.size(inside).alias("n_rows"),
        F.concat(F.transform(inside, lambda r: r["vector"]),
                 F.array_repeat(padding_vector(width), F.lit(max_length) - F.size(inside))).alias("rows"),
        F.concat(shifted, F.array_repeat(F.lit(fv.IGNORED_LABEL), F.lit(max_length) - F.size(shifted)))
        .alias("labels"))


def time_shuffle(rows: DataFrame, replicates: int = 1, seed: int = 0, head: int = 2,
                 order: Sequence[str] = ("age_min", "row_no"), segment_minutes: int | None = 7 * DAY
                 ) -> DataFrame:
    """Random order of the rows between two time rows.

    `rows` has row_no, kind (time, dsc, disposition, lab, eot or other) and
    age_min. Time rows, demographic rows and discharges lead their block, a
    lab result stays behind its code, and a closing `[EOT]` or lab code
    without result stays last.
    """
    copies = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    is_time = (F.col("kind") == "time")
    keys = ["patient_id", "replicate"]
    scanned = o.ordered_scan(copies.withColumn("__t", is_time.cast("int")), keys, order,
                             o.time_segment(order[0], segment_minutes), {
        "block": o.running_sum(F.col("__t")),
        "__pk": o.lag(F.col("kind")), "__pr": o.lag(F.col("row_no")),
        "__n": o.total("max", F.col("row_no"))})

    def draw(row: Column) -> Column:
        return c.digest_index(c.stable_digest(seed, "patient_id", "replicate", row.cast("string")),
                              F.lit(1000)) + 1

    last = (F.col("row_no") == F.col("__n")) & F.col("kind").isin("eot", "lab")
    leads = is_time | (F.col("row_no") < head) | (F.col("kind") == "dsc") \
        | ((F.col("kind") == "disposition") & (F.coalesce("__pk", F.lit("")) == "dsc"))
    glued = F.coalesce("__pk", F.lit("")) == "lab"
    priority = (F.when(last, F.lit(1001)).when(leads, F.lit(0))
                .when(glued, draw(F.col("__pr"))).otherwise(draw(F.col("row_no"))))
    ready = scanned.withColumn("priority", priority.cast("int"))
    # pairs share a draw; the row of the code keeps two equal draws apart
    pair = F.when(glued & (F.col("priority") > 0) & ~last, F.col("__pr")).otherwise(F.col("row_no"))
    placed = o.ordered_scan(ready.withColumn("__pair", pair), keys,
                            ["block", "priority", "__pair", "row_no"],
                            None if segment_minutes is None else F.floor(F.col("block") / 64), {"new_row_no": o.row_number()})
    return placed.withColumn("new_row_no", (F.col("new_row_no") - 1).cast("int")).drop(
        "__t", "__pk", "__pr", "__n", "__pair")


def time_noise(labelled: DataFrame, epoch: int, first_time_label: int, seed: int = 0,
               span: int = 60, small: int = 10, large: int = 60, segment_minutes: int | None = 7 * DAY,
               sections: Sequence = fv.TIME_BIN_SECTIONS) -> DataFrame:
    """Shift all non-demographic times of a patient by one random offset within an hour.

    Both ends of a step move, so its length stays; none passes the age of the
    patient's first demographic row.
    """
    u = c.digest_uniform(c.stable_digest(seed, F.lit(epoch), "patient_id", F.lit("noise")))
    offset = (F.floor(u * (2 * span + 1)) - span).cast("long")
    head = F.col("type") == fv.DEMOGRAPHICS
    floor = F.when(F.col("row_no") == 0, F.col("age_min"))
    scanned = o.ordered_scan(labelled.withColumn("noise_min", offset), ["patient_id"], ["age_min", "row_no"],
                             o.time_segment("age_min", segment_minutes),
                             {"__prev": o.lag(F.col("age_min")), "__floor": o.total("max", floor)})

    def noisy(age: str) -> Column:
        return F.greatest(F.col(age) + F.col("noise_min"), F.coalesce("__floor", F.lit(0)))

    moved = scanned.withColumn("__prev", noisy("__prev")).withColumn(
        "age_min", F.when(head, F.col("age_min")).otherwise(noisy("age_min"))).drop("__floor")
    is_time = F.col("years").isNotNull()
    relabel = is_time & (F.col("row_no") != 0) & (F.col("label") != fv.IGNORED_LABEL)
    prev = F.col("__prev")
    parts = c.age_components("age_min")
    return (moved
            .withColumn("label", F.when(relabel, c.time_bin_label(prev, "age_min", first_time_label,
                                                                  small, large, sections))
                        .otherwise(F.col("label")).cast("int"))
            .withColumns({k: F.when(is_time, v) for k, v in parts.items()}).drop("__prev"))


def truncate_history(rows: DataFrame, keys: Sequence[str], length: int, head: int = 2) -> DataFrame:
    """Demographic rows and the latest `length - head` rows of each history.

    `rows` has a dense zero-based row_no per key.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(sizes, list(keys))
    keep = (F.col("__n") <= length) | (F.col("row_no") < head) \
        | (F.col("row_no") >= F.col("__n") - (length - head))
    return joined.filter(keep).drop("__n")


def clean_history(rows: DataFrame, keys: Sequence[str], anchor: str | None = None, head: int = 2,
                  is_padding: Column | None = None) -> DataFrame:
    """Histories without padding rows, made ready for a later start time.

    With an `anchor` after the last time, a closing time row is removed, and a
    history of demographic rows only begins on the anchor's day.
    """
    real = rows.filter(~is_padding) if is_padding is not None else rows
    if anchor is None:
        return real
    ends = real.groupBy(*keys).agg(
        F.max("row_no").alias("__last"), F.max("age_min").alias("__age"),
        F.max_by(F.col("is_time"), F.col("row_no")).alias("__time"))
    joined = real.join(ends, list(keys))
    later = F.col(anchor) > F.col("__age")
    cut = later & (F.col("__time") == 1) & (F.col("__last") >= head)
    kept = joined.filter(~(cut & (F.col("row_no") == F.col("__last"))))
    size = F.col("__last") + 1 - F.when(cut, 1).otherwise(0)
    short = later & (size <= head)
    age = F.when(short & (F.col("row_no") == 0), F.floor(F.col(anchor) / DAY) * DAY).otherwise(
        F.col("age_min"))
    return kept.withColumn("age_min", age).drop("__last", "__age", "__time")


def decode_timeline(sequences: DataFrame, catalog: DataFrame, grids: DataFrame | None = None,
                    keys: Sequence[str] = ("patient_id",), bins: int = 501) -> DataFrame:
    """Event view from long label sequences (keys, row_no, age_min or null, label, numeric).

    Ages are carried down, a result row becomes the result of the code before
    it, and the record type follows the label's family.
    """
    from chronoline.operators.labstats import dominant_unit
    cat = catalog.select(F.col("label").alias("__l"), "kind", "family",
                         F.col("original_value").alias("value"), "text")
    seq = sequences.join(cat, F.col("label") == F.col("__l"), "left").drop("__l")
    is_result = F.col("family").isin("numeric", "nonnumeric", "disposition")
    order = ["row_no"]
    seg = F.floor(F.col("row_no") / 4096)
    result = F.when(is_result, F.struct(F.col("value").alias("v"), F.col("label").alias("l"),
                                        F.col("family").alias("f")))
    scanned = o.ordered_scan(seq.withColumn("__res", result), keys, order, seg, {
        "__next": o.lead(F.col("__res")), "age_min": o.last_before(F.col("age_min"), inclusive=True)})
    kind = (F.when(F.col("family") == "sex", fv.DEMOGRAPHICS)
            .when(F.col("value") == "[ADM]", fv.ADMISSION).when(F.col("value") == "[DSC]", fv.DISCHARGE)
            .when(F.col("kind") == "dx", fv.DIAGNOSIS).when(F.col("kind") == "med", fv.PRESCRIPTION)
            .when(F.col("kind") == "lab", fv.LAB).when(F.col("value") == "[EOT]", fv.END_OF_TIMELINE))
    events = scanned.filter(~F.coalesce(is_result, F.lit(False)) & kind.isNotNull())
    number_bin = F.when(F.col("__next.f") == "numeric",
                        F.round(F.col("__next.v").try_cast("double") * (bins - 1)).cast("int"))
    out = events.withColumn("__bin", number_bin)
    if grids is not None:
        main = dominant_unit(grids).select(F.col("item_code").alias("__c"), F.col("unit").alias("__u"),
                                           F.col("grid").alias("__g"))
        out = out.join(main, F.col("value") == F.col("__c"), "left")
        number = c.bin_to_value("__bin", "__g")
        shown = F.concat(number.cast("string"), F.lit(" "), F.coalesce("__u", F.lit("")))
    else:
        shown = F.lit(None).cast("string")
    text = F.when(F.col("__bin").isNotNull(), F.coalesce(shown, F.lit(""))).otherwise(
        F.coalesce(F.col("__next.v"), F.lit("")))
    return out.select(*keys, "row_no", kind.alias("type"), "age_min", F.col("value").alias("code"),
                      "text", text.alias("result"))
