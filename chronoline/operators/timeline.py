"""From records to ordered, labelled timelines and the event view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators.clean import flag_periods
from chronoline.operators.labstats import dedup_lab_reports, lab_report_spans, nearest_bins
from chronoline.operators.lookups import attach_lab_stats, map_codes_to_tokens, pad_tokens
from chronoline.operators.stays import admitted_markers, admitted_value

DAY = 1440
ROW_KEY = ("patient_id", "ts", "age_min", "time_available_min", "original_value", "type",
           "sort_code", "priority", "numeric", "tokens")
TIMELINE_ORDER = ("sort_age", "type", "sort_code", "priority", "unique_record_id")
# Time from which a better report takes a row's place; only rows made for as-of timelines have it.
UNTIL = "seen_until_min"
# Pieces of a long history that requests meet, and of its rows.
AS_OF_PIECE, ROW_PIECE = 90 * DAY, 4096


def single_token(index: Column, width: int) -> Column:
    return F.concat(F.array(index.cast("int")), F.array_repeat(F.lit(0), width - 1))


def _record(df: DataFrame, kind: int, code: Column, code_tokens: Column | None, width: int,
            numeric: Column | None = None, result_index: Column | None = None,
            result_text: Column | None = None) -> DataFrame:
    """Bring a record table to the common shape `explode_rows` reads."""
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    return df.select(
        "patient_id", "ts", "age_min", "time_available_min", "unique_record_id",
        F.lit(kind).alias("type"), code.alias("code"),
        (code_tokens if code_tokens is not None else pad_tokens(width)).cast("array<int>")
        .alias("code_tokens"),
        (numeric if numeric is not None else none_number).alias("result_numeric"),
        F.coalesce(result_index, F.lit(0)).cast("int").alias("result_index")
        if result_index is not None else F.lit(0).alias("result_index"),
        (result_text if result_text is not None else none_text).alias("result_text"),
        *[n for n in (UNTIL,) if n in df.columns])


def _special(df: DataFrame, specials: DataFrame, token: Column, out: str) -> DataFrame:
    """Index of a special token by name; null when it has none."""
    table = specials.select(F.col("token").alias("__st"), F.col("index").alias(out))
    return (df.withColumn("__tk", token).join(table, F.col("__tk") == F.col("__st"), "left")
            .drop("__tk", "__st"))


def sequence_demographics(patients: DataFrame, specials: DataFrame, width: int) -> DataFrame:
    token = c.sex_token("sex")
    rows = _special(patients, specials, token, "__i").withColumns({
        "ts": F.col("date_of_birth").cast("timestamp_ntz"), "age_min": F.lit(0).cast("long"),
        "time_available_min": F.lit(0).cast("long")})
    return _record(rows, fv.DEMOGRAPHICS, F.lit(None).cast("string"), None, width,
                   result_index=F.coalesce("__i", F.lit(fv.OOV_INDEX)), result_text=c.sex_token("sex"))


def sequence_admissions(df: DataFrame, specials: DataFrame, width: int) -> DataFrame:
    rows = _special(df, specials, F.lit("[ADM]"), "__i")
    return _record(rows, fv.ADMISSION, F.lit("[ADM]"), single_token(F.col("__i"), width), width)


def sequence_discharges(df: DataFrame, specials: DataFrame, width: int) -> DataFrame:
    token = c.disposition_token("disposition")
    rows = _special(_special(df, specials, F.lit("[DSC]"), "__i"), specials, token, "__r")
    return _record(rows, fv.DISCHARGE, F.lit("[DSC]"), single_token(F.col("__i"), width), width,
                   result_index=F.coalesce("__r", F.lit(fv.OOV_INDEX)),
                   result_text=c.disposition_token("disposition"))


def sequence_codes(df: DataFrame, code_map: DataFrame, system: str, kind: int, width: int) -> DataFrame:
    """Diagnoses (with `provisional`), prescriptions or injections."""
    code = F.col("item_code")
    if system == "dx":
        code = F.when(F.col("provisional") == 1,
                      F.concat("item_code", F.lit(fv.PROVISIONAL_SUFFIX))).otherwise(code)
    mapped = map_codes_to_tokens(df.withColumn("item_code", code),
                                 code_map.filter(F.col("system") == system), "item_code", width)
    return _record(mapped, kind, F.col("item_code"), F.col("tokens"), width)


def sequence_labs(labs: DataFrame, grids: DataFrame, nonnumeric: DataFrame, code_map: DataFrame,
                  specials: DataFrame, width: int, bins: int = 501, spans: bool = False) -> DataFrame:
    """Lab results: best copy per time, code tokens, grid position or result token.

    A number without a grid keeps only its code row; an unknown text result is
    out of vocabulary. With `spans` every copy that is the best at some time stays,
    with the time until which it is.
    """
    joined = attach_lab_stats(labs, grids, nonnumeric)
    single = lab_report_spans(joined, until=UNTIL) if spans else dedup_lab_reports(joined)
    binned = nearest_bins(single, grids)
    mapped = map_codes_to_tokens(binned, code_map.filter(F.col("system") == "lab"), "item_code", width)
    rows = _special(mapped, specials, F.col("token"), "__i")
    is_number = F.col("numeric").isNotNull()
    text = F.when(is_number & F.col("bin").isNotNull(),
                  F.concat(F.col("numeric").cast("string"), F.lit(" "), F.coalesce("unit", F.lit(""))))
    text = F.when(~is_number, F.col("nonnumeric")).otherwise(text)
    return _record(rows, fv.LAB, F.col("item_code"), F.col("tokens"), width,
                   numeric=F.when(is_number, c.uniform_step(F.col("bin"), bins)),
                   result_index=F.when(~is_number, F.coalesce("__i", F.lit(fv.OOV_INDEX))),
                   result_text=text)


def explode_rows(records: DataFrame, width: int) -> DataFrame:
    """Each record as a time row, a code row and a result row.

    Empty rows go; equal rows of different records become one.
    """
    zero = pad_tokens(width).cast("array<int>")
    none_text, none_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    time_row = F.struct(F.lit(0).alias("priority"), none_text.alias("original_value"),
                        none_number.alias("numeric"), zero.alias("tokens"))
    code_row = F.struct(F.lit(1).alias("priority"), F.col("code").alias("original_value"),
                        none_number.alias("numeric"), F.col("code_tokens").alias("tokens"))
    index = F.when(F.col("result_numeric").isNull(), F.col("result_index")).otherwise(F.lit(0))
    result_row = F.struct(F.lit(2).alias("priority"), F.col("result_text").alias("original_value"),
                          F.col("result_numeric").alias("numeric"),
                          single_token(index, width).alias("tokens"))
    extra = [n for n in (UNTIL,) if n in records.columns]
    rows = (records.withColumn("r", F.explode(F.array(time_row, code_row, result_row)))
            .withColumn("sort_code", F.when(F.col("r.priority") == 0, F.lit(""))
                        .otherwise(F.coalesce("code", F.lit(""))))
            .select("patient_id", "ts", "age_min", "time_available_min", "unique_record_id", "type",
                    "sort_code", "r.*", *extra))
    filled = (F.col("priority") == 0) | (F.col("tokens")[0] != 0) | F.col("numeric").isNotNull()
    return dedup_rows(rows.filter(filled), [*ROW_KEY, *extra])


def dedup_rows(df: DataFrame, key: Sequence[str], record: str = "unique_record_id") -> DataFrame:
    """Rows equal on `key` become one, with the smallest record id.

    An aggregate: copies combine before the shuffle.
    """
    rest = [n for n in df.columns if n not in key and n != record]
    return df.groupBy(*key).agg(
        F.min(record).alias(record),
        *[F.min_by(n, F.col(record)).alias(n) for n in rest])


def drop_oov(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("tokens")[0] != fv.OOV_INDEX)


def oov_report(rows: DataFrame) -> DataFrame:
    """Out-of-vocabulary values with their counts."""
    return (rows.filter(F.col("tokens")[0] == fv.OOV_INDEX)
            .groupBy("type", "original_value").agg(F.count(F.lit(1)).alias("n_rows")))


def with_components(rows: DataFrame) -> DataFrame:
    """Scaled age parts on time rows, null elsewhere."""
    is_time = F.col("priority") == 0
    return rows.withColumns({k: F.when(is_time, v) for k, v in c.age_components("age_min").items()})


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def build_timeline(rows: DataFrame, periods: dict[str, tuple[str, str]] | None, eot_index: int,
                   width: int, demographic_rows: int = 2, end_row: bool = True,
                   segment_minutes: int = 7 * DAY) -> DataFrame:
    """Token rows of all record types as one numbered timeline per patient.

    Keeps rows of the given periods and the demographic ones, drops patients
    without other rows, moves demographics to the day of the first event,
    numbers the rows, marks stays and appends `[EOT]`. All of it needs one
    ordered scan.
    """
    merged = dedup_rows(rows, [k for k in ROW_KEY if k != "time_available_min"])
    if periods:
        merged = flag_periods(merged, periods)
        keep = F.col("type") == fv.DEMOGRAPHICS
        for name in periods:
            keep = keep | (F.col(name) == 1)
        merged = merged.filter(keep).drop(*periods)
    head = F.col("type") == fv.DEMOGRAPHICS
    merged = merged.withColumn("sort_age", F.when(head, F.lit(-1).cast("long"))
                               .otherwise(F.col("age_min")))
    state, marker = admitted_markers("original_value")
    other = F.when(~head, F.struct("age_min", "ts"))
    scanned = o.ordered_scan(merged, ["patient_id"], TIMELINE_ORDER,
                             o.time_segment("sort_age", segment_minutes), {
        "__rn": o.row_number(),
        "__n": o.total("sum", F.lit(1)),
        "__first": o.total("min", other),
        "__state": o.last_before(state, inclusive=True),
        "__next": o.first_after(marker)})
    minimum = demographic_rows if end_row else 0
    kept = scanned.filter(F.col("__n") > minimum)
    copies = F.when(F.lit(end_row) & (F.col("__rn") == F.col("__n")), F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    kept = kept.withColumn("__copy", F.explode(copies))
    end = F.col("__copy") == 1
    first_age = F.coalesce(F.col("__first.age_min"), F.col("age_min"))
    first_ts = F.coalesce(F.col("__first.ts"), F.col("ts"))
    flag = F.when(end, F.coalesce("__state", F.lit(0))).otherwise(
        admitted_value(F.col("__state"), F.col("__next"), "original_value"))
    shaped = kept.select(
        "patient_id",
        F.when(head, F.date_trunc("day", first_ts).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"),
        F.when(head, F.floor(first_age / DAY) * DAY).otherwise(F.col("age_min")).alias("age_min"),
        "time_available_min",
        F.when(end, F.lit("[EOT]")).otherwise(F.col("original_value")).alias("original_value"),
        F.when(end, F.lit(fv.END_OF_TIMELINE)).otherwise(F.col("type")).alias("type"),
        F.when(end, F.lit(1)).otherwise(F.col("priority")).alias("priority"),
        F.when(end, F.concat("patient_id", F.lit("EOT"))).otherwise(F.col("unique_record_id"))
        .alias("unique_record_id"),
        F.when(~end, F.col("numeric")).alias("numeric"),
        F.when(end, single_token(F.lit(eot_index), width)).otherwise(F.col("tokens")).alias("tokens"),
        (F.col("__rn") - 1 + F.col("__copy")).cast("int").alias("row_no"),
        flag.cast("int").alias("admitted"))
    return with_components(shaped)


def rows_with_spans(rows: DataFrame, segment_minutes: int | None = 7 * DAY) -> DataFrame:
    """Token rows made with spans in timeline order, each with the times it is seen at.

    Adds `position` in the patient's timeline, `seen_from_min` and the final `seen_until_min`
    (null: for good): of equal rows the one with the smallest record id of those known is
    seen. Rows that are never seen go.
    """
    rows = rows.withColumn("seen_from_min", F.when(
        F.col("age_min").isNotNull() & F.col("time_available_min").isNotNull(),
        F.greatest("age_min", "time_available_min")))
    smaller = Window.partitionBy(*[k for k in ROW_KEY if k != "time_available_min"]).orderBy(
        F.col("unique_record_id").asc_nulls_last(), "seen_from_min").rowsBetween(Window.unboundedPreceding, -1)
    # Equal rows of labs are never seen together. Equal time rows stand side by side, where a timeline
    # keeps the first.
    alone = (F.col("priority") == 0) | (F.col("type") == fv.LAB)
    spans = rows.withColumn(UNTIL, F.when(alone, F.col(UNTIL)).otherwise(F.min("seen_from_min").over(smaller)))
    seen = spans.filter(F.col("seen_from_min").isNotNull()
                        & (F.col(UNTIL).isNull() | (F.col("seen_from_min") < F.col(UNTIL))))
    keyed = seen.withColumn("sort_age", F.when(F.col("type") == fv.DEMOGRAPHICS, F.lit(-1).cast("long"))
                            .otherwise(F.col("age_min")))
    return o.ordered_scan(keyed, ["patient_id"], TIMELINE_ORDER, o.time_segment("sort_age", segment_minutes),
                          {"position": o.row_number()}).drop("sort_age")


def seen_as_of(rows: DataFrame, requests: DataFrame, segment_minutes: int | None = AS_OF_PIECE) -> DataFrame:
    """Rows with spans that each (patient_id, as_of_min) request sees; demographic rows at any time.

    Requests meet the pieces of a long history as in `known_before`; without pieces the join is by
    patient alone.
    """
    head = F.col("type") == fv.DEMOGRAPHICS
    at = F.col("as_of_min")
    seen = head | ((F.col("seen_from_min") <= at) & (F.col(UNTIL).isNull() | (at < F.col(UNTIL))))
    if segment_minutes is None:
        return rows.join(requests, "patient_id").filter(seen)
    first = F.lit(-(1 << 40)).cast("long")
    placed = rows.withColumn("__b", F.when(head, first).otherwise(o.time_segment("seen_from_min", segment_minutes)))
    pieces = placed.select("patient_id", "__b").distinct()
    spread = requests.join(pieces, "patient_id").filter(
        F.col("__b") <= F.coalesce(o.time_segment("as_of_min", segment_minutes), first))
    return placed.join(spread, ["patient_id", "__b"]).filter(seen).drop("__b")


def lines_as_of(rows: DataFrame, requests: DataFrame, catalog: DataFrame, first_numeric: int | Column,
                first_time: int | Column, bins: int = 501, small: int = 10, large: int = 60,
                segment_minutes: int | None = 7 * DAY, sections: Sequence = fv.TIME_BIN_SECTIONS) -> DataFrame:
    """Numbered, labelled timelines of requests from the rows of `rows_with_spans`.

    All that is the same for every request is found before the rows are copied to them; a
    copy then needs its neighbours only: of two time rows in a row the later one goes, the
    demographics move to the day of the first event, and the rows are numbered.
    """
    head = F.col("type") == fv.DEMOGRAPHICS
    ignored = F.lit(fv.IGNORED_LABEL)
    fixed = label_codes(rows, catalog).withColumn("__fixed", F.coalesce(
        numeric_label("numeric", first_numeric, bins), token_label(), F.col("code_label"), ignored)).drop("code_label")
    copies = seen_as_of(fixed, requests, AS_OF_PIECE if segment_minutes is not None else None)
    keys, order = ["patient_id", "request_id"], ["position"]
    piece = F.floor(F.col("position") / F.lit(ROW_PIECE)) if segment_minutes is not None else None
    scanned = o.ordered_scan(copies, keys, order, piece, {
        "__before": o.lag(F.col("priority")),
        "__first": o.total("min", F.when(~head, F.struct("age_min", "ts")))})
    kept = scanned.filter((F.col("priority") != 0) | (F.coalesce("__before", F.lit(1)) != 0))
    first_age, first_ts = F.coalesce(F.col("__first.age_min"), F.col("age_min")), F.coalesce(F.col("__first.ts"), F.col("ts"))
    moved = kept.withColumns({
        "ts": F.when(head, F.date_trunc("day", first_ts).cast("timestamp_ntz")).otherwise(F.col("ts")),
        "age_min": F.when(head, F.floor(first_age / DAY) * DAY).otherwise(F.col("age_min"))}).drop("__before", "__first")
    state, marker = admitted_markers("original_value")
    numbered = o.ordered_scan(moved, keys, order, piece, {
        "__n": o.row_number(), "__prev": o.lag(F.col("age_min")),
        "effective_length": o.total("sum", F.lit(1)),
        "__state": o.last_before(state, inclusive=True),
        "__next": o.first_after(marker)})
    row_no = (F.col("__n") - 1).cast("int")
    label = (F.when(F.col("__n") == 1, ignored)
             .when(F.col("priority") == 0, c.time_bin_label("__prev", "age_min", first_time, small, large, sections))
             .otherwise(F.col("__fixed")))
    return with_components(numbered.withColumns({
        "row_no": row_no, "label": label.cast("int"),
        "admitted": admitted_value(F.col("__state"), F.col("__next"), "original_value").cast("int")})).drop(
        "__n", "__prev", "__state", "__next", "__fixed", "position", "seen_from_min", UNTIL)


def append_end_row(df: DataFrame, code: str = "code") -> DataFrame:
    """One `[EOT]` row per patient after its last row (columns row_no, age_min, type)."""
    rest = [n for n in df.columns if n != "patient_id"]
    last = df.groupBy("patient_id").agg(F.max_by(F.struct(*rest), F.col("row_no")).alias("r"))
    ends = last.select("patient_id", "r.*").withColumns({
        code: F.lit("[EOT]"), "type": F.lit(fv.END_OF_TIMELINE),
        "row_no": F.col("row_no") + 1})
    return df.unionByName(ends)


def drop_repeated_time_rows(df: DataFrame, order: Sequence[str], is_time: Column,
                            segment_minutes: int = 7 * DAY) -> DataFrame:
    """Remove a time row that directly follows a time row."""
    scanned = o.ordered_scan(df.withColumn("__t", is_time.cast("int")), ["patient_id"], order,
                             o.time_segment(order[0], segment_minutes), {"__p": o.lag(F.col("__t"))})
    return scanned.filter(~((F.col("__t") == 1) & (F.coalesce("__p", F.lit(0)) == 1))).drop(
        "__t", "__p")


def label_codes(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog label of each code value, null for other rows."""
    codes = (catalog.filter(F.col("kind").isin("dx", "med", "lab"))
             .groupBy(F.col("original_value").alias("__v")).agg(F.min("label").alias("code_label")))
    return rows.join(codes, F.col("original_value") == F.col("__v"), "left").drop("__v")


def token_label(tokens: str = "tokens") -> Column:
    """Index of a single-token row, null otherwise."""
    t = F.col(tokens)
    return F.when((t[0] != 0) & (t[1] == 0), t[0])


def numeric_label(value: str | Column, first: int | Column, bins: int) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    f = F.lit(first) if isinstance(first, int) else first
    return F.when(v.isNotNull(), f + F.round(v * (bins - 1)).cast("int"))


def label_timeline(timeline: DataFrame, catalog: DataFrame, splits: DataFrame | None,
                   periods: dict[str, tuple[str, str]], first_numeric: int, first_time: int,
                   bins: int = 501, small: int = 10, large: int = 60, min_length: int = 50,
                   segment_minutes: int = 7 * DAY, sections: Sequence = fv.TIME_BIN_SECTIONS) -> DataFrame:
    """Add label, period flags and `included` to a timeline."""
    flagged = flag_periods(label_codes(timeline, catalog), periods)
    single = splits is None
    if not single:
        flagged = flagged.join(splits.select("patient_id", "split"), "patient_id")
        own = F.when(F.col("split") == "test", F.col("test_period")).otherwise(F.col("train_period"))
        effective = ((own == 1) | (F.col("type") == fv.DEMOGRAPHICS)).cast("int")
    else:
        effective = F.lit(1)
    scanned = o.ordered_scan(flagged, ["patient_id"], ["age_min", "row_no"],
                             o.time_segment("age_min", segment_minutes), {
        "__prev": o.lag(F.col("age_min")), "effective_length": o.total("sum", effective)})
    is_time = F.col("years").isNotNull() & (F.col("row_no") != 0)
    ignored = F.lit(fv.IGNORED_LABEL)
    label = (F.when(F.col("row_no") == 0, ignored)
             .when((F.col("original_value") == "[EOT]") & (F.col("admitted") == 1)
                   & F.lit(not single), ignored)
             .when(is_time, c.time_bin_label("__prev", "age_min", first_time, small, large, sections))
             .otherwise(F.coalesce(numeric_label("numeric", first_numeric, bins), token_label(),
                                   F.col("code_label"), ignored)))
    out = scanned.withColumn("label", label.cast("int"))
    if not single:
        out = out.withColumn("included", (F.col("effective_length") >= min_length).cast("int"))
    return out.drop("__prev", "code_label")


def event_view(labelled: DataFrame, catalog: DataFrame, segment_minutes: int | None = 7 * DAY) -> DataFrame:
    """One row per event: the next row of the same record is its result."""
    rows = labelled.filter(F.coalesce("original_value", F.lit("")) != "")
    scanned = pair_code_result(rows, ["age_min", "row_no"], "original_value", segment_minutes)
    texts = (catalog.filter(F.col("original_value") != "")
             .groupBy(F.col("original_value").alias("code")).agg(F.min_by("text", "label").alias("text")))
    return (scanned.withColumnRenamed("original_value", "code").join(texts, "code", "left")
            .select("patient_id", "type", "age_min", "code", "text", "result",
                    *[n for n in ("train_period", "test_period", "split", "row_no")
                      if n in scanned.columns]))


def pair_code_result(rows: DataFrame, order: Sequence[str], value: str,
                     segment_minutes: int | None = 7 * DAY) -> DataFrame:
    """Add `result` from the next row of the same record and drop that row."""
    record = "unique_record_id"
    scanned = o.ordered_scan(rows, ["patient_id"], order, o.time_segment(order[0], segment_minutes), {
        "__v": o.lead(F.col(value)), "__r": o.lead(F.col(record)), "__b": o.lag(F.col(record))})
    same_next = F.coalesce(F.col("__r") == F.col(record), F.lit(False))
    same_prev = F.coalesce(F.col("__b") == F.col(record), F.lit(False))
    return (scanned.withColumn("result", F.when(same_next, F.coalesce("__v", F.lit("")))
                               .otherwise(F.lit("")))
            .filter(~same_prev).drop("__v", "__r", "__b"))


def timeline_rules_check(rows: DataFrame, order: Sequence[str], kind: str = "kind",
                         segment_minutes: int = 7 * DAY) -> DataFrame:
    """(rule, n_rows) of rows that break an ordering rule.

    `kind` is one of sex, time, lab, result, adm, dsc, eot, code; the frame
    has row_no, age_min and the admitted flag of the row before (`inside`).
    """
    scanned = o.ordered_scan(rows, ["patient_id"], order, o.time_segment(order[0], segment_minutes), {
        "__k": o.lag(F.col(kind)), "__a": o.lag(F.col("age_min")),
        "__s": o.last_before(F.when(F.col(kind) == "adm", 1).when(F.col(kind) == "dsc", 0))})
    k, prev = F.col(kind), F.coalesce("__k", F.lit(""))
    inside = F.coalesce("__s", F.lit(0)) == 1
    rules = {
        "sex_first": (F.col("row_no") == 0) & (k != "sex"),
        "first_step_within_a_day": (F.col("row_no") == 2)
        & (F.col("age_min") - F.coalesce("__a", "age_min") >= DAY),
        "lab_needs_result": (prev == "lab") & (k != "result"),
        "result_needs_lab": (k == "result") & (prev != "lab"),
        "time_after_time": (k == "time") & (prev == "time"),
        "admission_while_inside": (k == "adm") & inside,
        "discharge_while_outside": (k == "dsc") & ~inside,
        "end_while_inside": (k == "eot") & inside,
    }
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return (scanned.select(F.explode(broken).alias("rule")).groupBy("rule")
            .agg(F.count(F.lit(1)).alias("n_rows")))
