"""Records to labelled timelines: the whole dataset build as one set of plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import scalars
from chronoline.operators import cohort, labstats, matrix, timeline, vocab
from chronoline.operators.clean import clean_records, flag_periods
from chronoline.schema import CLEANING_RULES
from chronoline.sources import blocks
from chronoline.settings import Settings

RECORD_TABLES = ("admissions", "discharges", "diagnoses", "prescription_orders",
                 "injection_orders", "laboratory_results")
# Time columns that the blocks of each patient-keyed stage are sorted by.
BLOCK_ORDER = {**{f"cleaned_{n}": ["age_min"] for n in RECORD_TABLES}, "splits": [], "timeline": ["age_min", "row_no"],
               "labelled": ["age_min", "row_no"], "event_view": ["age_min"]}
DERIVED = ("timeline", "labelled", "event_view")


@dataclass
class Vocabulary:
    """Everything later stages look codes up in."""

    specials: DataFrame
    code_map: DataFrame
    tokens: DataFrame
    catalog: DataFrame
    grids: DataFrame
    nonnumeric: DataFrame
    width: int


@dataclass
class Dataset:
    cleaned: dict[str, DataFrame]
    splits: DataFrame
    vocabulary: Vocabulary
    timeline: DataFrame
    labelled: DataFrame
    event_view: DataFrame
    settings: Settings = field(default_factory=Settings)

    def matrices(self) -> DataFrame:
        return matrix.timeline_matrix(self.labelled, self.settings.max_length, self.vocabulary.width)


def clean_tables(records: dict[str, DataFrame], patients: DataFrame) -> dict[str, DataFrame]:
    """Cleaned record tables with `ts`, `age_min` and `time_available_min`."""
    out = {}
    for name in RECORD_TABLES:
        if name not in records:
            continue
        any_of, all_of = CLEANING_RULES[name]
        known = "time_available" if "time_available" in records[name].columns else None
        out[name] = clean_records(records[name], patients, any_of, all_of, "timestamp", known
                                  ).withColumnRenamed("timestamp", "ts")
    return out


def _train_rows(df: DataFrame, splits: DataFrame, settings: Settings) -> DataFrame:
    flagged = flag_periods(df, {"train_period": (settings.train_start, settings.train_end)})
    ids = splits.filter(F.col("split") == "train").select("patient_id")
    return flagged.filter(F.col("train_period") == 1).join(ids, "patient_id", "left_semi")


def build_vocabulary(cleaned: dict[str, DataFrame], splits: DataFrame, names: DataFrame,
                     settings: Settings, keep: Callable | None = None) -> Vocabulary:
    """Lab statistics, tokens and catalog from train patients in the train period.

    `names` has (system, item_code, item_name). `keep` may store each table:
    all of them are small and read many times.
    """
    keep = keep or (lambda name, df: df)
    labs = _train_rows(cleaned["laboratory_results"], splits, settings)
    counts = labstats.numeric_value_counts(labs)
    grids = keep("percentiles", labstats.percentile_grid(counts, settings.numeric_bins))
    nonnumeric = keep("nonnumeric_stats", labstats.rank_nonnumeric_tokens(labstats.nonnumeric_counts(labs)))
    specials = keep("special_tokens", vocab.special_tokens(nonnumeric))
    dx = labstats.with_provisional_code(_train_rows(cleaned["diagnoses"], splits, settings))
    med = [_train_rows(cleaned[n], splits, settings) for n in ("prescription_orders", "injection_orders")
           if n in cleaned]
    listed = [dx.select(F.lit("dx").alias("system"), F.col("item_code").alias("code"))]
    listed += [m.select(F.lit("med").alias("system"), F.col("item_code").alias("code")) for m in med]
    listed += [t.select(F.lit("lab").alias("system"), F.col("item_code").alias("code"))
               for t in (grids, nonnumeric)]
    codes = keep("codes", vocab.distinct_codes(*listed))
    tokens, code_map = vocab.vocabulary(codes, specials, settings.segment_sizes)
    tokens, code_map = keep("tokens", tokens), keep("code_map", code_map)
    width = vocab.token_width({k: v for k, v in settings.segment_sizes.items() if v},
                              settings.token_width)
    table = keep("catalog", vocab.catalog(specials, code_map, names, width, settings.numeric_bins,
                                          settings.td_small_step, settings.td_large_step,
                                          settings.td_sections))
    return Vocabulary(specials, code_map, tokens, table, grids, nonnumeric, width)


def sequence_tables(cleaned: dict[str, DataFrame], patients: DataFrame, voc: Vocabulary,
                    settings: Settings, spans: bool = False) -> DataFrame:
    """All records in the common shape `timeline.explode_rows` reads."""
    prescription = fv.INJECTION if settings.merge_med_types else fv.PRESCRIPTION
    w = voc.width
    parts = [
        timeline.sequence_demographics(patients, voc.specials, w),
        timeline.sequence_admissions(cleaned["admissions"], voc.specials, w),
        timeline.sequence_discharges(cleaned["discharges"], voc.specials, w),
        timeline.sequence_codes(cleaned["diagnoses"], voc.code_map, "dx", fv.DIAGNOSIS, w),
        timeline.sequence_labs(cleaned["laboratory_results"], voc.grids, voc.nonnumeric, voc.code_map,
                               voc.specials, w, settings.numeric_bins, spans),
    ]
    for name, kind in (("prescription_orders", prescription), ("injection_orders", fv.INJECTION)):
        if name in cleaned:
            parts.append(timeline.sequence_codes(cleaned[name], voc.code_map, "med", kind, w))
    return timeline.union_tables(*parts)


def label_bounds(catalog: DataFrame) -> tuple:
    """First numeric and first time label as scalar columns."""
    first = lambda kind: catalog.filter(F.col("kind") == kind).select(F.min("label")).scalar()
    return first("numeric"), first("time")


def periods_of(settings: Settings) -> dict[str, tuple[str, str]]:
    return {"train_period": (settings.train_start, settings.train_end),
            "test_period": (settings.test_start, settings.test_end)}


def create_dataset(records: dict[str, DataFrame], patients: DataFrame, names: DataFrame,
                   settings: Settings, splits: DataFrame | None = None,
                   keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Dataset:
    """Build every stage table.

    `patients` needs unique_record_id, sex and date_of_birth; each record
    table unique_record_id. `keep(name, df)` may store a stage (Parquet in the
    shared folder, say) and return the stored frame; without it the stages stay
    lazy. Statistics and vocabulary are read many times, so a cluster run
    should store them, and the timeline; with a `BlockStore` the stages by patient
    lie in patient blocks and are scanned without a shuffle.
    """
    keep = keep or (lambda name, df: df)
    cleaned = {n: keep(f"cleaned_{n}", d) for n, d in clean_tables(records, patients).items()}
    settings = scan_settings(settings, keep)
    if splits is None:
        spans = cohort.visit_span(*cleaned.values())
        splits = keep("splits", cohort.temporal_split(
            spans, (settings.train_start, settings.train_end), (settings.test_start, settings.test_end),
            settings.train_size, settings.val_size, settings.seed))
    voc = build_vocabulary(cleaned, splits, names, settings, keep)
    ids = splits.select("patient_id")
    seq = sequence_tables({n: d.join(ids, "patient_id", "left_semi") for n, d in cleaned.items()},
                          patients.join(ids, "patient_id", "left_semi"), voc, settings)
    rows = timeline.drop_oov(timeline.explode_rows(dealt_by_patient(seq, keep), voc.width))
    eot = fv.OPERATIONAL_TOKENS.index("[EOT]")
    line = keep("timeline", timeline.build_timeline(
        rows, periods_of(settings), eot, voc.width, settings.demographic_rows,
        segment_minutes=settings.segment_minutes))
    labelled = keep("labelled", label_rows(line, voc, splits, settings))
    view = keep("event_view", timeline.event_view(labelled, voc.catalog, settings.segment_minutes))
    return Dataset(cleaned, splits, voc, line, labelled, view, settings)


def label_rows(line: DataFrame, voc: Vocabulary, splits: DataFrame | None, settings: Settings) -> DataFrame:
    first_numeric, first_time = label_bounds(voc.catalog)
    return timeline.label_timeline(
        line, voc.catalog, splits, periods_of(settings), first_numeric, first_time,
        settings.numeric_bins, settings.td_small_step, settings.td_large_step, settings.min_length,
        settings.segment_minutes, settings.td_sections)


def timelines_as_of(cleaned: dict[str, DataFrame], patients: DataFrame, requests: DataFrame,
                    voc: Vocabulary, settings: Settings, keep: Callable | None = None) -> DataFrame:
    """Labelled timelines of many (patient_id, as_of_min) requests in one job.

    Each request sees the records of its patient known by then; no end row is
    added. The rows of a patient are made, ordered and labelled once, with the span of
    times each is seen in; only then do the requests pick theirs. `request_id` names
    the request and stands in for the patient; asked twice for a patient, the later time
    counts; of two patients, it names two timelines. `keep` is the `BlockStore` that holds `cleaned`,
    if one does.
    """
    settings = scan_settings(settings, keep)
    asked = (dealt_by_patient(requests.select("request_id", "patient_id", "as_of_min"), keep)
             .groupBy("request_id", "patient_id").agg(F.max("as_of_min").alias("as_of_min")))
    ids = asked.select("patient_id").distinct()
    seq = sequence_tables({n: d.join(ids, "patient_id", "left_semi") for n, d in cleaned.items()},
                          patients.join(ids, "patient_id", "left_semi"), voc, settings, spans=True)
    rows = timeline.drop_oov(timeline.explode_rows(dealt_by_patient(seq, keep), voc.width))
    first_numeric, first_time = label_bounds(voc.catalog)
    lines = timeline.lines_as_of(
        timeline.rows_with_spans(rows, settings.segment_minutes), asked, voc.catalog, first_numeric, first_time,
        settings.numeric_bins, settings.td_small_step, settings.td_large_step, settings.segment_minutes,
        settings.td_sections)
    flagged = flag_periods(lines, periods_of(settings))
    return flagged.select(
        "request_id", "ts", "age_min", "time_available_min", "original_value", "type", "priority",
        "unique_record_id", "numeric", "tokens", "row_no", "admitted", *scalars.COMPONENT_SCALE, *periods_of(settings),
        "effective_length", "label")


class BlockStore:
    """`keep` function that writes the stages by patient in patient blocks and the others as plain Parquet.

    All blocks of a store have the same number of buckets, so joins between them move nothing.
    """

    def __init__(self, folder: str, buckets: int | None = None, most_rows: int = blocks.MOST_ROWS):
        self.folder, self.buckets, self.most_rows = folder.rstrip("/"), buckets, most_rows
        self.plain, self.whole = stored_in(folder), True

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if name not in BLOCK_ORDER:
            return self.plain(name, df)
        order = [c for c in BLOCK_ORDER[name] if c in df.columns]
        # Stages derived from whole blocks have a few rows for each of theirs.
        bounded = self.whole and name in DERIVED
        table = blocks.write_blocks(df, f"{self.folder}/{name}", order, buckets=self.buckets, most_rows=self.most_rows, bounded=bounded)
        self.buckets = self.buckets or table.buckets
        self.whole = self.whole and table.segment_minutes is None
        return table.frame


def scan_settings(settings: Settings, keep: Callable) -> Settings:
    """Whole patients are scanned where all blocks stored so far are free of oversized ones."""
    return replace(settings, segment_minutes=None) if getattr(keep, "whole", False) else settings


def dealt_by_patient(df: DataFrame, keep: Callable) -> DataFrame:
    """The rows as a `BlockStore` deals them, where all patients are whole.

    Aggregates and scans by patient, and the store itself, then need no shuffle of their own.
    """
    return df.repartition(keep.buckets, "patient_id") if getattr(keep, "whole", False) and keep.buckets else df


def stored_in(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """`keep` function that writes each stage to a shared folder."""
    def keep(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    return keep
