"""Vocabulary, token rows, timelines, labels, event view, matrices and decoding."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from checks.q_scalars import time_bin_sql
from chronoline import fixed_values as fv
from chronoline.functions import scalars as c
from chronoline.operators import matrix, timeline, vocab
from chronoline.plans import create_dataset as plan
from chronoline.session import shared_dir
from chronoline.settings import Settings

Q = Queries()
DAY = 1440
SETTINGS = Settings(
    train_start=v.TRAIN[0], train_end=v.TRAIN[1], test_start=v.TEST[0], test_end=v.TEST[1],
    numeric_bins=51, max_length=64, min_length=40, token_width=10,
    segment_sizes={"dx": (1, 2, 1), "med": (3, 1, 1, 2)})
NOTHING = "system string, item_code string, item_name string"


class Build:
    """Stages of the dataset build on the event views.

    Cleaned records, vocabulary, timeline and labelled timeline are written to the shared
    folder once per session, as a dataset build does, those by patient in patient blocks.
    """

    def __init__(self, spark, sf):
        self.folder = f"{shared_dir(spark).rstrip('/')}/dataset-{uuid.uuid4().hex}"
        self.keep = plan.BlockStore(self.folder)
        self.people = v.people(spark, sf)
        records = v.record_tables(spark, sf)
        self.cleaned = {n: self.keep(f"cleaned_{n}", d) for n, d in plan.clean_tables(records, self.people).items()}
        self.splits = self.keep("splits", v.ev_splits(spark, sf))
        self.settings = plan.scan_settings(SETTINGS, self.keep)
        names = spark.createDataFrame([], NOTHING)
        self.voc = plan.build_vocabulary(self.cleaned, self.splits, names, SETTINGS, self.keep)
        self._line = self._labelled = None

    def rows(self):
        return plan.sequence_tables(self.cleaned, self.people, self.voc, SETTINGS)

    def token_rows(self):
        return timeline.explode_rows(plan.dealt_by_patient(self.rows(), self.keep), self.voc.width)

    def segment(self):
        """Width of the pieces of a patient; none where whole patients are scanned."""
        return plan.scan_settings(SETTINGS, self.keep).segment_minutes

    def line(self):
        if self._line is None:
            self._line = self.keep("timeline", timeline.build_timeline(
                timeline.drop_oov(self.token_rows()), plan.periods_of(SETTINGS),
                fv.OPERATIONAL_TOKENS.index("[EOT]"), self.voc.width, segment_minutes=self.settings.segment_minutes))
        return self._line

    def labelled(self):
        if self._labelled is None:
            self._labelled = self.keep("labelled", plan.label_rows(
                self.line(), self.voc, self.splits, plan.scan_settings(self.settings, self.keep)))
        return self._labelled


_BUILDS: dict = {}


def build(spark, sf) -> Build:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILDS:
        _BUILDS[key] = Build(spark, sf)
    return _BUILDS[key]


def token_columns(array="tokens"):
    return [F.col(array)[i].alias(f"t{i}") for i in range(5)]


def record_columns():
    return ["unique_record_id", "type", "code", *token_columns("code_tokens"), F.round("result_numeric", 6).alias("rnum"),
            F.col("result_index").alias("ridx"), F.col("result_text").alias("rtext")]


_SEQ = "select rid as unique_record_id, type, code, t0, t1, t2, t3, t4, round(rnum, 6) as rnum, ridx, rtext from seq where "


@Q.add(_SEQ + "type = 0")
def sequence_demographics(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_demographics(b.people, b.voc.specials, b.voc.width).select(*record_columns())


@Q.add(_SEQ + "type = 1")
def sequence_admissions(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_admissions(b.cleaned["admissions"], b.voc.specials, b.voc.width).select(*record_columns())


@Q.add(_SEQ + "type = 2")
def sequence_discharges(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_discharges(b.cleaned["discharges"], b.voc.specials, b.voc.width).select(*record_columns())


@Q.add(_SEQ + "type = 3")
def sequence_diagnoses(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_codes(b.cleaned["diagnoses"], b.voc.code_map, "dx", 3, b.voc.width).select(*record_columns())


@Q.add(_SEQ.replace(" type,", " 5 as type,") + "type = 5")
def sequence_prescriptions(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_codes(b.cleaned["prescription_orders"], b.voc.code_map, "med", 5,
                                   b.voc.width).select(*record_columns())


@Q.add(_SEQ + "type = 5")
def sequence_injections(spark, sf):
    """The order records read as injections."""
    b = build(spark, sf)
    return timeline.sequence_codes(b.cleaned["prescription_orders"], b.voc.code_map, "med", fv.INJECTION,
                                   b.voc.width).select(*record_columns())


@Q.add(_SEQ + "type = 6")
def sequence_labs(spark, sf):
    b = build(spark, sf)
    return timeline.sequence_labs(b.cleaned["laboratory_results"], b.voc.grids, b.voc.nonnumeric,
                                  b.voc.code_map, b.voc.specials, b.voc.width, 51).select(*record_columns())


@Q.add("""select patient_id, age_min, time_available_min, original_value, type, sort_code, priority, round(num, 6) as num,
 t0, t1, t2, t3, t4, rid from token_rows""")
def explode_rows(spark, sf):
    return build(spark, sf).token_rows().select(
        "patient_id", "age_min", "time_available_min", "original_value", "type", "sort_code", "priority",
        F.round("numeric", 6).alias("num"), *token_columns(), F.col("unique_record_id").alias("rid"))


@Q.add("select patient_id, rid, priority, original_value from known_rows")
def drop_oov(spark, sf):
    return timeline.drop_oov(build(spark, sf).token_rows()).select(
        "patient_id", F.col("unique_record_id").alias("rid"), "priority", "original_value")


@Q.add("select type, original_value, count(*) as n_rows from token_rows where t0 = -2 group by 1, 2")
def oov_report(spark, sf):
    return timeline.oov_report(build(spark, sf).token_rows())


@Q.add("""select patient_id, age_min, original_value, type, priority, rid, round(num, 6) as num, t0, t1, t2, t3, t4, row_no, admitted from tl""")
def build_timeline(spark, sf):
    return build(spark, sf).line().select(
        "patient_id", "age_min", "original_value", "type", "priority",
        F.col("unique_record_id").alias("rid"), F.round("numeric", 6).alias("num"), *token_columns(),
        F.col("row_no").cast("long").alias("row_no"), "admitted")


@Q.add("""
select patient_id, original_value, row_number() over (partition by patient_id order by sort_age, type, sort_code, priority, rid) as position,
 rid, priority from tl0""")
def timeline_order(spark, sf):
    from chronoline.functions import ordered as o
    b = build(spark, sf)
    rows = timeline.drop_oov(b.token_rows())
    merged = timeline.dedup_rows(rows, [k for k in timeline.ROW_KEY if k != "time_available_min"])
    from chronoline.operators.clean import drop_out_of_period, flag_periods
    kept = drop_out_of_period(flag_periods(merged, plan.periods_of(SETTINGS)))
    head = F.col("type") == 0
    keyed = kept.withColumn("sort_age", F.when(head, F.lit(-1)).otherwise(F.col("age_min")))
    return o.ordered_scan(keyed, ["patient_id"], timeline.TIMELINE_ORDER, o.time_segment("sort_age", b.segment()),
                          {"position": o.row_number()}).select(
        "patient_id", "original_value", "position", F.col("unique_record_id").alias("rid"), "priority")


_LABELLED = f"""(select t.*, split, cast(case when t.row_no = 0 then -1 when original_value = '[EOT]' and admitted = 1 then -1
  when priority = 0 then {time_bin_sql('prev', 't.age_min', "(select min(label) from catalog where kind = 'time')")}
  when num is not null then (select min(label) from catalog where kind = 'numeric') + round(num * 50)
  when t0 <> 0 and t1 = 0 then t0 else coalesce(code_label, -1) end as int) as label,
  cast(ts between timestamp '{v.TRAIN[0]} 00:00:00' and timestamp '{v.TRAIN[1]} 23:59:59' as int) as train_period,
  cast(ts between timestamp '{v.TEST[0]} 00:00:00' and timestamp '{v.TEST[1]} 23:59:59' as int) as test_period
 from (select tl.*, c.label as code_label, split, cast(date_of_birth as timestamp) + to_minutes(tl.age_min) as ts,
   lag(tl.age_min) over (partition by tl.patient_id order by tl.row_no) as prev
  from tl join ev_splits using (patient_id) join patients using (patient_id)
  left join (select original_value as value, min(label) as label from catalog where kind in ('dx', 'med', 'lab') group by 1) c on c.value = tl.original_value) t)"""
_OWN = "(type = 0 or case when split = 'test' then test_period else train_period end = 1)"


@Q.add(f"""select patient_id, row_no, label, train_period, test_period,
 cast(sum(cast({_OWN} as int)) over (partition by patient_id) >= 40 as int) as included from {_LABELLED}""")
def label_timeline(spark, sf):
    return build(spark, sf).labelled().select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"), "label", "train_period", "test_period", "included")


@Q.add("""select tl.patient_id, row_no, c.label as code_label from tl
 left join (select original_value as value, min(label) as label from catalog where kind in ('dx', 'med', 'lab') group by 1) c on c.value = tl.original_value""")
def label_codes(spark, sf):
    b = build(spark, sf)
    return timeline.label_codes(b.line(), b.voc.catalog).select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"), F.col("code_label").cast("long").alias("code_label"))


@Q.add("select patient_id, row_no, case when t0 <> 0 and t1 = 0 then t0 end as token_label from tl")
def label_tokens(spark, sf):
    return build(spark, sf).line().select("patient_id", F.col("row_no").cast("long").alias("row_no"),
                                          timeline.token_label().cast("long").alias("token_label"))


@Q.add("select patient_id, row_no, 1000 + cast(round(num * 50) as bigint) as numeric_label from tl where num is not null")
def label_numerics(spark, sf):
    return build(spark, sf).line().filter(F.col("numeric").isNotNull()).select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"),
        timeline.numeric_label("numeric", 1000, 51).cast("long").alias("numeric_label"))


@Q.add(f"""select patient_id, row_no, {time_bin_sql('prev', 'age_min', '2000')} as time_label from
 (select *, lag(age_min) over (partition by patient_id order by row_no) as prev from tl) where priority = 0 and row_no > 0""")
def label_time(spark, sf):
    b = build(spark, sf)
    line = b.line()
    pairs = matrix.time_pairs(line, b.segment()).filter(F.col("row_no") > 0)
    return pairs.select("patient_id", F.col("row_no").cast("long").alias("row_no"),
                        c.time_bin_label("shifted", "original", 2000).alias("time_label"))


@Q.add(f"""select patient_id, cast(sum(cast({_OWN} as int)) as bigint) as effective_length,
  cast(max(cast(label = 9 as int)) as int) as died, cast(ceil(sum(cast({_OWN} as int)) / 64.0) as int) as sampling_points,
  cast(sum(cast({_OWN} as int)) >= 40 as int) as included from {_LABELLED} group by patient_id""")
def timeline_metadata(spark, sf):
    death = 9  # index of the token of a death at discharge
    return matrix.timeline_metadata(build(spark, sf).labelled(), 64, 40, death).drop("split")


@Q.add(f"""select patient_id, cast(sum(cast({_OWN} as int)) over (partition by patient_id) as bigint) as effective_length, row_no from {_LABELLED}""")
def effective_length(spark, sf):
    return build(spark, sf).labelled().select("patient_id", "effective_length",
                                              F.col("row_no").cast("long").alias("row_no"))


@Q.add("""
select patient_id, age_min, original_value as code, row_no, case when next_rid = rid then coalesce(next_value, '') else '' end as result from (
 select *, lead(original_value) over w as next_value, lead(rid) over w as next_rid, lag(rid) over w as prev_rid
 from tl where coalesce(original_value, '') <> '' window w as (partition by patient_id order by row_no))
where prev_rid is null or prev_rid <> rid""")
def event_view(spark, sf):
    b = build(spark, sf)
    labelled = b.labelled()
    return timeline.event_view(labelled, b.voc.catalog, b.segment()).select(
        "patient_id", "age_min", "code", F.col("row_no").cast("long").alias("row_no"), "result")


@Q.add("select token, index from specials")
def special_tokens(spark, sf):
    return build(spark, sf).voc.specials.select("token", F.col("index").cast("long").alias("index"))


@Q.add("select system, segment, token, index from vocab")
def vocabulary(spark, sf):
    return build(spark, sf).voc.tokens.select("system", "segment", "token", F.col("index").cast("long").alias("index"))


@Q.add("select system, code as original_value, tokenized_value, t0, t1, t2, t3, t4 from code_map")
def vocabulary_code_map(spark, sf):
    return build(spark, sf).voc.code_map.select("system", "original_value", "tokenized_value", *[
        F.col("tokens")[i].cast("long").alias(f"t{i}") for i in range(5)])


@Q.add("select label, kind, case when kind = 'numeric' then '' else original_value end as original_value from catalog")
def catalog(spark, sf):
    table = build(spark, sf).voc.catalog
    return table.select(F.col("label").cast("long").alias("label"), "kind", F.when(
        F.col("kind") == "numeric", "").otherwise(F.col("original_value")).alias("original_value"))


@Q.add("""
select cast(label as bigint) as label, text from (select label,
 case when p < 144 then '+ ' || cast(p * 10 as varchar) || '-' || cast(p * 10 + 9 as varchar) || ' minutes'
  when p = 1560 then 'over 1800 days' else
  case when p < 864 then '+ ' || cast((p - 144) // 24 + 1 as varchar) || ' days'
   when p < 1224 then '+ ' || cast((p - 864) // 24 * 10 + 31 as varchar) || '-' || cast((p - 864) // 24 * 10 + 40 as varchar) || ' days'
   when p < 1368 then '+ ' || cast((p - 1224) // 24 * 30 + 181 as varchar) || '-' || cast((p - 1224) // 24 * 30 + 210 as varchar) || ' days'
   else '+ ' || cast((p - 1368) // 24 * 180 + 361 as varchar) || '-' || cast((p - 1368) // 24 * 180 + 540 as varchar) || ' days' end
  || ' & ' || lpad(cast(p % 24 as varchar), 2, '0') || ':00-' || lpad(cast(p % 24 as varchar), 2, '0') || ':59' end as text
 from (select label, label - min(label) over () as p from catalog where kind = 'time'))""")
def catalog_time_texts(spark, sf):
    table = vocab.catalog_slice(build(spark, sf).voc.catalog, "time")
    return table.select(F.col("label").cast("long").alias("label"), "text")


@Q.add("select label, kind, original_value from catalog where kind in ('dx', 'med', 'lab')")
def catalog_slice(spark, sf):
    return vocab.catalog_slice(build(spark, sf).voc.catalog, "all_codes").select(
        F.col("label").cast("long").alias("label"), "kind", "original_value")


@Q.add("select kind, min(label) as first_label, max(label) as last_label, count(*) as n_labels from catalog group by 1")
def label_ranges(spark, sf):
    ranges = vocab.label_ranges(build(spark, sf).voc.catalog)
    return ranges.groupBy("kind").agg(
        F.min("first_label").cast("long").alias("first_label"), F.max("last_label").cast("long").alias("last_label"),
        F.sum("n_labels").alias("n_labels"))


_MATRIX = f"""(select patient_id, row_no, admitted, t0, round(num, 5) as num, case when priority = 0 then round(age_min // 1440 // 365 / 120.0::double, 5) end as years,
 case when {_OWN} then label else -1 end as label from {_LABELLED})"""


def _exploded(m, keys):
    both = F.arrays_zip("rows", "labels")
    return m.select(*keys, F.posexplode(both).alias("pos", "x")).select(
        *keys, F.col("pos").cast("long").alias("pos"), F.col("x.labels").alias("label"),
        F.round(F.col("x.rows")[0].cast("double"), 5).alias("years"),
        F.round(F.col("x.rows")[5].cast("double"), 5).alias("num"),
        F.col("x.rows")[6].cast("long").alias("t0"),
        F.element_at("x.rows", -1).cast("int").alias("admitted"))


@Q.add(f"""
select b.patient_id, b.block_no, pos, coalesce(label, -1) as label, years, num, coalesce(t0, 0) as t0, coalesce(admitted, 0) as admitted
from (select distinct patient_id, row_no // 64 as block_no from tl) b cross join (select unnest(range(64)) as pos)
left join {_MATRIX} m on m.patient_id = b.patient_id and m.row_no = b.block_no * 64 + pos""")
def timeline_matrix(spark, sf):
    m = matrix.timeline_matrix(build(spark, sf).labelled(), 64, 5)
    return _exploded(m.withColumn("block_no", F.col("block_no").cast("long")), ["patient_id", "block_no"])


_POINTS = f"""(select patient_id, length, case when length > 64 and lo is not null then greatest(2, lo - 61) else 2 end as min_start,
 case when length > 64 and lo is not null then greatest(greatest(2, lo - 61), hi - 61) else 2 end as max_start
 from (select patient_id, max(row_no) + 1 as length, min(row_no) filter (row_no >= 2 and {_OWN}) as lo, max(row_no) filter (row_no >= 2 and {_OWN}) as hi
  from {_LABELLED} group by 1))"""


@Q.add(f"select patient_id, unnest(range(min_start, max_start + 1)) as start from {_POINTS}")
def slice_points(spark, sf):
    points = matrix.slice_points(build(spark, sf).labelled(), 64)
    return matrix.slice_point_rows(points).withColumn("start", F.col("start").cast("long"))


@Q.add("""select patient_id, row_no, age_min as original, prev as shifted from
 (select *, lag(age_min) over (partition by patient_id order by row_no) as prev from tl) where priority = 0""")
def time_pairs(spark, sf):
    b = build(spark, sf)
    line = b.line()
    return matrix.time_pairs(line, b.segment()).withColumn("row_no", F.col("row_no").cast("long"))


@Q.add(f"""
select patient_id, row_no, update_period, cast(sum(cast(update_period = 1 or type = 0 as int)) over (partition by patient_id) >= 20 as int) as included
from (select *, cast(ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-20 23:59:59' as int) as update_period from (select l.*, cast(date_of_birth as timestamp) + to_minutes(age_min) as ts
  from {_LABELLED} l join patients using (patient_id)) where split in ('train', 'validation'))""".replace("select l.*,", "select l.* exclude (ts),"))
def update_subset(spark, sf):
    return matrix.update_subset(build(spark, sf).labelled(), ("2024-01-10", "2024-01-20"), 20).select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"), "update_period", "included")


def _u(parts: str) -> str:
    return f"cast('0x' || substr(md5({parts}), 1, 13) as bigint)::double / 4503599627370496.0"


_KIND = _u("'0|0|' || patient_id || '|kind'")
_SPOT = _u("'0|0|' || patient_id || '|spot'")
_CHOSEN = f"""(select *, case when length <= 64 then 2 when pick = 0 then min_start when pick = 1 then max_start
  else min_start + cast(floor({_SPOT} * (max_start - min_start + 1)) as bigint) end as start from (
  select *, cast(floor({_KIND} * (ceil((max_start - min_start + 64) / 64.0) + 1)) as bigint) as pick from {_POINTS}))"""


@Q.add(f"""
select patient_id, start, pos, case when pos = 63 and start + 62 >= length then -1 when pos + 1 = 2 and start <> 2 then -1 else coalesce(nl, -1) end as label,
 years, num, coalesce(t0, 0) as t0, coalesce(admitted, 0) as admitted
from (select c.patient_id, c.start, c.length, pos, m.years, m.num, m.t0, m.admitted, n.label as nl from {_CHOSEN} c
 cross join (select unnest(range(64)) as pos)
 left join {_MATRIX} m on m.patient_id = c.patient_id and m.row_no = case when pos < 2 then pos else c.start + pos - 2 end
 left join {_MATRIX} n on n.patient_id = c.patient_id and n.row_no = case when pos + 1 < 2 then pos + 1 else c.start + pos - 1 end)""")
def training_windows(spark, sf):
    labelled = build(spark, sf).labelled()
    windows = matrix.training_windows(labelled, matrix.slice_points(labelled, 64), 64, 5)
    return _exploded(windows.withColumn("start", F.col("start").cast("long")), ["patient_id", "start"])


_SHUFFLE_KIND = """case when priority = 0 then 'time' when original_value = '[DSC]' then 'dsc' when original_value in ('[DSC_EXP]', '[DSC_ALV]') then 'disposition'
 when original_value = '[EOT]' then 'eot' when type = 6 and priority = 1 then 'lab' else 'other' end"""


def _draw(row: str) -> str:
    return f"cast(floor({_u(f'''concat_ws('|', '0', patient_id, replicate, {row})''')} * 1000) as bigint) + 1"


@Q.add(f"""
select patient_id, replicate, row_no, row_number() over (partition by patient_id, replicate order by block, pr, pair, row_no) - 1 as new_row_no from (
 select *, case when last then 1001 when leads then 0 when pk = 'lab' then {_draw('prow')} else {_draw('row_no')} end as pr,
  case when pk = 'lab' and not last and not leads then prow else row_no end as pair from (
  select *, row_no = n and kind in ('eot', 'lab') as last,
   kind = 'time' or row_no < 2 or kind = 'dsc' or (kind = 'disposition' and pk = 'dsc') as leads from (
   select *, sum(cast(kind = 'time' as int)) over (w rows unbounded preceding) as block, coalesce(lag(kind) over w, '') as pk, lag(row_no) over w as prow,
    max(row_no) over (partition by patient_id, replicate) as n from (
    select patient_id, row_no, {_SHUFFLE_KIND} as kind, unnest(range(2)) as replicate from tl)
   window w as (partition by patient_id, replicate order by row_no))))""")
def time_shuffle(spark, sf):
    value = F.coalesce("original_value", F.lit(""))
    kind = (F.when(F.col("priority") == 0, "time").when(value == "[DSC]", "dsc")
            .when(value.isin("[DSC_EXP]", "[DSC_ALV]"), "disposition").when(value == "[EOT]", "eot")
            .when((F.col("type") == 6) & (F.col("priority") == 1), "lab").otherwise("other"))
    b = build(spark, sf)
    rows = b.line().select("patient_id", "age_min", "row_no", kind.alias("kind"))
    out = matrix.time_shuffle(rows, replicates=2, segment_minutes=b.segment())
    return out.select("patient_id", F.col("replicate").cast("long").alias("replicate"),
                      F.col("row_no").cast("long").alias("row_no"), F.col("new_row_no").cast("long").alias("new_row_no"))


_NOISE = "cast(floor(cast('0x' || substr(md5(concat_ws('|', '0', '1', patient_id, 'noise')), 1, 13) as bigint)::double / 4503599627370496.0 * 121) as bigint) - 60"


@Q.add(f"""
select patient_id, row_no, noise as noise_min, case when type = 0 then age_min else new_age end as age_min,
 case when priority = 0 and row_no <> 0 and label <> {fv.IGNORED_LABEL} then {time_bin_sql('new_prev', 'new_age', '500')} else label end as label
from (select *, greatest(age_min + noise, head) as new_age, greatest(prev + noise, head) as new_prev
 from (select *, {_NOISE} as noise, max(age_min) filter (row_no = 0) over (partition by patient_id) as head from {_LABELLED}))""")
def time_noise(spark, sf):
    b = build(spark, sf)
    labelled = b.labelled()
    out = matrix.time_noise(labelled, 1, 500, segment_minutes=b.segment())
    return out.select("patient_id", F.col("row_no").cast("long").alias("row_no"), "noise_min", "age_min", "label")


@Q.add(f"""
select patient_id, row_no from (select patient_id, row_no, count(*) over (partition by patient_id) as n from tl)
where n <= 64 or row_no < 2 or row_no >= n - 62""")
def truncate_history(spark, sf):
    return matrix.truncate_history(build(spark, sf).line(), ["patient_id"], 64).select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"))


@Q.add(f"""
select patient_id, row_no, case when row_no = 0 and n <= 2 and anchor > last_age then anchor // 1440 * 1440 else age_min end as age_min
from (select *, count(*) over (partition by patient_id) - cast(anchor > last_age and ends as int) as n from (
 select *, max(age_min) over (partition by patient_id) as last_age, max(row_no) over (partition by patient_id) as last_row,
  arg_max(priority, row_no) over (partition by patient_id) = 0 and max(row_no) over (partition by patient_id) >= 2 as ends
 from (select *, 30000000 + cast(patient_id as bigint) * 200000 as anchor from tl where type <> 7)))
where not (anchor > last_age and ends and row_no = last_row)""")
def clean_history(spark, sf):
    rows = build(spark, sf).line().withColumns({
        "is_time": (F.col("priority") == 0).cast("int"),
        "anchor": F.lit(30000000) + F.col("patient_id").cast("long") * 200000})
    return matrix.clean_history(rows, ["patient_id"], "anchor", is_padding=F.col("type") == 7).select(
        "patient_id", F.col("row_no").cast("long").alias("row_no"), "age_min")


@Q.add("""
select patient_id, count(*) as n_rows, max(row_no) as last_row, cast(sum(admitted) as bigint) as n_admitted from tl where row_no >= 0 group by 1""")
def timeline_totals(spark, sf):
    """The same timeline through stored stages, condensed per patient."""
    return build(spark, sf).line().groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("row_no").cast("long").alias("last_row"),
        F.sum("admitted").alias("n_admitted"))


_ASKED = "(select patient_id, eval_min as as_of, patient_id || ':' || admission_no || ':' || day as request_id from snap)"


@Q.add(f"""
select * from (with known as (select request_id, ts, age_min, type, sort_code, priority, original_value, num, t0, t1, t2, t3, t4, min(rid) as rid from (
  select a.request_id, k.* from {_ASKED} a join known_rows k on k.patient_id = a.patient_id and (k.type = 0 or (k.age_min <= as_of and k.time_available_min <= as_of)))
 group by all),
sorted as (select *, row_number() over w as place, lag(priority) over w as before, min(age_min) filter (type <> 0) over (partition by request_id) as first_age
 from known window w as (partition by request_id order by case when type = 0 then -1 else age_min end, type, sort_code, priority, rid)),
numbered as (select *, row_number() over (partition by request_id order by place) - 1 as row_no,
  case when type = 0 then coalesce(first_age // 1440 * 1440, age_min) else age_min end as age
 from sorted where not (priority = 0 and coalesce(before, 1) = 0)),
stepped as (select *, lag(age) over (partition by request_id order by row_no) as prev from numbered)
select request_id, row_no, age as age_min, type, original_value, round(num, 6) as num,
 cast(case when row_no = 0 then -1 when priority = 0 then {time_bin_sql('prev', 'age', "(select min(label) from catalog where kind = 'time')")}
  when num is not null then (select min(label) from catalog where kind = 'numeric') + round(num * 50)
  when t0 <> 0 and t1 = 0 then t0 else coalesce(code_label, -1) end as int) as label
from stepped left join (select original_value as value, min(label) as code_label from catalog where kind in ('dx', 'med', 'lab') group by 1) c on c.value = original_value)""")
def single_patient_timeline(spark, sf):
    """Timelines as of every evaluation time, in one job."""
    b = build(spark, sf)
    requests = v.windows(spark, sf).select(
        "patient_id", F.col("eval_min").alias("as_of_min"),
        F.concat_ws(":", "patient_id", F.col("admission_no").cast("string"), F.col("day").cast("string"))
        .alias("request_id"))
    rows = plan.timelines_as_of(b.cleaned, b.people, requests, b.voc, SETTINGS, b.keep)
    return rows.select("request_id", F.col("row_no").cast("long").alias("row_no"), "age_min", "type", "original_value",
                       F.round("numeric", 6).alias("num"), "label")


@Q.add("""
select patient_id, row_no, original_value as code, age_min, case when prev_code is not null then '' else '' end as note from (
 select *, lag(original_value) over w as prev_code, lag(rid) over w as prev_rid from tl
 where coalesce(original_value, '') <> '' window w as (partition by patient_id order by row_no))
where (prev_rid is null or prev_rid <> rid)""".replace(", case when prev_code is not null then '' else '' end as note", ""))
def decode_timeline(spark, sf):
    """Labels back to events: codes and ages equal those of the event view."""
    b = build(spark, sf)
    line = b.line()
    labelled = timeline.label_codes(line, b.voc.catalog)
    first_numeric, _ = plan.label_bounds(b.voc.catalog)
    label = F.when(F.col("priority") == 0, F.lit(None).cast("int")).otherwise(F.coalesce(
        timeline.numeric_label("numeric", first_numeric, 51), timeline.token_label(), F.col("code_label")))
    seq = labelled.select("patient_id", "row_no", label.cast("int").alias("label"), F.when(
        (F.col("priority") == 0) | (F.col("row_no") < 2), F.col("age_min")).alias("age_min"))
    out = matrix.decode_timeline(seq, b.voc.catalog, b.voc.grids, bins=51)
    return out.select("patient_id", F.col("row_no").cast("long").alias("row_no"), "code", "age_min")
