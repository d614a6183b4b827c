"""Queries that take their whole tables."""

import checks.q_clean as q_clean


def test_brand_map_has_every_brand_of_small_parts(spark, rows, tmp_path):
    rows([(1, "Brand#13", 5), (2, "Brand#13", 3), (3, "Brand#22", 7), (4, "Brand#43", 25), (5, "Brand#55", 26)],
         "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = {r["original_value"]: r["tokens"] for r in q_clean.brand_map(spark, str(tmp_path)).collect()}
    assert found == {"Brand#13": [3, 1, 0], "Brand#22": [3, 3, 0], "Brand#43": [3, 4, 0]}


def _events(rows, tmp_path):
    data = [(i, f"2024-01-{1 + i % 28:02d} {i % 24:02d}:{i % 60:02d}:00", i % 5, ["signup", "view", "click", "error", "purchase"][(i // 5) % 5], float(i % 50))
            for i in range(400)]
    df = rows(data, "event_id long, t string, user_id long, event_type string, value double").selectExpr(
        "event_id", "cast(t as timestamp_ntz) as ts", "user_id", "event_type", "value")
    df.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_stages_of_whole_patients_are_scanned_where_they_lie(spark, rows, tmp_path):
    """Rows by patient move once, before they are taken apart; no scan of a stored stage moves them again."""
    import __spark_entry__ as entry
    sf = _events(rows, tmp_path)
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")
    for name in ("time_noise", "label_time", "time_shuffle", "event_view"):
        df = entry.queries()[name](spark, sf)
        assert moves(df) == 0 and df.count() > 0, name


def test_bounded_blocks_are_computed_once_and_dealt_again_if_oversized(spark, rows, tmp_path):
    from pyspark.sql import functions as F
    from chronoline.sources import blocks
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    df = rows([(str(i % 4), i) for i in range(40)], "patient_id string, age_min long").withColumn(
        "age_min", F.udf(mark, "long", useArrow=False)("age_min"))
    small = blocks.write_blocks(df, str(tmp_path / "small"), ["age_min"], buckets=4, bounded=True)
    assert seen.value == 40 and (small.n_rows, small.largest, small.segment_minutes) == (40, 10, None)
    grown = blocks.write_blocks(df, str(tmp_path / "grown"), ["age_min"], buckets=4, most_rows=5, bounded=True)
    assert (grown.n_rows, grown.largest, grown.segment_minutes) == (40, 10, blocks.PIECE_MINUTES)
    assert sorted(grown.frame.collect()) == sorted(small.frame.collect())


def test_lab_distribution_picks_values_before_it_spreads_them(rows):
    from chronoline.operators import simeval
    window = "patient_id string, admission_no int, day int, sim_id string"
    matched = rows([("a", 0, 0, s, 6, 5, "L", "1.5 u", 1, 1) for s in ("real", "s0")],
                   window + ", type int, age_min long, code string, result string, event_id long, horizon int")
    out = simeval.lab_distribution(matched, matched.select("patient_id", "admission_no", "day", "sim_id"), ["L"], 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(horizon") < plan.index("min_by(")
    assert sorted((r["sim_id"], r["reach"], r["L"]) for r in out.collect()) == [(s, h, 1.5) for s in ("real", "s0") for h in (1, 2, 3)]


def test_counterfactual_labs_join_their_tables_once(spark, rows, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from checks import views
    calls = []

    def labs(session, sf):
        calls.append(sf)
        return rows([("a", "2000-01-01", "Brand#9", 5.0, "u", None, "1", 1), ("a", "2000-01-02", "Brand#1", 7.0, "u", None, "2", 2)],
                    "patient_id string, d string, item_code string, numeric double, unit string, nonnumeric string, record_no string, line_no long"
                    ).selectExpr("*", "cast(d as date) as ts").drop("d")
    monkeypatch.setattr(views, "labs", labs)
    assert entry.queries()["counterfactual_lab"](spark, str(tmp_path)).count() == 6
    assert len(calls) == 1


def _plain_timelines(b, cleaned, times):
    """Timelines of the records known by one time for each patient, by the steps of the dataset build."""
    from pyspark.sql import functions as F
    from checks.q_timeline import SETTINGS
    from chronoline.functions import ordered as o
    from chronoline.operators import timeline
    from chronoline.plans import create_dataset as plan
    seen = {n: d.join(times, "patient_id").filter("age_min <= as_of_min and time_available_min <= as_of_min").drop("as_of_min")
            for n, d in cleaned.items()}
    people = b.people.join(times, "patient_id").drop("as_of_min")
    rows = timeline.drop_oov(timeline.explode_rows(plan.sequence_tables(seen, people, b.voc, SETTINGS), b.voc.width))
    line = timeline.build_timeline(rows, None, 7, b.voc.width, end_row=False)
    kept = timeline.drop_repeated_time_rows(line, ["row_no"], F.col("priority") == 0)
    line = o.ordered_scan(kept, ["patient_id"], ["row_no"], F.floor(F.col("row_no") / 4096), {"n": o.row_number()})
    return plan.label_rows(line.withColumn("row_no", (F.col("n") - 1).cast("int")).drop("n"), b.voc, None, SETTINGS)


def test_requests_pick_from_rows_made_once(spark, rows, tmp_path):
    """Rows are taken apart before they are copied to requests, and late copies, better ones among them,
    are seen from their time on."""
    from pyspark.sql import functions as F
    from checks import q_timeline as q
    from chronoline.plans import create_dataset as plan
    b = q.build(spark, _events(rows, tmp_path))
    rid = F.col("unique_record_id")
    late = F.col("age_min") + F.when(F.crc32(rid) % 3 == 0, 0).when(F.crc32(rid) % 3 == 1, 600).otherwise(9000)
    cleaned = dict(b.cleaned)
    for name, letter in (("laboratory_results", "A"), ("laboratory_results", "X"), ("prescription_orders", "A"), ("discharges", "Z")):
        copies = cleaned[name].withColumn("time_available_min", late.cast("long")).withColumn(
            "unique_record_id", F.concat(F.lit(letter), rid))
        if name == "laboratory_results":
            copies = copies.withColumns({"nonnumeric": F.when(F.lit(letter == "X"), F.lit("(+)")).otherwise(F.col("nonnumeric")),
                                         "numeric": F.when(F.lit(letter == "A"), F.col("numeric") + 1)})
        cleaned[name] = cleaned[name].unionByName(copies)
    first = spark.createDataFrame(b.cleaned["laboratory_results"].groupBy("patient_id").agg(F.min("age_min")).collect(),
                                  "patient_id string, age long")
    days = {"0": 3, "1": 5, "2": 9, "3": 14, "4": 40}
    asked = first.select("patient_id", F.explode(F.array(*map(F.lit, days.values()))).alias("day"), "age").select(
        F.concat_ws(":", "patient_id", "day").alias("request_id"), "patient_id", (F.col("age") + F.col("day") * 1440 + 5).alias("as_of_min"))
    # asked again: earlier, or at no time
    again = asked.withColumn("as_of_min", F.when(F.col("patient_id") == "1", F.col("as_of_min") - 700))
    got = plan.timelines_as_of(cleaned, b.people, asked.unionByName(again), b.voc, q.SETTINGS)
    tree = got._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("as_of_min#") < tree.index("explode(array(")
    cols = ["row_no", "ts", "age_min", "time_available_min", "original_value", "type", "priority", "unique_record_id",
            "numeric", "admitted", "effective_length", "label"]
    checked = [f"{p}:{d}" for p, d in days.items()]
    times = asked.filter(F.col("request_id").isin(checked)).select("patient_id", "as_of_min")
    expected = sorted(str(tuple(r)) for r in _plain_timelines(b, cleaned, times).select("patient_id", *cols).collect())
    assert b.keep.whole and len(expected) > 300
    for out in (got, plan.timelines_as_of(cleaned, b.people, asked.unionByName(again), b.voc, q.SETTINGS, b.keep)):
        picked = out.filter(F.col("request_id").isin(checked))
        assert sorted(str(tuple(r)) for r in picked.select(F.substring_index("request_id", ":", 1), *cols).collect()) == expected
