import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoline.functions import scalars as c
from chronoline.operators.clean import clean_records, cleaning_report
from chronoline.schema import CLEANING_RULES
from chronoline.sources import records
from chronoline.streaming import clean_stream

LAB_HEADER = "patient_id,timestamp,item_code,numeric,unit,nonnumeric"


def write(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def lab_files(tmp_path):
    nulls = ["", "NA", "N/A", "na", "nan", "NaN", "NaT", "None", "none"]
    write(tmp_path, "labs_1.csv", LAB_HEADER, *[f"p1,2020/01/02 03:04,L{i},{x},mg,(+)" for i, x in enumerate(nulls)])
    write(tmp_path, "labs_2.csv", LAB_HEADER, "p1,2020/01/02 03:04,L9,1.5,mg,", "p2,2020/01/02 03:04,L9,bad,mg,",
          "p3,2020/01/02 03:04,L9,2,mg,x")
    return str(tmp_path / "labs_*.csv")


@pytest.fixture
def patients(spark):
    return spark.createDataFrame([("p1", dt.date(2000, 1, 1)), ("p3", dt.date(2021, 1, 1))],
                                 "patient_id string, date_of_birth date")


def test_null_strings_and_bad_numbers(spark, lab_files):
    got = records.read_records(spark, lab_files, "laboratory_results")
    assert got.count() == 12
    assert got.filter(F.col("numeric").isNotNull()).count() == 2
    assert dict(got.dtypes)["timestamp"] == "timestamp_ntz" and "time_available" in got.columns
    assert got.filter(F.col("time_available").isNotNull()).count() == 0


def test_missing_required_column(spark, tmp_path):
    write(tmp_path, "a.csv", "patient_id,timestamp", "p,2020/01/01 00:00")
    with pytest.raises(ValueError, match="item_code"):
        records.read_records(spark, str(tmp_path / "a.csv"), "prescription_orders")
    assert records.read_records(spark, str(tmp_path / "a.csv"), "admissions").columns[-1] == "department"


def test_bad_date_is_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "patient_id,timestamp", "p,01-02-2020")
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "a.csv"), "admissions").collect()


def test_validation_counts(spark, lab_files, patients):
    report = records.validate_table(records.read_records(spark, lab_files, "laboratory_results"),
                                    "laboratory_results", patients)
    found = {(r["rule"], r["column"]): r["violations"] for r in report.collect()}
    assert found[("exactly_one", "numeric,nonnumeric")] == 2
    assert found[("foreign_key", "patient_id")] == 1
    dup = spark.createDataFrame([("a", "M"), ("a", "X")], "patient_id string, sex string").withColumns({
        "first_name": F.lit("x"), "last_name": F.lit("y"), "date_of_birth": F.lit(None).cast("date")})
    found = {(r["rule"], r["column"]): r["violations"] for r in records.validate_table(dup, "patients").collect()}
    assert found[("unique", "patient_id")] == 1 and found[("allowed", "sex")] == 1
    assert found[("not_null", "date_of_birth")] == 2


def test_cleaning(spark, lab_files, patients):
    raw = records.read_records(spark, lab_files, "laboratory_results")
    any_of, all_of = CLEANING_RULES["laboratory_results"]
    got = clean_records(raw, patients, any_of, all_of, available="time_available")
    assert {r["patient_id"] for r in got.collect()} == {"p1"}  # p2 unknown, p3 born later
    assert got.filter(F.col("time_available_min") != 0).count() == 0
    report = cleaning_report(raw, patients, any_of, all_of, "timestamp").first()
    assert (report["rows_before"], report["rows_missing"], report["negative_ages"], report["rows_after"]) == (12, 1, 1, 10)


def test_record_ids_are_serial_and_stable(spark):
    frame = spark.range(100).select(F.col("id").cast("string").alias("k"))
    a = records.assign_record_ids(frame, "diagnoses", ["k"]).collect()
    b = records.assign_record_ids(frame.repartition(9), "diagnoses", ["k"]).collect()
    assert sorted(a) == sorted(b)
    assert {r["unique_record_id"] for r in a} == {f"DX{i}" for i in range(1, 101)}


def test_dataset_sidecar(spark, tmp_path):
    frame = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    stored = records.write_dataset(frame, str(tmp_path / "d"), ["split"], {"bins": "501"})
    assert stored.filter(F.col("split") == "test").count() == 3
    note = spark.read.parquet(str(tmp_path / "d_info")).first()
    assert note["n_rows"] == 10 and note["parameters"] == {"bins": "501"}


def test_stateless_stages_run_on_a_stream(spark, tmp_path, patients):
    batch = spark.createDataFrame([("p1", dt.datetime(2020, 1, 1, 1, 1, 30), "A"), ("p1", None, "A"), ("p3", dt.datetime(2020, 1, 1), "B")],
                                  "patient_id string, timestamp timestamp_ntz, item_code string")
    batch.write.parquet(str(tmp_path / "in"))
    tokens = spark.createDataFrame([("A", [3, 20])], "original_value string, tokens array<int>")
    args = (patients, ["patient_id", "timestamp", "item_code"], tokens, 2)
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = clean_stream(stream, *args).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    want = clean_stream(batch, *args)
    assert sorted(map(str, spark.table("cleaned").collect())) == sorted(map(str, want.collect()))
    assert want.count() == 1 and want.select(c.age_text("age_min").alias("t")).first()["t"].endswith("01:01")


def test_files_are_read_by_their_own_header(spark, tmp_path):
    write(tmp_path, "a.csv", "patient_id,timestamp,item_code", "p1,2020/01/01 00:00,X")
    write(tmp_path, "b.csv", "item_code,patient_id,timestamp,extra", "Y,p2,2020/01/02 00:00,z")
    got = records.read_records(spark, str(tmp_path / "*.csv"), "prescription_orders")
    assert sorted((r["patient_id"], r["item_code"]) for r in got.collect()) == [("p1", "X"), ("p2", "Y")]


def test_optional_columns_are_settled_per_file(spark, tmp_path):
    write(tmp_path, "a.csv", "department,patient_id,timestamp", "d,p1,2020/01/01 00:00")
    write(tmp_path, "b.csv", "patient_id,timestamp", "p2,2020/01/02 00:00")
    got = records.read_records(spark, str(tmp_path / "*.csv"), "admissions")
    assert sorted((r["patient_id"], r["department"]) for r in got.collect()) == [("p1", "d"), ("p2", None)]
    write(tmp_path, "c.csv", "timestamp", "2020/01/02 00:00")
    with pytest.raises(ValueError, match="patient_id"):
        records.read_records(spark, str(tmp_path / "*.csv"), "admissions")


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from chronoline import session

    class Cluster:
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()
        conf = type("F", (), {"get": staticmethod(lambda key, default=None: default)})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_many_files_cost_few_jobs(spark, tmp_path):
    """Headers of hundreds of files, quoted, compressed, in two orders, with blank first lines and an empty file."""
    import gzip
    for k in range(300):
        quoted = k % 3 == 0
        head = '"patient_id","item_code","timestamp"' if quoted else "timestamp,patient_id,item_code"
        row = f"p{k},c{k % 4},2020/01/02 03:04" if quoted else f"2020/01/02 03:04,p{k},c{k % 4}"
        text = ("\n" if k % 7 == 0 else "") + head + "\n" + row + "\n"
        if k % 5 == 0:
            with gzip.open(tmp_path / f"orders {k}.csv.gz", "wt") as out:
                out.write(text)
        else:
            (tmp_path / f"orders {k}.csv").write_text(text)
    (tmp_path / "orders none.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    frame = records.read_records(spark, str(tmp_path / "orders*"), "prescription_orders")
    # Two distinct headers; listing and parsing cost a few jobs, none for each file.
    assert len(tracker.getJobIdsForGroup("headers")) <= 8
    spark.sparkContext.setJobGroup("other", "other")
    got = {(r.patient_id, r.item_code) for r in frame.collect()}
    assert got == {(f"p{k}", f"c{k % 4}") for k in range(300)}
