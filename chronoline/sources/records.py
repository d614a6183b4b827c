"""Reading, checking and writing record tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.schema import EVENT_VIEW, SOURCES, TableSpec

HEADER_READERS = 8


def _typed(name: str, kind: T.DataType) -> Column:
    text = F.when(F.col(name).isin(*fv.NULL_STRINGS), None).otherwise(F.col(name))
    if isinstance(kind, T.DateType):
        return F.to_date(text, fv.DATE_FORMAT)
    if isinstance(kind, T.TimestampNTZType):
        return F.to_timestamp(text, fv.TIMESTAMP_FORMAT).cast(kind)
    if isinstance(kind, T.DoubleType):
        number = text.try_cast("double")
        return F.when(~F.isnan(number), number)
    if isinstance(kind, T.IntegerType):
        return text.try_cast("double").try_cast("int")
    return text


def _first_line(spark: SparkSession, file: str) -> tuple[str, str]:
    """Path and first line that is not blank, read through Spark's own file systems; empty for an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        source = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8"))
        line = reader.readLine()
        while line is not None and not line.strip():
            line = reader.readLine()
        return path.toString(), line or ""
    finally:
        stream.close()


def _by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of a path or glob by their header line.

    Listing and the first lines cost no job however many files there are; each distinct
    first line is then parsed once, by the CSV reader itself.
    """
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(HEADER_READERS) as readers:
        lines: dict[str, list[str]] = {}
        for file, line in readers.map(lambda f: _first_line(spark, f), sorted(files)):
            lines.setdefault(line, []).append(file)
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, own in lines.items():
        header = tuple(spark.read.csv(spark.sparkContext.parallelize([line], 1), header=True, inferSchema=False).columns) if line else ()
        groups.setdefault(header, []).extend(own)
    return groups


def read_records(spark: SparkSession, path: str | list[str], spec: TableSpec | str) -> DataFrame:
    """Read the CSV files of one table by column name and cast them by its declaration.

    Every file is read by its own header, so files may differ in the order and
    choice of columns. Dates must follow the declared format (other text is an
    error), numbers that cannot be read become null, optional columns that a
    file lacks become nulls and an absent required column is an error.
    """
    spec = SOURCES[spec] if isinstance(spec, str) else spec
    parts = []
    for header, files in _by_header(spark, path).items():
        missing = [n for n in spec.columns if n not in header]
        required = [n for n in missing if n not in spec.optional]
        if header and required:
            raise ValueError(f"required columns are missing: {required} in {files[0]}")
        if header:
            # all files of a group have the same columns in the same places
            names = T.StructType([T.StructField(n, T.StringType()) for n in header])
            parts.append(spark.read.csv(files, header=True, schema=names).select(*[
                (F.lit(None).cast(t) if n in missing else _typed(n, t)).alias(n)
                for n, t in spec.columns.items()]))
    if not parts:
        raise ValueError(f"no file with a header: {path}")
    return reduce(DataFrame.unionByName, parts)


def validate_table(df: DataFrame, spec: TableSpec | str,
                   patients: DataFrame | None = None) -> DataFrame:
    """(rule, column, violations) for every declared rule of a table."""
    spec = SOURCES[spec] if isinstance(spec, str) else spec
    checks: list[tuple[str, str, Column]] = []
    for name in spec.not_null:
        checks.append(("not_null", name, F.col(name).isNull()))
    for name, allowed in spec.allowed.items():
        checks.append(("allowed", name, F.col(name).isNotNull() & ~F.col(name).isin(*allowed)))
    if spec.exactly_one:
        filled = sum((F.col(n).isNotNull().cast("int") for n in spec.exactly_one), F.lit(0))
        checks.append(("exactly_one", ",".join(spec.exactly_one), filled != 1))
    counted = df.agg(*[F.count_if(cond).alias(f"v{i}") for i, (_, _, cond) in enumerate(checks)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                 F.col(f"v{i}").alias("violations"))
        for i, (rule, col, _) in enumerate(checks)
    ]))
    report = counted.select(rows.alias("r")).select("r.*")
    for name in spec.unique:
        twice = df.groupBy(name).count().filter(F.col("count") > 1)
        report = report.unionByName(twice.agg(
            F.count(F.lit(1)).alias("violations")).select(
            F.lit("unique").alias("rule"), F.lit(name).alias("column"), "violations"))
    if spec.references_patient and patients is not None:
        # Counting per id first keeps a hot id from travelling row by row.
        per_id = df.filter(F.col("patient_id").isNotNull()).groupBy("patient_id").count()
        orphans = per_id.join(patients.select("patient_id"), "patient_id", "left_anti")
        report = report.unionByName(orphans.agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(
            F.lit("foreign_key").alias("rule"), F.lit("patient_id").alias("column"), "violations"))
    return report


def assign_record_ids(df: DataFrame, table: str, key: Sequence[str],
                      out: str = "unique_record_id") -> DataFrame:
    """Prefix plus serial number; serials follow the digest of the key columns.

    `key` must identify a row. The serial is found piece by piece, so no task
    sees the whole table, and it does not depend on how the rows are laid out.
    """
    digest = df.withColumn("__d", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key])))
    ranked = o.ordered_scan(digest, [], ["__d", *key], o.hash_segment("__d", o.digits_for(df.count())),
                            {"__n": o.row_number()})
    prefix = fv.RECORD_ID_PREFIXES[table]
    return ranked.withColumn(out, F.concat(F.lit(prefix), F.col("__n").cast("string"))
                             ).drop("__d", "__n")


def scan_patient(df: DataFrame, patient_id: str, start: Column | None = None,
                 end: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Records of one patient between two inclusive times."""
    cond = F.col("patient_id") == F.lit(patient_id)
    if start is not None:
        cond = cond & (F.col(ts) >= start)
    if end is not None:
        cond = cond & (F.col(ts) <= end)
    return df.filter(cond)


def scan_patients(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the patients in `ids`."""
    return df.join(ids.select("patient_id").distinct(), "patient_id", "left_semi")


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ("split",),
                  parameters: dict[str, str] | None = None) -> DataFrame:
    """Write a stage table as Parquet with a one-row note of counts and parameters."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    spark = df.sparkSession
    stored = spark.read.parquet(path)
    params = F.create_map(*[F.lit(x) for kv in (parameters or {"path": path}).items() for x in kv])
    note = stored.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("parameters", params)
    note.write.mode("overwrite").parquet(path.rstrip("/") + "_info")
    return stored


def read_event_view(spark: SparkSession, path: str, age_as_text: bool = False) -> DataFrame:
    """Event-view CSV with declared types; an age text becomes minutes."""
    names = [f.name for f in EVENT_VIEW.fields]
    fields = [T.StructField("age", T.StringType()) if n == "age_min" and age_as_text
              else EVENT_VIEW[n] for n in names]
    raw = spark.read.csv(path, header=True, schema=T.StructType(fields), nullValue="\u0000",
                         emptyValue="")
    if age_as_text:
        raw = raw.withColumn("age_min", c.parse_age_text("age"))
    return raw.select(*names).withColumn("result", F.coalesce("result", F.lit("")))
