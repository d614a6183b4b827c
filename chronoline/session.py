"""Session defaults and the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Joins carry no broadcast hints for tables that grow with the data: Spark
# broadcasts below the threshold by measured size and otherwise shuffles, and
# adaptive execution splits the partitions of a hot key.
# A union that hands on the partitioning of its children loses that property when an exchange
# below it is shared with another branch (Spark 4.1); windows and aggregates above it, planned
# without an exchange of their own, then see parts of their groups. So unions hand on none.
DEFAULTS = {
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "chronoline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on in a given session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the session names in `spark.checkpoint.dir`.

    A local session without that setting gets a temporary folder, the same one
    for its whole life. On a cluster such a folder would differ from machine to
    machine, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="chronoline-")
    return _LOCAL_FOLDERS[app]
