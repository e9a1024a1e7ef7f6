"""Session settings. A value the cluster has already set is never replaced."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE picks join sides and partition counts from real sizes, which every plan
# of this package relies on instead of broadcast hints for data that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "flightpulse") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cluster_session(app: str = "flightpulse") -> SparkSession:
    """Session on a cluster: only fills in what spark-submit left open."""
    session = SparkSession.builder.appName(app).getOrCreate()
    for key, value in SETTINGS.items():
        if session.conf.get(key, None) is None and session.conf.isModifiable(key):
            session.conf.set(key, value)
    return session
