"""Streaming ingestion: NDJSON log files -> standard events by domain and day, and quarantine.

Spark's file source keeps which files were read in the checkpoint folder.  Each
micro-batch goes to folders of its own, ``writer=<name>/batch=<number>``: a batch that
is run again after a crash overwrites what it wrote, so nothing is there twice.

Both sinks are create-only.  A batch's rows are held against all other folders of the
same days, never against its own earlier try.  Two writers may create one id at the
same time, as neither sees the other's unfinished batch; readers take the row of the
least (writer, batch), so an id has one row and stays what it was first seen as.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from watchloom.sources import ingest as I
from watchloom.sources import standard as N

EVENT_COLUMNS = ["raw_event_id", "organization_id", "event_time", "event_type", "category", "action", "outcome", "vendor_name", "vendor_product", "vendor_dataset", "host_name", "source_ip", "source_port", "destination_ip", "destination_port", "transport", "protocol", "duration", "bytes", "packets", "name", "path", "status_code", "quality", "provenance"]


def log_lines(spark: SparkSession, folder: str, most: int = 1 << 20) -> DataFrame:
    """A stream of the lines of a folder's text files: (value, file, line_id, error_code); a line over the cap is marked and loses its text."""
    x = spark.readStream.option("recursiveFileLookup", "true").text(folder).withColumn("file", F.col("_metadata.file_path"))
    return capped(x, most)


def capped(lines: DataFrame, most: int = 1 << 20) -> DataFrame:
    long = F.octet_length("value") > most
    return lines.withColumn("line_id", F.sha2("value", 256)).withColumn("error_code", F.when(long, "LINE_TOO_LONG")).withColumn("value", F.when(~long, F.col("value")))


def raw_of(lines: DataFrame, organization: str, vendor: tuple[str, str, str], release: str) -> DataFrame:
    """Raw rows of lines: the identity is that of the line's content, so a line that comes again, from a rotated copy or a second reader, is the same record."""
    c = F.lit
    return lines.select(
        I.stable_id("raw", "line-v1", F.col("line_id")).alias("raw_event_id"), c(organization).alias("organization_id"), c(vendor[0]).alias("vendor_name"), c(vendor[1]).alias("vendor_product"), c(vendor[2]).alias("vendor_dataset"),
        c(release).alias("release_id"), F.col("value").alias("payload"), F.col("error_code").alias("line_error"),
    )


def standardised(raw: DataFrame) -> DataFrame:
    """Standard events of raw rows; what the reader marked keeps its code."""
    x = N.standard_events(raw)
    return x.withColumn("error_code", F.coalesce("line_error", "error_code"))


def stored(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """All folders of a sink, with writer and batch; empty if there are none yet."""
    try:
        return spark.read.schema(schema).option("basePath", folder).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


_KEYS = "event_id string, hash string, day date, writer string, batch long"


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key that readers see: that of the least (writer, batch)."""
    rest = [c for c in rows.columns if c not in (key, "writer", "batch")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("writer", "batch")).alias("x"))
    return first.select(key, "x.*")


def write_batch(folder: str, writer: str):
    """A foreachBatch function for standardised rows: created events by domain and day, outcomes, quarantine."""

    def others(spark: SparkSession, name: str, schema: str, number: int) -> DataFrame:
        own = (F.col("writer") == writer) & (F.col("batch") == number)
        return stored(spark, f"{folder}/{name}", schema).where(~own)

    def put(df: DataFrame, name: str, number: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}/writer={writer}/batch={number}") if by else df.write.mode("overwrite").parquet(f"{folder}/{name}/writer={writer}/batch={number}")

    def write(batch: DataFrame, number: int) -> None:
        # what is written, and no more, is held
        spark, held = batch.sparkSession, batch.select("event_id", "domain", "error_code", *EVENT_COLUMNS).persist()
        try:
            good = held.where(F.col("error_code").isNull()).withColumn("ts", F.col("event_time")).select("event_id", "domain", "ts", *EVENT_COLUMNS)
            told = I.new_events(good, others(spark, "events", _KEYS, number).select("event_id", "hash", "day")).persist()
            # dealt by day: else each task writes a file for each day, and files grow as the product of both
            created = told.where("outcome_ = 'created'").drop("outcome_", "ts").repartitionByRange("domain", "day", "event_id")
            put(created, "events", number, "domain", "day")
            put(told.groupBy(F.col("outcome_").alias("outcome")).agg(F.count(F.lit(1)).alias("n")), "outcomes", number)
            told.unpersist()
            bad = I.to_quarantine(held).dropDuplicates(["quarantine_id"])
            there = others(spark, "quarantine", "quarantine_id string, writer string, batch long", number).select("quarantine_id")
            put(bad.join(there, "quarantine_id", "left_anti"), "quarantine", number)
        finally:
            held.unpersist()

    return write


def start(lines: DataFrame, folder: str, checkpoint: str, writer: str, organization: str, vendor: tuple[str, str, str], release: str = "r1", available_now: bool = False) -> StreamingQuery:
    """Reads lines, standardises them and writes both sinks below folder."""
    rows = standardised(raw_of(lines, organization, vendor, release))
    out = rows.writeStream.foreachBatch(write_batch(folder, writer)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def events(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """(event_id, day, hash, domain, raw_event_id, outcome, ...), or event_id and those columns: one row for each id."""
    schema = "event_id string, hash string, raw_event_id string, event_time timestamp, event_type string, outcome string, source_ip string, destination_ip string, transport string, bytes long, duration long, domain string, day date, writer string, batch long"
    return one_of_each(asked(stored(spark, f"{folder}/events", schema), "event_id", columns), "event_id")


def quarantine(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    schema = "quarantine_id string, raw_event_id string, stage string, code string, reason string, writer string, batch long"
    return one_of_each(asked(stored(spark, f"{folder}/quarantine", schema), "quarantine_id", columns), "quarantine_id")


def asked(rows: DataFrame, key: str, columns: list[str] | None) -> DataFrame:
    """Spark can't see through the choice of a row which of its columns are asked for."""
    return rows if columns is None else rows.select(key, *columns, "writer", "batch")


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/outcomes", "outcome string, n long, writer string, batch long").groupBy("outcome").agg(F.sum("n").alias("n"))
