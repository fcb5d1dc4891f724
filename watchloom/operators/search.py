"""Bounded search operators over event tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUPS, MAX_ROWS, MAX_TOP = 10_000, 1000, 100


def scope(df: DataFrame, time: str, start: str, end: str, **equal) -> DataFrame:
    """Rows of a time range, both ends included, at most 31 days, with the given fields equal."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    length = datetime.fromisoformat(end) - datetime.fromisoformat(start)
    if not timedelta(0) <= length <= timedelta(days=31):
        raise ValueError("the range must be of 0 to 31 days")
    out = df.where(F.col(time).between(first, last))
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    return out


def fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns only."""
    return df.select(*names)


def sort(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Rows by keys (column, ascending), missing values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def head(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, 1 to 1000."""
    if not 1 <= n <= MAX_ROWS:
        raise ValueError("head takes 1 to 1000 rows")
    return df.limit(n)


def keyset(keys: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows after the cursor in the order of keys (column, ascending); no key may be missing."""
    test, same = F.lit(False), F.lit(True)
    for (c, up), v in zip(keys, cursor, strict=True):
        beyond = F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)
        test, same = test | (same & beyond), same & (F.col(c) == F.lit(v))
    return test


def with_quality_status(df: DataFrame, status: str, declared: tuple[str, ...] = ("qualified", "partial")) -> DataFrame:
    """Rows of a declared quality."""
    if status not in declared:
        raise ValueError(f"quality must be one of {', '.join(declared)}")
    return df.where(F.col("quality") == status)


def events_page(df: DataFrame, time: str, key: str, limit: int = 100, after: tuple | None = None) -> DataFrame:
    """Newest first, ties by key; after is the last row's (time, key) of the page before."""
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError("limit must be 1 to 1000")
    if after:
        t, k = F.lit(after[0]).cast("timestamp"), F.lit(after[1])
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) > k)))
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(limit)


def stats(df: DataFrame, *aggs: Column, by: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Aggregates over all rows or by fields; rows without a by-field are dropped, arrays count in each element."""
    for c in by:
        if dict(df.dtypes)[c].startswith("array"):
            df = df.withColumn(c, F.explode(c))
    out = df.dropna(subset=list(by)).groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return out.orderBy(*([order] if order else []), *by).limit(MAX_GROUPS) if by else out


def timechart(df: DataFrame, time: str, span: str, start: str, end: str, *aggs: Column) -> DataFrame:
    """One row for each epoch-aligned bucket of the range, empty ones too."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    cell = F.window(F.col(time), span)
    got = df.where(F.col(time).between(first, last)).groupBy(cell.start.alias("bucket")).agg(*aggs)
    ends = df.sparkSession.range(1).select(F.explode(F.array(first, last)).alias("t")).groupBy(F.window("t", span).start.alias("w")).count().agg(F.min("w").alias("a"), F.max("w").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {span}"))).alias("bucket")).join(got, "bucket", "left")


def timechart_by(df: DataFrame, time: str, span: str, field: str, most: int = 10) -> DataFrame:
    """The most frequent values of each bucket, ties by value."""
    n = df.where(F.col(field).isNotNull()).groupBy(F.window(time, span).start.alias("bucket"), field).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), F.asc(field)))
    return n.withColumn("rank", rank).where(F.col("rank") <= most)


def top(df: DataFrame, field: str, n: int = 10, rare: bool = False) -> DataFrame:
    """The n most (or least) frequent values, ties by value."""
    if not 1 <= n <= MAX_TOP:
        raise ValueError("n must be 1 to 100")
    counts = df.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.asc("n") if rare else F.desc("n"), F.asc(field)).limit(n)


def merge_findings(older: DataFrame, newer: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Two stores as one list: each finding once (the newest), retracted ones hidden, newest first."""
    both = older.unionByName(newer, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))
    live = both.withColumn("_n", last).where("_n = 1").drop("_n").where("status <> 'retracted'")
    return live.orderBy(F.desc(time), F.asc(key)).limit(n)


def evidence(findings: DataFrame, events: DataFrame, finding_id: str, n: int = 200) -> DataFrame:
    """A finding's events, oldest first, with a flag if there are more."""
    ids = findings.where(F.col("finding_id") == finding_id).select(F.explode("evidence").alias("event_id")).distinct()
    got = events.join(ids, "event_id").orderBy("ts", "event_id").limit(n + 1)
    count = F.count(F.lit(1)).over(Window.partitionBy())
    return got.withColumn("truncated", count > n).orderBy("ts", "event_id").limit(n)


def mask(df: DataFrame, fields: list[str], hidden: list[str] = ()) -> DataFrame:
    """Sensitive fields as [redacted] where there is a value; hidden ones dropped.  A dotted name is a field of a struct."""
    for f in fields:
        group, _, name = f.partition(".")
        if name:
            df = df.withColumn(group, F.when(F.col(group).isNotNull(), F.col(group).withField(name, F.when(F.col(f).isNotNull(), F.lit("[redacted]")))))
        else:
            df = df.withColumn(f, F.when(F.col(f).isNotNull(), F.lit("[redacted]")))
    return df.drop(*hidden)


def export_lines(df: DataFrame, order: list[str], rows: int, size: int, salts: int = 64) -> DataFrame:
    """NDJSON lines in order up to the row cap or the byte cap, whichever comes first, and which it was.

    Row numbers and byte offsets come from range partitions: sums of each partition,
    then a running sum inside, so no task sorts the whole export.
    """
    part = df.repartitionByRange(salts, *order).withColumn("line", F.to_json(F.struct(*df.columns))).withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    width = F.octet_length("line") + 1
    run = part.withColumn("n", F.count(F.lit(1)).over(inside)).withColumn("bytes", F.sum(width).over(inside))
    each = run.groupBy("part").agg(F.max("n").alias("pn"), F.max("bytes").alias("pb"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("b0"))
    out = run.join(F.broadcast(shift), "part").withColumn("n", F.col("n") + F.col("n0")).withColumn("bytes", F.col("bytes") + F.col("b0"))
    return out.where((F.col("n") <= rows) & (F.col("bytes") <= size)).select("n", "bytes", "line")


def findings_overview(findings: DataFrame) -> DataFrame:
    """Open findings, open ones of high or critical severity, and the latest time; one row, also of an empty table."""
    live = F.col("status") == "open"
    return findings.agg(F.count_if(live).alias("open"), F.count_if(live & F.col("severity").isin("high", "critical")).alias("open_high"), F.max("at").alias("latest"))


def list_findings(findings: DataFrame, limit: int = 100, **equal) -> DataFrame:
    """Newest first, ties by id, with the given fields equal."""
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError("limit must be 1 to 1000")
    for k, v in equal.items():
        findings = findings.where(F.col(k) == v)
    return findings.orderBy(F.desc("at"), F.asc("finding_id")).limit(limit)


def freshness(df: DataFrame, time: str, now: str, most: int = 300) -> DataFrame:
    """Seconds since the latest row; degraded beyond most, or if there is none."""
    age = F.lit(now).cast("timestamp").cast("long") - F.max(time).cast("timestamp").cast("long")
    return df.agg(age.alias("age")).withColumn("degraded", F.coalesce(F.col("age") > most, F.lit(True)))
