"""Raw envelopes, normalisation of vendor payloads, quarantine, retention and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.values import first_failing, piped_id, stable_id
from watchloom.sources.canonical import canonical_payload, with_payload_hash  # noqa: F401  # with_payload_hash is part of this module's interface
from watchloom.sources.standard import PAYLOAD, WINDOWS_EVENTS, normalize_sensor, quality_of, text


def read_raw(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed envelope and error_code: a line that is no JSON object of the schema is marked, never an abort."""
    x = lines.withColumn("raw", F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return x.withColumn("error_code", F.when(F.col("raw").isNull() | F.col("raw._bad").isNotNull(), "JSON_INVALID"))


def read_log_files(spark, path: str, most: int = 1 << 20) -> DataFrame:
    """NDJSON lines of a glob with their file; lines over the cap are marked."""
    x = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return x.withColumn("error_code", F.when(F.octet_length("value") > most, "LINE_TOO_LONG"))


def sensor_rows(df: DataFrame, kind: str, j: str) -> DataFrame:
    """Payloads of one sensor data set as standard events; see standard.normalize_sensor."""
    # the names of a standard event are the normaliser's, those of df come back after it
    x = df.select(F.struct(*df.columns).alias("_own"), F.col(j)).withColumn("body", F.from_json(j, PAYLOAD, {"columnNameOfCorruptRecord": "_bad"})).withColumn("error_code", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    return normalize_sensor(x.withColumn("raw_event_id", none).withColumn("release_id", none).withColumn("vendor_dataset", F.lit(f"zeek.{kind}")))


def normalize_conn(df: DataFrame, j: str = "payload") -> DataFrame:
    """Network connections: endpoints, transport, duration in ns, bytes and packets as sums of whole numbers."""
    return sensor_rows(df, "conn", j).select("_own.*", "event_time", "source_ip", "destination_ip", "source_port", "destination_port", "transport", "protocol", "duration", "bytes", "packets", "outcome", "error_code")


def normalize_dns(df: DataFrame, j: str = "payload") -> DataFrame:
    return sensor_rows(df, "dns", j).select("_own.*", F.col("name").alias("question"), "response_code", "outcome", "error_code")


def normalize_http(df: DataFrame, j: str = "payload") -> DataFrame:
    return sensor_rows(df, "http", j).select("_own.*", F.col("name").alias("domain"), "path", "method", "status_code", "outcome", "error_code")


def normalize_tls(df: DataFrame, j: str = "payload") -> DataFrame:
    return sensor_rows(df, "ssl", j).select("_own.*", F.col("name").alias("server_name"), "version", "cipher", "outcome", "error_code")


def join_windows_semantics(df: DataFrame, code: str = "code", status: str = "status") -> DataFrame:
    """Domain, action and outcome by event id; Kerberos and NTLM outcomes come from the status.  The table is fixed, so it is sent to the tasks."""
    table = df.sparkSession.createDataFrame([(e[0], e[1], e[3], e[4]) for e in WINDOWS_EVENTS], f"{code} string, domain string, action string, outcome string")
    x = df.join(F.broadcast(table), code, "left")
    told = F.when(F.col(status).isin("0x0", "0"), "success").otherwise("failure")
    return x.withColumn("outcome", F.when(F.col(code).isin("4768", "4769", "4776"), told).otherwise(F.col("outcome"))).withColumn("error_code", F.when(F.col("domain").isNull(), "EVENT_UNSUPPORTED"))


def with_quality(df: DataFrame, warnings: list[tuple[Column, str]], domain: Column) -> DataFrame:
    """df with quality, reasons and usable_for: partial if there is a warning, else qualified; see standard.quality_of."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in warnings]), lambda x: x.isNotNull())
    x = df.withColumn("_q", quality_of(reasons, domain))
    return x.withColumn("reasons", F.col("_q.reasons")).withColumn("quality", F.col("_q.status")).withColumn("usable_for", F.col("_q.usable_for")).drop("_q")


def to_quarantine(df: DataFrame, reason: str = "error_code", key: str = "raw_event_id") -> DataFrame:
    """Identity, stage, code (text before the colon, 64 characters) and reason (512)."""
    code = F.left(F.upper(F.replace(F.trim(F.split(F.col(reason), ":")[0]), F.lit(" "), F.lit("_"))), F.lit(64))
    stage = F.when(code.startswith("UIM_"), "UIM").otherwise("DIP")
    return df.where(F.col(reason).isNotNull()).select(piped_id("quar", F.lit("quarantine-v1"), F.col(key).cast("string"), code).alias("quarantine_id"), F.col(key), stage.alias("stage"), code.alias("code"), F.left(F.col(reason), F.lit(512)).alias("reason"))


def rule_hits(rules: list[dict]) -> Column:
    """Id of the first rule whose equalities all hold; protected rules win over all others."""
    ordered = sorted(rules, key=lambda r: not r.get("protected", False))
    hit = lambda r: reduce(lambda a, b: a & b, [F.coalesce(F.col(k).cast("string") == str(v), F.lit(False)) for k, v in r["equal"].items()])
    return F.coalesce(*[F.when(hit(r), F.lit(r["id"])) for r in ordered])


def shadow_counts(df: DataFrame, rules: list[dict]) -> DataFrame:
    """What an admission policy would drop: counts only, nothing is dropped."""
    kept = {r["id"] for r in rules if r.get("protected")}
    x = df.withColumn("rule", F.coalesce(rule_hits(rules), F.lit("none")))
    return x.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).withColumn("would_drop", ~F.col("rule").isin(*kept, "none"))


def drop_filter(df: DataFrame, equal: dict, mode: str = "drop") -> DataFrame:
    """Shipper filter: any equality matches; only mode drop removes rows."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(k) == v, F.lit(False)) for k, v in equal.items()])
    return df.where(~hit) if mode == "drop" else df.withColumn("matched", hit) if mode == "shadow" else df


def expired_partitions(parts: DataFrame, day: str, today: str, days: int = 7) -> DataFrame:
    return parts.select(day).distinct().where(F.col(day) < F.date_sub(F.lit(today).cast("date"), days - 1))


def retention_gaps(committed: DataFrame, earliest: DataFrame) -> DataFrame:
    """Partitions whose reader is behind the earliest offset: rows that are lost."""
    return committed.join(earliest, ["topic", "partition"]).where("committed < earliest").withColumn("lost", F.col("earliest") - F.col("committed"))


def dedup_inbox(df: DataFrame, order: str) -> DataFrame:
    """The first row of each message of a consumer group."""
    w = Window.partitionBy("consumer_group", "message_id").orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prunable(jobs: DataFrame, links: DataFrame, held: DataFrame, now: str, days: dict[str, int]) -> DataFrame:
    """Jobs older than their outcome's age that no held case refers to."""
    age = reduce(lambda w, kv: w.when(F.col("outcome") == kv[0], kv[1]), list(days.items())[1:], F.when(F.col("outcome") == next(iter(days)), next(iter(days.values()))))
    old = jobs.where(F.col("ended").cast("timestamp") < F.lit(now).cast("timestamp") - F.make_interval(days=age))
    return old.join(links.join(held, "case_id").select("job_id").distinct(), "job_id", "left_anti")


def new_events(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """df(event_id, domain, ts, ...) with day and outcome: created, duplicate (same content) or conflict (another content under the id).

    Against stored events of the same days only; of several rows with one id the first by content is created.
    """
    names = sorted(c for c in df.columns if c != "event_id")
    x = df.withColumn("day", F.to_date("ts")).withColumn("hash", F.sha2(F.to_json(F.struct(*names)), 256))
    first = F.first("hash").over(Window.partitionBy("event_id").orderBy("hash"))
    x = x.withColumn("_own", first).withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("hash")))
    if stored is not None:
        days = x.select("day").distinct()
        there = stored.join(F.broadcast(days), "day", "left_semi").select("event_id", F.col("hash").alias("_there"))
        x = x.join(there, "event_id", "left")
    else:
        x = x.withColumn("_there", F.lit(None).cast("string"))
    outcome = F.when(F.col("hash") != F.coalesce("_there", "_own"), "conflict").when(F.col("_there").isNotNull() | (F.col("_n") > 1), "duplicate").otherwise("created")
    return x.withColumn("outcome_", outcome).drop("_own", "_n", "_there")


def write_events(df: DataFrame, path: str) -> None:
    """New events only, by domain and UTC day; what is there already stays.  One writer at a time."""
    from pyspark.errors import AnalysisException

    try:
        stored = df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    new_events(df, stored).where("outcome_ = 'created'").drop("outcome_").write.mode("append").partitionBy("domain", "day").parquet(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Quarantine rows by UTC day; a row whose identity is there already stays as it is."""
    from pyspark.errors import AnalysisException

    new = df.dropDuplicates(["quarantine_id"]).withColumn("day", F.to_date("occurred_at"))
    try:
        new = new.join(df.sparkSession.read.parquet(path).select("quarantine_id"), "quarantine_id", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new.write.mode("append").partitionBy("day").parquet(path)


def to_dead_letters(df: DataFrame, stage: str, code: str, reason: str) -> DataFrame:
    """References to rows(topic, partition, offset, key, value, object_id, ...) that failed: coordinates and digest, never the payload."""
    return df.select(
        F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("letter_key"), F.lit("1.0.0").alias("contract_version"), F.struct("topic", "partition", "offset", "key").alias("source"),
        F.struct(F.lit(stage).alias("stage"), F.col(code).alias("code"), F.left(F.col(reason), F.lit(512)).alias("message"), F.lit(False).alias("retryable")).alias("failure"), F.col("object_id"), F.sha2(F.col("value").cast("binary"), 256).alias("payload_hash"),
    )


def validate_shipped(df: DataFrame, j: str = "value", most: int = 1 << 20) -> DataFrame:
    """df with error_code: the first admission rule that a shipped event breaks."""
    at = F.from_json(j, "_bad string, `@timestamp` string, agent struct<type:string,version:string,id:string>, event struct<dataset:string>", {"columnNameOfCorruptRecord": "_bad"})
    x = df.withColumn("_e", at)
    size = lambda c, n: F.octet_length(c).between(1, n)
    agent = F.col("_e.agent")
    stamp = F.when(F.col("_e.`@timestamp`").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp("_e.`@timestamp`"))
    code = first_failing(
        (size(F.col(j), most), "EVENT_SIZE"), (F.col("_e").isNotNull() & F.col("_e._bad").isNull() & F.ltrim(j).startswith("{"), "EVENT_JSON_INVALID"), (stamp.isNotNull(), "EVENT_TIMESTAMP_INVALID"),
        (agent["type"].isin("filebeat", "winlogbeat") & size(agent["version"], 64) & size(agent["id"], 128), "EVENT_AGENT_REQUIRED"), (size(F.col("_e.event.dataset"), 128), "EVENT_DATASET_REQUIRED"),
    )
    return x.withColumn("error_code", code).drop("_e")


def with_source_position(df: DataFrame, j: str = "payload", delivery: str = "delivery_position") -> DataFrame:
    """df with source_position: of a Windows record, else of a file by fingerprint or by device and inode, else where it was delivered."""
    x = df.withColumn("_e", F.from_json(j, "`@timestamp` string, winlog struct<computer_name:string,channel:string,record_id:string>, log struct<offset:string,file:struct<device_id:string,inode:string,fingerprint:string>>"))
    win, log = F.col("_e.winlog"), F.col("_e.log")
    host, channel, record = text(win["computer_name"]), text(win["channel"]), win["record_id"]
    stamp = F.when(F.col("_e.`@timestamp`").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp("_e.`@timestamp`"))
    # whole seconds carry no fraction
    printed = F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(stamp, ".SSSSSS"), "[.]?0*$", ""), F.lit("Z"))
    hexed = lambda c: F.lower(F.hex(F.lower(c)))
    fits = record.rlike(r"^\d+$") & stamp.isNotNull() & ~F.concat(host, channel).rlike(r"[\r\n]")
    windows = F.when(fits, F.concat_ws(":", F.lit("winlogbeat-v1"), hexed(host), hexed(channel), record, printed))
    device, inode, mark = text(log["file"]["device_id"]), text(log["file"]["inode"]), text(log["file"]["fingerprint"])
    plain = lambda c: ~c.rlike(r"[:\r\n]")
    cursor = F.when(log["offset"].rlike(r"^\d+$") & plain(F.concat(device, inode)), F.when(plain(mark), F.concat_ws(":", F.lit("filebeat-v2"), mark, log["offset"])).otherwise(F.concat_ws(":", F.lit("filebeat-v1"), device, inode, log["offset"])))
    return x.withColumn("source_position", F.coalesce(F.when(win.isNotNull(), windows).otherwise(cursor), F.col(delivery))).drop("_e")


def validate_envelopes(df: DataFrame, organization: str, namespace: str) -> DataFrame:
    """df with error_code: scope, lineage limits, payload, recomputed identity and payload hash of a raw envelope."""
    short = lambda c, n, least=1: F.octet_length(F.coalesce(F.col(c), F.lit(""))).between(least, n)
    lineage = short("source_instance_id", 128) & F.col("source_context_id").rlike("^ctx_[0-9a-f]{32}$") & short("source_position", 512) & short("delivery_position", 512, 0) & short("source_epoch", 128) & short("vendor_name", 128)
    lineage = lineage & short("vendor_product", 128) & short("vendor_dataset", 128) & short("release_id", 128) & F.col("received_at").isNotNull()
    wanted = stable_id("raw", "raw-v1", *[F.col(c) for c in ("organization_id", "source_instance_id", "vendor_dataset", "source_epoch", "source_position")])
    x = df.withColumnRenamed("payload_hash", "_claimed").withColumn("_form", canonical_payload(F.col("payload"))).withColumn("payload_hash", F.col("_form.digest"))
    # an envelope's payload is an object, though other values have a digest
    whole_object = F.col("_form.canonical").startswith("{")
    code = first_failing(
        ((F.col("schema_version") == "1.0.0") & (F.col("organization_id") == organization) & (F.col("namespace") == namespace), "ENVELOPE_SCOPE_MISMATCH"),
        (F.col("organization_id").rlike("^[A-Za-z0-9_-]{1,64}$") & F.col("namespace").rlike("^[A-Za-z0-9_-]{1,64}$") & lineage, "ENVELOPE_LINEAGE_INVALID"), (short("payload", 1 << 20) & F.coalesce(whole_object, F.lit(False)) & (F.col("encoding") == "json"), "ENVELOPE_PAYLOAD_INVALID"),
        (F.col("raw_event_id") == wanted, "ENVELOPE_ID_MISMATCH"), (F.col("_claimed") == F.col("payload_hash"), "ENVELOPE_HASH_MISMATCH"),
    )
    return x.withColumn("error_code", code).drop("payload_hash", "_form").withColumnRenamed("_claimed", "payload_hash")


def prune_receipts(df: DataFrame, time: str, now: str, days: int = 2) -> DataFrame:
    """Receipts that stay: the cutoff is fixed once, by the given time and not by each task's clock."""
    return df.where(F.col(time) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
