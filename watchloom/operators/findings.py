"""Finding documents with their mandatory parts, the older failure-then-success rule, and the business view of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.values import first_failing, iso_z, piped_id
from watchloom.operators.analysis import failure_then_success

# Fixed values of the older rule.
RULE_V1, VERSION_V1, WINDOW_V1, REASON_V1 = "auth.failure-then-success", "1.0.0", "30 minutes", "AUTH_FAILURE_BURST_THEN_SUCCESS"


def finding_documents(df: DataFrame, org: str, generation: str, rule: Column, version: Column, severity: Column, threshold: Column, values: Column, feature_version: Column, reasons: Column, summary: Column, model_version: Column | None = None) -> DataFrame:
    """Adds document (a struct) and violation, the code of the first mandatory part that it lacks (null if none).

    df(finding_id, entity_id, at, window_start, window_end, score, evidence).  threshold and
    values are maps, reasons an array.  Findings with a violation must not go out; the
    rows stay, so that they can be counted.
    """
    ids = F.array_sort(F.transform("evidence", lambda x: x.cast("string")))
    model = [] if model_version is None else [F.struct(model_version.alias("model_version")).alias("model")]
    detection = F.struct(rule.alias("rule_id"), version.alias("rule_version"), threshold.alias("threshold"), F.struct(iso_z(F.col("window_start")).alias("start"), iso_z(F.col("window_end")).alias("end")).alias("window"), *model)
    document = F.struct(
        iso_z(F.col("at")).alias("@timestamp"), F.struct(F.lit(org).alias("id")).alias("organization"), F.struct(F.col("entity_id").cast("string").alias("id"), F.lit("account").alias("type")).alias("entity"),
        F.struct(F.col("finding_id").alias("id"), rule.alias("type"), severity.alias("severity"), F.lit("open").alias("status"), F.col("score").cast("double").alias("score"), F.lit(generation).alias("generation")).alias("anomaly"),
        F.struct(ids.alias("event_ids"), F.size(ids).alias("count")).alias("evidence"), detection.alias("detection"), F.struct(feature_version.alias("feature_version"), values.alias("values")).alias("features"),
        F.struct(reasons.alias("reason_codes"), summary.alias("summary")).alias("explanation"),
    )
    told = lambda c: F.length(c) > 0
    some = lambda c: F.size(c) > 0
    rules = [
        (told(F.lit(generation)), "generation_missing"), (told(summary) & some(reasons), "explanation_missing"), (some(threshold), "threshold_missing"), (told(feature_version) & some(values), "features_missing"),
        (told(rule) & told(version), "rule_missing"), *([] if model_version is None else [(told(model_version), "model_missing")]), (some(ids), "evidence_missing"), (F.col("window_start").isNotNull() & F.col("window_end").isNotNull(), "window_missing"),
    ]
    return df.withColumn("document", document).withColumn("violation", first_failing(*rules))


def failure_then_success_v1(df: DataFrame, org: str, n: int, lookback: str) -> DataFrame:
    """The older rule: windows of 30 minutes, no generation in the id, score 1; evidence in the order of the ids' text.

    Rows without entity are left out; eligibility is that of ``eligible``.
    """
    x = failure_then_success(df.where("entity_id is not null and cast(entity_id as string) <> ''"), n, lookback, WINDOW_V1)
    key = [F.lit(org), F.col("entity_id").cast("string"), iso_z(F.col("window_start")), F.lit(f"{RULE_V1}@{VERSION_V1}")]
    summary = F.concat(F.col("failures").cast("string"), F.lit(" failed logins followed by a successful login within 30 minutes"))
    return x.withColumn("evidence", F.array_sort(F.transform("evidence", lambda e: e.cast("string")))).withColumn("score", F.lit(1.0)).withColumn("finding_id", piped_id("anom", *key)).withColumn("reason_code", F.lit(REASON_V1)).withColumn("summary", summary)


def business_view(results: DataFrame) -> DataFrame:
    """Results without what differs from run to run: identity, rule and the document without its analysis part."""
    return results.select("result_id", "rule_id", "rule_version", F.col("document").dropFields("analysis").alias("document"))
