"""Cases: overview, list, frozen snapshots, and feedback from verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_overview(cases: DataFrame, now: str) -> DataFrame:
    """One row: cases in progress, open ones without assignee, open critical ones, those closed on the day of now."""
    live = F.col("status") != "closed"
    today = F.date_trunc("day", F.lit(now).cast("timestamp"))
    return cases.agg(
        F.count_if(F.col("status") == "in_progress").alias("active"), F.count_if(live & F.col("assignee").isNull()).alias("unassigned"),
        F.count_if(live & (F.col("severity") == "critical")).alias("critical"), F.count_if(~live & (F.col("closed_at") >= today)).alias("closed_today"),
    )


def list_cases(cases: DataFrame, text: str | None = None, after: tuple | None = None, n: int = 50, **equal) -> DataFrame:
    """A page of cases, last updated first, by (updated_at, case_id); text is looked for in the title in any case."""
    for k, v in equal.items():
        cases = cases.where(F.col(k) == v)
    if text:
        cases = cases.where(F.contains(F.lower("title"), F.lit(text.lower())))
    if after:
        time = F.lit(after[0]).cast("timestamp")
        cases = cases.where((F.col("updated_at") < time) | ((F.col("updated_at") == time) & (F.col("case_id") < after[1])))
    return cases.orderBy(F.desc("updated_at"), F.desc("case_id")).limit(n)


def verdict_feedback(cases: DataFrame, links: DataFrame) -> DataFrame:
    """One feedback row for each case with a verdict, linked finding and type; of repeated ones the latest stands."""
    rows = cases.where("verdict is not null").join(links.select("case_id", "finding_id"), "case_id")
    return rows.groupBy("case_id", "finding_id", F.col("verdict").alias("feedback_type")).agg(F.max_by("reason", F.struct("at", "reason")).alias("reason"))


def case_snapshots(cases: DataFrame, findings: DataFrame, links: DataFrame) -> DataFrame:
    """Each case with the sorted sets of its findings and its links; empty if there are none."""
    some = lambda df, c, name: df.groupBy("case_id").agg(F.array_sort(F.collect_set(c)).alias(name))
    x = cases.join(some(findings, "finding_id", "findings"), "case_id", "left").join(some(links, "link", "links"), "case_id", "left")
    return x.withColumns({c: F.coalesce(c, F.array().cast(x.schema[c].dataType)) for c in ("findings", "links")})
