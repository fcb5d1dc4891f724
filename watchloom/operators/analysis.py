"""Window features, baselines, detection, revisions, risk and feedback.

Events come as (event_id, ts, entity_id, outcome, host_id, source_ip).  All windows
are epoch aligned; every shuffle is by entity, finding key or record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.values import business_key, iso_offset, iso_z, piped_id

FEATURES = ("attempts", "failures", "failure_rate", "distinct_devices", "distinct_ips", "failure_then_success")


def auth_features(df: DataFrame, size: str, by: str = "entity_id") -> DataFrame:
    """Six features and the sorted input ids for each (entity, tumbling window)."""
    w = F.window("ts", size)
    x = df.withColumn("window_start", w.start).withColumn("window_end", w.end)
    told = F.col("outcome").isin("failure", "success")
    # outcomes other than these two are skipped: the last told one before a success decides
    before = F.last(F.when(told, F.col("outcome")), ignorenulls=True).over(Window.partitionBy(by, "window_start").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("turn", F.coalesce((F.col("outcome") == "success") & (before == "failure"), F.lit(False)))
    n, bad = F.count(F.lit(1)), F.count_if(F.col("outcome") == "failure")
    return x.groupBy(by, "window_start", "window_end").agg(
        n.alias("attempts"), bad.alias("failures"), (bad / n).alias("failure_rate"),
        F.countDistinct(F.nullif("host_id", F.lit(""))).alias("distinct_devices"), F.countDistinct(F.nullif("source_ip", F.lit(""))).alias("distinct_ips"),
        F.count_if("turn").alias("failure_then_success"), F.array_sort(F.collect_list("event_id")).alias("inputs"),
    )


def split_future(df: DataFrame, received: str, limit: str = "5 minutes") -> DataFrame:
    """Adds future: the event is later than its receipt by more than the limit."""
    return df.withColumn("future", F.col("ts") > F.col(received) + F.expr(f"interval {limit}"))


def with_running_max(df: DataFrame, name: str, value: Column, arrival: str, by: str, block_rows: int = 200_000) -> DataFrame:
    """df with the largest value of the rows of the same entity that arrived before, by a scan in two levels.

    The span of arrivals is cut into equal blocks, one for about ``block_rows`` rows: maxima of
    (entity, block) are few and scanned by entity, rows are sorted within (entity, block)
    only, so an entity with very many rows is no one task's sort.
    """
    spot = F.col(arrival).cast("double")
    low, high, n = df.agg(F.min(spot), F.max(spot), F.count(F.lit(1))).first()
    blocks = max(1, -(-n // block_rows))
    width = ((high - low) / blocks or 1.0) if low is not None else 1.0
    x = df.withColumn("_block", F.floor((spot - F.lit(low or 0.0)) / F.lit(width))).withColumn("_value", value)
    tops = x.groupBy(F.col(by).alias("_by"), F.col("_block").alias("_at")).agg(F.max("_value").alias("_top"))
    before = tops.withColumn("_before", F.max("_top").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    y = x.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
    inside = F.max("_value").over(Window.partitionBy(by, "_block").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return y.withColumn(name, F.greatest("_before", inside)).drop("_block", "_value", "_by", "_at", "_before")


def with_entity_watermark(df: DataFrame, arrival: str, lateness: str = "10 minutes", by: str = "entity_id") -> DataFrame:
    """The entity's watermark before each arrival (running maximum less the lateness) and whether the row is late."""
    x = with_running_max(df, "_newest", F.col("ts"), arrival, by)
    x = x.withColumn("watermark", F.col("_newest") - F.expr(f"interval {lateness}")).drop("_newest")
    return x.withColumn("late", F.coalesce(F.col("ts") < F.col("watermark"), F.lit(False)))


def split_retention(df: DataFrame, keep: str, by: str = "entity_id") -> DataFrame:
    """Adds backfill: the row is older than the entity's latest event less what is kept."""
    last = df.groupBy(by).agg(F.max("ts").alias("_last"))
    return df.join(last, by, "left").withColumn("backfill", F.col("ts") < F.col("_last") - F.expr(f"interval {keep}")).drop("_last")


def closed_windows(features: DataFrame, watermark: Column) -> DataFrame:
    return features.where(F.col("window_end") <= watermark)


def revise_windows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New windows at revision 1, changed ones at the next revision; unchanged ones give no row."""
    o = old.select(*key, F.col("revision").alias("r0"), F.col("hash").alias("h0"))
    x = new.join(o, key, "left").where(F.col("h0").isNull() | (F.col("h0") != F.col("hash")))
    return x.withColumn("revision", F.coalesce("r0", F.lit(0)) + 1).drop("r0", "h0")


# --- baselines


def select_samples(df: DataFrame, deadline: str) -> DataFrame:
    """Qualified samples that ended by the deadline, the latest revision of each (entity, window)."""
    ok = df.where((F.col("quality") == "qualified") & (F.col("window_end") <= F.lit(deadline).cast("timestamp")))
    last = F.row_number().over(Window.partitionBy("entity_id", "window_start").orderBy(F.desc("revision")))
    return ok.withColumn("_n", last).where("_n = 1").drop("_n")


def training_decision(samples: DataFrame, deadline: str, least: int = 100, days: int = 14) -> DataFrame:
    """One row: samples, complete days, whether to train and why not; samples are checked first."""
    day = F.to_date("window_start")
    complete = F.countDistinct(F.when(F.date_add(day, 1) <= F.lit(deadline).cast("timestamp"), day))
    x = samples.agg(F.count(F.lit(1)).alias("samples"), complete.alias("days"))
    why = F.when(F.col("samples") < least, "insufficient_samples").when(F.col("days") < days, "insufficient_days").otherwise("ready")
    return x.withColumn("reason", why).withColumn("train", why == "ready")


def unpivoted(df: DataFrame, *keys: str) -> DataFrame:
    pairs = ", ".join(f"'{f}', cast({f} as double)" for f in FEATURES)
    return df.select(*keys, F.expr(f"stack({len(FEATURES)}, {pairs}) as (feature, x)"))


def train(samples: DataFrame, *by: str) -> DataFrame:
    """Count, mean, population deviation, minimum and maximum of each feature, overall or by group."""
    return unpivoted(samples, *by).groupBy(*by, "feature").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Absolute z; without variance equal values are 0 and others infinite."""
    return F.when(std == 0, F.when(x == mean, 0.0).otherwise(float("inf"))).otherwise(F.abs(x - mean) / std)


def evaluate_baseline(model: DataFrame, samples: DataFrame) -> DataFrame:
    """In-sample check: largest z and share within three deviations.  The model has a row for each feature."""
    z = z_score(F.col("x"), F.col("mean"), F.col("std"))
    return unpivoted(samples).join(F.broadcast(model), "feature").groupBy("feature").agg(F.max(z).alias("max_z"), F.avg((z <= 3).cast("double")).alias("within"))


# --- detection


def failure_then_success(df: DataFrame, n: int, lookback: str, size: str) -> DataFrame:
    """The first success of each (entity, window) with n failures in the lookback before it, in (ts, id) order.

    The failures are counted first; they are fetched as evidence only for the
    successes that are findings.
    """
    at = F.col("ts").cast("timestamp").cast("double")
    failed = F.when(F.col("outcome") == "failure", 1)
    ranged = Window.partitionBy("entity_id").orderBy(at).rangeBetween(-_seconds(lookback), 0)
    # a range holds all failures of the row's own time, those with a greater id too
    after = Window.partitionBy("entity_id", at).orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    x = df.where(F.col("outcome").isin("failure", "success"))
    x = x.withColumn("failures", F.count(failed).over(ranged) - F.count(failed).over(after)).where(F.col("outcome") == "success").where(F.col("failures") >= n)
    x = x.withColumn("window_start", F.window("ts", size).start)
    first = F.row_number().over(Window.partitionBy("entity_id", "window_start").orderBy("ts", "event_id"))
    found = x.withColumn("_n", first).where("_n = 1").select("entity_id", "window_start", F.col("ts").alias("at"), "event_id", "failures")
    # a lookback touches two blocks of its own length, so a finding meets the failures of these and not all of its entity
    block = lambda t: F.floor(t.cast("timestamp").cast("double") / _seconds(lookback)).cast("long")
    found = found.withColumn("_block", F.explode(F.array(block(F.col("at")) - 1, block(F.col("at")))))
    bad = df.where("outcome = 'failure'").select("entity_id", "ts", F.col("event_id").alias("bad_id"), block(F.col("ts")).alias("_block"))
    before = (F.col("ts") < F.col("at")) | ((F.col("ts") == F.col("at")) & (F.col("bad_id") < F.col("event_id")))
    within = at >= F.col("at").cast("timestamp").cast("double") - _seconds(lookback)
    near = found.join(bad, ["entity_id", "_block"]).where(before & within).groupBy("entity_id", "window_start", "at", "event_id", "failures").agg(F.array_sort(F.collect_list(F.struct("ts", "bad_id"))).alias("_bad"))
    evidence = F.concat(F.transform("_bad", lambda f: f["bad_id"]), F.array("event_id"))
    return near.select("entity_id", "window_start", "at", "failures", evidence.alias("evidence"))


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def failure_burst(df: DataFrame, n: int, size: str) -> DataFrame:
    """Windows of n failures or more of one entity; the finding's time is the window's end."""
    w = F.window("ts", size)
    got = df.where("outcome = 'failure'").groupBy("entity_id", w.alias("w")).agg(F.count(F.lit(1)).alias("failures"), F.array_sort(F.collect_list("event_id")).alias("evidence")).where(F.col("failures") >= n)
    return got.select("entity_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("at"), "failures", "evidence")


def baseline_deviation(records: DataFrame, model: DataFrame, z: float = 3.0) -> DataFrame:
    """Records that deviate in any feature; score min(1, worst / 2z), 1 if infinite."""
    each = z_score(F.col("x"), F.col("mean"), F.col("std"))
    x = unpivoted(records, "entity_id", "window_start").join(F.broadcast(model.select("feature", "mean", "std")), "feature").withColumn("z", each)
    got = x.groupBy("entity_id", "window_start").agg(F.max("z").alias("worst"), F.array_sort(F.collect_list(F.when(F.col("z") >= z, F.col("feature")))).alias("deviating")).where(F.col("worst") >= z)
    return got.withColumn("score", F.least(F.lit(1.0), F.when(F.col("worst") == float("inf"), 1.0).otherwise(F.col("worst") / (2 * z))))


def to_findings(df: DataFrame, org: str, rule: str, generation: str, score: Column) -> DataFrame:
    """Findings with identity and business key."""
    parts = [F.lit(org), F.lit(rule), F.col("entity_id").cast("string"), iso_offset(F.col("window_start")), F.lit(generation)]
    key = business_key(F.lit(org), F.lit(rule), F.col("entity_id").cast("string"), iso_z(F.col("window_start")), F.lit(generation))
    return df.withColumn("rule_id", F.lit(rule)).withColumn("score", score.cast("double")).withColumn("finding_id", piped_id("anom", *parts)).withColumn("business_key", key)


# --- revisions and risk


def recompute(current: DataFrame, verdicts: DataFrame, at: str) -> DataFrame:
    """New frames: changed verdicts at revision + 1, vanished ones retracted; unchanged and already retracted give none."""
    c = current.select("business_key", F.col("revision").alias("r0"), F.col("hash").alias("h0"), F.col("operation").alias("op0"), F.col("entity_id").alias("e0"), F.col("score").alias("s0"))
    x = verdicts.join(c, "business_key", "full_outer")
    gone = F.col("hash").isNull()
    changed = ~gone & (F.col("r0").isNull() | (F.col("h0") != F.col("hash")) | (F.col("op0") == "retracted"))
    x = x.where(changed | (gone & (F.col("op0") == "upsert")))
    return x.select("business_key", F.coalesce("entity_id", "e0").alias("entity_id"), (F.coalesce("r0", F.lit(0)) + 1).cast("int").alias("revision"), F.when(gone, "retracted").otherwise("upsert").alias("operation"), F.coalesce("hash", "h0").alias("hash"), F.coalesce("score", "s0").alias("score"), F.lit(at).cast("timestamp").alias("at"))


def current_view(history: DataFrame, alerts_only: bool = False) -> DataFrame:
    """The highest revision of each key; alerts are those not retracted."""
    cols = [c for c in history.columns if c != "business_key"]
    out = history.groupBy("business_key").agg(F.max_by(F.struct(*cols), "revision").alias("x")).select("business_key", "x.*")
    return out.where("operation = 'upsert'") if alerts_only else out


def risk_contributions(frames: DataFrame) -> DataFrame:
    """Change of the live amount by each frame, its kind, and whether its revision follows the one before."""
    w = Window.partitionBy("business_key").orderBy("revision")
    live = F.when(F.col("operation") == "upsert", F.col("score")).otherwise(0.0)
    x = frames.withColumn("live", live).withColumn("amount", F.col("live") - F.coalesce(F.lag("live").over(w), F.lit(0.0)))
    kind = F.when(F.col("operation") == "retracted", "reversal").when(F.col("revision") == 1, "positive").otherwise("compensation")
    return x.withColumn("kind", kind).withColumn("in_order", F.col("revision") - F.coalesce(F.lag("revision").over(w), F.lit(0)) == 1)


def entity_risk(contributions: DataFrame, at: str, half_days: float = 7.0, zero_days: float = 30.0) -> DataFrame:
    """Decayed risk of each entity at a time: halved every half_days, nothing beyond zero_days, never below 0.

    A contribution that lies after the time is an error.
    """
    age = (F.lit(at).cast("timestamp").cast("double") - F.col("at").cast("timestamp").cast("double")) / 86400
    part = F.when(age < 0, F.raise_error(F.lit("a contribution lies after the time of risk"))).when(age > zero_days, 0.0).otherwise(F.col("amount") * F.pow(F.lit(0.5), age / half_days))
    return contributions.groupBy("entity_id").agg(F.greatest(F.lit(0.0), F.sum(part)).alias("risk"), F.count(F.lit(1)).alias("contributions"))


# --- feedback


def feedback_metrics(df: DataFrame) -> DataFrame:
    """True and false positives, false negatives, inconclusive ones and precision by rule."""
    n = {k: F.count_if(F.col("feedback_type") == v) for k, v in (("tp", "true_positive"), ("fp", "false_positive"), ("fn", "false_negative"), ("inconclusive", "inconclusive"))}
    told = n["tp"] + n["fp"]
    return df.groupBy(F.coalesce("rule_id", F.lit("")).alias("rule_id")).agg(*[c.alias(k) for k, c in n.items()], F.when(told > 0, n["tp"] / told).otherwise(0.0).alias("precision"))


def finding_labels(df: DataFrame) -> DataFrame:
    """The last feedback of each finding is its label; false negatives label nothing."""
    return df.where("feedback_type <> 'false_negative'").groupBy("finding_id").agg(F.max_by("feedback_type", F.struct("created_at", "id")).alias("label"))


def auto_cases(findings: DataFrame, policy: str = "default") -> DataFrame:
    """One case for each (entity, policy, UTC hour); its findings accumulate."""
    return findings.groupBy("entity_id", F.date_trunc("hour", "at").alias("hour")).agg(F.array_sort(F.collect_set("finding_id")).alias("findings"), F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at")).withColumn("policy", F.lit(policy))


def evaluate_scenario(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Hits, false alarms and misses, precision and recall (1 on nothing)."""
    a, e = actual.select(key).distinct().withColumn("a", F.lit(1)), expected.select(key).distinct().withColumn("e", F.lit(1))
    x = a.join(e, key, "full_outer").agg(F.count_if(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("a").isNull()).alias("fn"))
    share = lambda d: F.when(F.col("tp") + F.col(d) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(d)))
    return x.withColumn("precision", share("fp")).withColumn("recall", share("fn"))


def all_true(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)


# --- eligibility, model lineages, generations, evaluation view


def eligible(df: DataFrame, org: str) -> DataFrame:
    """Qualified and partial events, the first row of each event id by time; a row of another tenant is an error."""
    own = F.when(F.col("org").eqNullSafe(F.lit(org)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("event of another tenant: "), F.coalesce("org", F.lit("none")))).cast("boolean"))
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("ts", F.xxhash64(*df.columns)))
    return df.where(own).where(F.col("quality").isin("qualified", "partial")).withColumn("_n", first).where("_n = 1").drop("_n")


def sample_range(samples: DataFrame) -> DataFrame:
    """First start, last end and the number of entities; the entities themselves stay a table (their list grows with the data)."""
    return samples.agg(F.min("window_start").alias("first_start"), F.max("window_end").alias("last_end"), F.countDistinct("entity_id").alias("entities"))


def latest_models(models: DataFrame, lineage: list[str]) -> DataFrame:
    """The newest version of each lineage, ties by version."""
    cols = [c for c in models.columns if c not in lineage]
    return models.groupBy(*lineage).agg(F.max_by(F.struct(*cols), F.struct("created_at", "version")).alias("x")).select(*lineage, "x.*")


def retract(current: DataFrame, keys: DataFrame, reason: str, at: str) -> DataFrame:
    """Retractions at the next revision of the live keys that are given; unknown and already retracted ones give none."""
    live = current.where("operation = 'upsert'").join(keys.select("business_key").distinct(), "business_key", "left_semi")
    return live.withColumn("revision", F.col("revision") + 1).withColumn("operation", F.lit("retracted")).withColumn("reason", F.lit(reason)).withColumn("at", F.lit(at).cast("timestamp"))


def switch_generation(current: DataFrame, rule: str, old: str, at: str) -> DataFrame:
    """Every live key of a rule's old generation is retracted."""
    part = F.split("business_key", r"\|")
    keys = current.where((part[1] == rule) & (F.element_at(part, -1) == old))
    return retract(current, keys, "generation_switched", at)


def feedback_evaluation(feedback: DataFrame, labels: DataFrame, cases: DataFrame) -> DataFrame:
    """Feedback with its finding's label and the case of its target, else of its source."""
    f = feedback.join(labels, "finding_id", "left").withColumn("_case", F.coalesce("target_case", "source_case"))
    return f.join(cases.select(F.col("case_id").alias("_case"), F.col("status").alias("case_status")), "_case", "left").withColumnRenamed("_case", "case_id")
