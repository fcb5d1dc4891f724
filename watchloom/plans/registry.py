"""All registered queries of the analytics library and the SQL that says the same.

The driver's tables stand in for security data: users of ``events`` are entities,
errors are failures and purchases successes; holders of parts over time come from
``lineitem``, relations and probes from ``orders``, feedback from ``labels``.
Doubles are rounded to six digits on both sides, times are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import analysis as A
from watchloom.operators import attribution as R
from watchloom.operators import entities as E
from watchloom.operators import merge as M
from watchloom.operators import search as S
from watchloom.sources import ingest as I
from watchloom.streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "events"))


def shaped(raw: DataFrame) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success").otherwise("unknown")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity_id"), outcome.alias("outcome"), "event_type", "value", "props",
        F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")).alias("host_id"), F.concat(F.lit("10.0.0."), (F.col("event_id") % 11).cast("string")).alias("source_ip"),
    )


def r6(c):
    return F.round(c, 6)


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


EV = """ev AS (SELECT event_id, ts, user_id AS entity_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' ELSE 'unknown' END AS outcome,
 event_type, value, props, 'd' || (event_id % 7) AS host_id, '10.0.0.' || (event_id % 11) AS source_ip FROM events)"""
T = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# --- search


@query(f"SELECT event_id, user_id, event_type, {T.format('ts')} AS ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND event_type = 'error'")
def q01_scope(spark, sf_dir):
    x = S.scope(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2024-01-05", "2024-01-12", event_type="error")
    return x.select("event_id", "user_id", "event_type", V.text_time(F.col("ts")).alias("ts"))


@query("SELECT event_type, count(*) AS n FROM (SELECT nullif(event_type, 'view') AS event_type FROM events) WHERE event_type IS DISTINCT FROM 'click' GROUP BY ALL")
def q02_not_equal(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("view")))
    return x.where(V.matches(F.col("event_type"), "!=", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT event_id, nullif(event_type, 'view') AS t, value FROM events)
SELECT event_id FROM x WHERE coalesce(t = 'error' OR value > 50, false) AND NOT coalesce(t = 'error' AND value < 10, false)""")
def q03_boolean(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("t"), "value")
    wide = V.any_of(V.matches(F.col("t"), "=", "error"), V.matches(F.col("value"), ">", 50))
    return x.where(V.all_of(wide, V.negate(V.all_of(V.matches(F.col("t"), "=", "error"), V.matches(F.col("value"), "<", 10))))).select("event_id")


@query(f"SELECT event_id, {T.format('ts')} AS ts FROM events ORDER BY events.ts DESC, event_id LIMIT 100")
def q05_events_page(spark, sf_dir):
    return S.events_page(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_id").select("event_id", V.text_time(F.col("ts")).alias("ts"))


@query(f"SELECT event_id, {T.format('ts')} AS ts FROM events WHERE events.ts < TIMESTAMP '2024-01-20' OR (events.ts = TIMESTAMP '2024-01-20' AND event_id > 5) ORDER BY events.ts DESC, event_id LIMIT 50")
def q06_after(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.events_page(x, "ts", "event_id", 50, ("2024-01-20", 5)).select("event_id", V.text_time(F.col("ts")).alias("ts"))


@query("SELECT count(l_orderkey) AS count, round(sum(l_quantity), 6) AS sum_l_quantity, min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax, round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem")
def q09_stats(spark, sf_dir):
    return S.stats(table(spark, sf_dir, "lineitem"), F.count("l_orderkey").alias("count"), r6(F.sum("l_quantity")).alias("sum_l_quantity"), F.min("l_discount").alias("min_l_discount"), F.max("l_tax").alias("max_l_tax"), F.round(F.avg("l_extendedprice"), 4).alias("avg_l_extendedprice"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM (SELECT nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus, l_quantity FROM lineitem) WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY ALL")
def q10_stats_by(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return S.stats(x, F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("qty"), by=("l_returnflag", "l_linestatus"))


@query(f"""WITH c AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS b)
SELECT {T.format('b')} AS bucket, count(e.event_id) AS n, round(sum(e.value), 4) AS v FROM c LEFT JOIN (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-12' AND ts >= TIMESTAMP '2023-12-30') e ON date_trunc('day', e.ts) = b GROUP BY b""")
def q11_timechart(spark, sf_dir):
    x = S.timechart(events(spark, sf_dir), "ts", "1 day", "2023-12-30", "2024-01-12", F.count("event_id").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return x.select(V.text_time(F.col("bucket")).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"), "v")


@query(f"""SELECT {T.format('bucket')} AS bucket, user_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, user_id)::INT AS rank
FROM (SELECT date_trunc('day', ts) AS bucket, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL)) WHERE rank <= 10""")
def q12_timechart_by(spark, sf_dir):
    x = S.timechart_by(events(spark, sf_dir).withColumnRenamed("entity_id", "user_id"), "ts", "1 day", "user_id")
    return x.withColumn("bucket", V.text_time(F.col("bucket")))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, l_partkey LIMIT 25")
def q13_top(spark, sf_dir):
    return S.top(table(spark, sf_dir, "lineitem"), "l_partkey", 25)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n, l_suppkey LIMIT 25")
def q14_rare(spark, sf_dir):
    return S.top(table(spark, sf_dir, "lineitem"), "l_suppkey", 25, rare=True)


@query("SELECT o_orderkey, o_orderstatus, '[redacted]' AS o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def n18_mask(spark, sf_dir):
    x = S.mask(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_totalprice", "o_custkey", "o_orderdate"])
    return x.where("o_orderpriority is not null")


# --- features and baselines


@query(f"""WITH {EV}, x AS (SELECT *, date_trunc('day', ts) AS w, CASE WHEN outcome IN ('failure', 'success') THEN outcome END AS o FROM ev),
y AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY entity_id, w ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)
SELECT entity_id, {T.format('w')} AS window_start, count(*) AS attempts, count(*) FILTER (outcome = 'failure') AS failures, round(count(*) FILTER (outcome = 'failure') / count(*), 6) AS failure_rate,
 count(DISTINCT host_id) AS distinct_devices, count(DISTINCT source_ip) AS distinct_ips, count(*) FILTER (outcome = 'success' AND p = 'failure') AS failure_then_success,
 array_to_string(list(event_id ORDER BY event_id), ',') AS inputs FROM y GROUP BY entity_id, w""")
def f02_auth_features(spark, sf_dir):
    x = A.auth_features(events(spark, sf_dir), "1 day")
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "attempts", "failures", r6("failure_rate").alias("failure_rate"), "distinct_devices", "distinct_ips", "failure_then_success", joined("inputs").alias("inputs"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)) GROUP BY ALL")
def f04_dedup(spark, sf_dir):
    x = table(spark, sf_dir, "events")
    return x.union(x.where("event_id % 10 = 0")).dropDuplicates(["event_id"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT future, count(*) AS n FROM (SELECT ts > (ts - to_minutes((event_id % 9)::INT)) + INTERVAL 5 MINUTE AS future FROM events) GROUP BY ALL")
def f05_split_future(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("received", F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 9).cast("int")))
    return A.split_future(x, "received").groupBy("future").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV} SELECT event_id, {T.format('m')} AS watermark, coalesce(ts < m, false) AS late FROM (SELECT *, max(ts) OVER (PARTITION BY entity_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS m FROM ev)""")
def f06_entity_watermark(spark, sf_dir):
    return A.with_entity_watermark(events(spark, sf_dir), "event_id").select("event_id", V.text_time(F.col("watermark")).alias("watermark"), "late")


@query(f"WITH {EV} SELECT {T.format('min(m)')} AS watermark FROM (SELECT max(ts) AS m FROM ev GROUP BY entity_id)")
def f07_global_watermark(spark, sf_dir):
    return events(spark, sf_dir).groupBy("entity_id").agg(F.max("ts").alias("m")).agg(V.text_time(F.min("m")).alias("watermark"))


@query(f"""WITH {EV}, w AS (SELECT min(m) AS m FROM (SELECT max(ts) AS m FROM ev GROUP BY entity_id)), f AS (SELECT entity_id, date_trunc('day', ts) AS s, count(*) AS attempts FROM ev GROUP BY ALL)
SELECT entity_id, {T.format('s')} AS window_start, attempts FROM f, w WHERE s + INTERVAL 1 DAY <= m""")
def f09_closed_windows(spark, sf_dir):
    x = events(spark, sf_dir)
    mark = x.groupBy("entity_id").agg(F.max("ts").alias("m")).agg(F.min("m").alias("mark"))
    f = A.auth_features(x, "1 day").join(F.broadcast(mark))  # one row
    return A.closed_windows(f, F.col("mark")).select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "attempts")


@query(f"WITH {EV} SELECT entity_id, count(*) FILTER (b) AS backfill, count(*) FILTER (NOT b) AS kept FROM (SELECT entity_id, ts < max(ts) OVER (PARTITION BY entity_id) - INTERVAL 7 DAY AS b FROM ev) GROUP BY ALL")
def f10_retention(spark, sf_dir):
    return A.split_retention(events(spark, sf_dir), "7 days").groupBy("entity_id").agg(F.count_if("backfill").alias("backfill"), F.count_if(~F.col("backfill")).alias("kept"))


@query(f"""WITH {EV}, o AS (SELECT entity_id, date_trunc('day', ts) AS w, count(*)::VARCHAR AS h FROM ev WHERE event_id % 50 <> 0 GROUP BY ALL), n AS (SELECT entity_id, date_trunc('day', ts) AS w, count(*)::VARCHAR AS h FROM ev GROUP BY ALL)
SELECT entity_id, {T.format('w')} AS window_start, n.h AS hash, (CASE WHEN o.h IS NULL THEN 1 ELSE 2 END)::INT AS revision FROM n LEFT JOIN o USING (entity_id, w) WHERE o.h IS DISTINCT FROM n.h""")
def f14_revise_windows(spark, sf_dir):
    def windows(df):
        return A.auth_features(df, "1 day").select("entity_id", "window_start", F.col("attempts").cast("string").alias("hash"))

    x = events(spark, sf_dir)
    return A.revise_windows(windows(x.where("event_id % 50 <> 0")).withColumn("revision", F.lit(1)), windows(x), ["entity_id", "window_start"]).withColumn("window_start", V.text_time(F.col("window_start")))


FEAT = f"""{EV}, fx AS (SELECT *, date_trunc('day', ts) AS w, CASE WHEN outcome IN ('failure', 'success') THEN outcome END AS o FROM ev),
fy AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY entity_id, w ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM fx),
ft AS (SELECT entity_id, w, count(*)::DOUBLE AS attempts, count(*) FILTER (outcome = 'failure')::DOUBLE AS failures, (count(*) FILTER (outcome = 'failure') / count(*))::DOUBLE AS failure_rate,
 count(DISTINCT host_id)::DOUBLE AS distinct_devices, count(DISTINCT source_ip)::DOUBLE AS distinct_ips, count(*) FILTER (outcome = 'success' AND p = 'failure')::DOUBLE AS failure_then_success FROM fy GROUP BY entity_id, w),
fu AS (UNPIVOT ft ON attempts, failures, failure_rate, distinct_devices, distinct_ips, failure_then_success INTO NAME feature VALUE x),
md AS (SELECT feature, count(x) AS count, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max FROM fu GROUP BY feature)"""


def samples(spark, sf_dir):
    return A.auth_features(events(spark, sf_dir), "1 day").withColumn("quality", F.lit("qualified")).withColumn("revision", F.lit(1))


@query(f"WITH {FEAT}, s AS (SELECT count(*) AS samples, count(DISTINCT CASE WHEN w + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20' THEN w END) AS days FROM ft WHERE w + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20') SELECT *, CASE WHEN samples < 100 THEN 'insufficient_samples' WHEN days < 14 THEN 'insufficient_days' ELSE 'ready' END AS reason, samples >= 100 AND days >= 14 AS train FROM s")
def b03_decision(spark, sf_dir):
    return A.training_decision(A.select_samples(samples(spark, sf_dir), "2024-01-20"), "2024-01-20")


@query(f"WITH {FEAT} SELECT feature, count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max FROM md")
def b04_train(spark, sf_dir):
    return A.train(samples(spark, sf_dir)).select("feature", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(f"WITH {FEAT} SELECT feature, round(max(CASE WHEN std = 0 THEN CASE WHEN x = mean THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(x - mean) / std END), 6) AS max_z, round(avg((CASE WHEN std = 0 THEN CASE WHEN x = mean THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(x - mean) / std END <= 3)::INT), 6) AS within FROM fu JOIN md USING (feature) GROUP BY feature")
def b05_evaluate(spark, sf_dir):
    s = samples(spark, sf_dir)
    return A.evaluate_baseline(A.train(s), s).select("feature", r6("max_z").alias("max_z"), r6("within").alias("within"))


# --- detection, revisions and risk

BURST = f"""{EV}, bu AS (SELECT entity_id, date_trunc('day', ts) AS w, count(*) AS failures, list(event_id ORDER BY event_id) AS e FROM ev WHERE outcome = 'failure' GROUP BY ALL HAVING count(*) >= {{n}})"""


@query(f"""WITH {EV}, f AS (SELECT a.entity_id, a.event_id, a.ts, date_trunc('day', a.ts) AS w, list(b.event_id ORDER BY b.ts, b.event_id) AS e, count(*) AS failures FROM ev a JOIN ev b ON a.entity_id = b.entity_id AND b.outcome = 'failure'
 AND b.ts >= a.ts - INTERVAL 3 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) WHERE a.outcome = 'success' GROUP BY ALL HAVING count(*) >= 3)
SELECT entity_id, {T.format('w')} AS window_start, {T.format('ts')} AS at, failures, array_to_string(list_append(e, event_id), ',') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, w ORDER BY ts, event_id) AS n FROM f) WHERE n = 1""")
def d02_failure_then_success(spark, sf_dir):
    x = A.failure_then_success(events(spark, sf_dir), 3, "3 days", "1 day")
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), V.text_time(F.col("at")).alias("at"), "failures", joined("evidence").alias("evidence"))


@query(f"""WITH {BURST.format(n=3)} SELECT entity_id, {T.format('w')} AS window_start, failures, array_to_string(e, ',') AS evidence,
 'anom:' || sha256('tenant|failure-burst|' || entity_id || '|' || strftime(w, '%Y-%m-%dT%H:%M:%S') || '+00:00|g1') AS finding_id, 'tenant|failure-burst|' || entity_id || '|' || strftime(w, '%Y-%m-%dT%H:%M:%S') || 'Z|g1' AS business_key FROM bu""")
def d03_failure_burst(spark, sf_dir):
    x = A.to_findings(A.failure_burst(events(spark, sf_dir), 3, "1 day"), "tenant", "failure-burst", "g1", F.lit(0.9))
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "failures", joined("evidence").alias("evidence"), "finding_id", "business_key")


@query(f"""WITH {FEAT}, z AS (SELECT entity_id, w, feature, CASE WHEN std = 0 THEN CASE WHEN x = mean THEN 0 ELSE 'inf'::DOUBLE END ELSE abs(x - mean) / std END AS z FROM fu JOIN md USING (feature))
SELECT entity_id, {T.format('w')} AS window_start, round(max(z), 6) AS worst, array_to_string(list(feature ORDER BY feature) FILTER (z >= 3), ',') AS deviating, round(least(1, max(z) / 6), 6) AS score FROM z GROUP BY entity_id, w HAVING max(z) >= 3""")
def d04_baseline_deviation(spark, sf_dir):
    s = samples(spark, sf_dir)
    x = A.baseline_deviation(s, A.train(s))
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), r6("worst").alias("worst"), F.array_join("deviating", ",").alias("deviating"), r6("score").alias("score"))


def verdicts(spark, sf_dir, n: int) -> DataFrame:
    x = A.failure_burst(events(spark, sf_dir), n, "1 day").withColumn("score0", F.least(F.lit(1.0), F.col("failures") / 5))
    x = A.to_findings(x, "tenant", "failure-burst", "g1", F.col("score0"))
    return x.select("business_key", "entity_id", "score", F.sha2(F.concat_ws("|", F.lit(n).cast("string"), "failures"), 256).alias("hash"))


def first_frames(spark, sf_dir, n: int) -> DataFrame:
    return verdicts(spark, sf_dir, n).withColumn("revision", F.lit(1)).withColumn("operation", F.lit("upsert")).withColumn("at", F.lit("2024-01-29").cast("timestamp"))


VERDICT = "SELECT 'tenant|failure-burst|' || entity_id || '|' || strftime(w, '%Y-%m-%dT%H:%M:%S') || 'Z|g1' AS k, entity_id, least(1.0, failures / 5) AS score, sha256('{n}|' || failures) AS h FROM (SELECT entity_id, date_trunc('day', ts) AS w, count(*) AS failures FROM ev WHERE outcome = 'failure' GROUP BY ALL HAVING count(*) >= {n})"
FRAMES = f"""{EV}, va AS ({VERDICT.format(n=2)}), vb AS ({VERDICT.format(n=3)}),
fr AS (SELECT k, entity_id, 1 AS revision, 'upsert' AS op, score, TIMESTAMP '2024-01-29' AS at0 FROM va
 UNION ALL SELECT coalesce(vb.k, va.k), coalesce(vb.entity_id, va.entity_id), CASE WHEN va.k IS NULL THEN 1 ELSE 2 END, CASE WHEN vb.k IS NULL THEN 'retracted' ELSE 'upsert' END, coalesce(vb.score, va.score), TIMESTAMP '2024-01-30' FROM va FULL JOIN vb USING (k) WHERE va.h IS DISTINCT FROM vb.h)"""


def frames(spark, sf_dir) -> DataFrame:
    one = first_frames(spark, sf_dir, 2)
    return one.select("business_key", "entity_id", "revision", "operation", "hash", "score", "at").unionByName(A.recompute(one, verdicts(spark, sf_dir, 3), "2024-01-30"))


@query(f"WITH {FRAMES} SELECT k AS business_key, entity_id, revision::INT AS revision, op AS operation, round(score, 6) AS score FROM fr")
def r02_recompute(spark, sf_dir):
    return frames(spark, sf_dir).select("business_key", "entity_id", "revision", "operation", r6("score").alias("score"))


@query(f"WITH {FRAMES} SELECT k AS business_key, max(revision)::INT AS revision, round(arg_max(score, revision), 6) AS score FROM fr GROUP BY k HAVING arg_max(op, revision) = 'upsert'")
def r06_current_view(spark, sf_dir):
    return A.current_view(frames(spark, sf_dir), alerts_only=True).select("business_key", "revision", r6("score").alias("score"))


CONTRIB = f"""{FRAMES}, lv AS (SELECT *, CASE op WHEN 'upsert' THEN score ELSE 0 END AS live FROM fr), ct AS (SELECT *, live - coalesce(lag(live) OVER (PARTITION BY k ORDER BY revision), 0) AS amount FROM lv)"""


@query(f"WITH {CONTRIB} SELECT k AS business_key, revision::INT AS revision, round(amount, 6) AS amount, CASE WHEN op = 'retracted' THEN 'reversal' WHEN revision = 1 THEN 'positive' ELSE 'compensation' END AS kind, true AS in_order FROM ct")
def r07_risk_contributions(spark, sf_dir):
    return A.risk_contributions(frames(spark, sf_dir)).select("business_key", "revision", r6("amount").alias("amount"), "kind", "in_order")


@query(f"WITH {CONTRIB} SELECT entity_id, round(greatest(0, sum(amount * pow(0.5, epoch(TIMESTAMP '2024-02-05' - at0) / 86400 / 7))), 6) AS risk, count(*) AS contributions FROM ct GROUP BY entity_id")
def r09_entity_risk(spark, sf_dir):
    return A.entity_risk(A.risk_contributions(frames(spark, sf_dir)), "2024-02-05").select("entity_id", r6("risk").alias("risk"), "contributions")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with a burst of failures, as findings and contributions, and their decayed risk."""
    frames_ = first_frames(spark, sf_dir, 2)
    return A.entity_risk(A.risk_contributions(frames_), "2024-02-05").where("risk > 0")


# --- merges and receipts


@query("""WITH s AS (SELECT o_orderkey AS id, 1 AS revision, o_orderstatus AS hash FROM orders WHERE o_orderkey % 3 = 0),
i AS (SELECT o_orderkey AS id, (o_orderkey % 3)::INT AS revision, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'x' END AS hash FROM orders UNION ALL SELECT o_orderkey, 1, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN i.id % 3 = 0 AND i.revision = 0 THEN 'stale' WHEN i.id % 3 = 0 THEN 'noop' ELSE 'written' END AS outcome FROM i) GROUP BY ALL""")
def s13_merge_versioned(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    state = o.where("id % 3 = 0").select("id", F.lit(1).alias("revision"), F.col("o_orderstatus").alias("hash"))
    new = o.select("id", (F.col("id") % 3).cast("int").alias("revision"), F.when(F.col("id") % 2 == 0, F.col("o_orderstatus")).otherwise("x").alias("hash")).unionByName(state)
    return M.merge_versioned(state, new).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 8 = 0 THEN 'conflict' ELSE 'noop' END ELSE 'appended' END AS outcome FROM events) GROUP BY ALL""")
def s14_append_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hash"))
    new = e.withColumn("hash", F.when(F.col("event_id") % 8 == 0, "other").otherwise(F.col("hash")))
    return M.append_history(e.where("event_id % 4 = 0"), new, ["event_id"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT event_id, event_type AS hash, 'a' AS context, 0 AS arrival FROM events UNION ALL SELECT event_id, event_type, CASE WHEN event_id % 20 = 0 THEN 'b' ELSE 'a' END, 1 FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, event_type || '!', 'a', 2 FROM events WHERE event_id % 15 = 0)
SELECT event_id, arrival, CASE WHEN arrival = 0 THEN 'accepted' WHEN arrival = 2 OR context = 'b' THEN 'conflict' ELSE 'duplicate' END AS outcome FROM x""")
def s07_receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("hash"), F.lit("a").alias("context"), F.lit(0).alias("arrival"))
    again = e.where("event_id % 10 = 0").withColumn("context", F.when(F.col("event_id") % 20 == 0, "b").otherwise("a")).withColumn("arrival", F.lit(1))
    other = e.where("event_id % 15 = 0").withColumn("hash", F.concat("hash", F.lit("!"))).withColumn("arrival", F.lit(2))
    return M.classify_receipts(e.unionByName(again).unionByName(other), ["event_id"], "arrival", "hash").select("event_id", "arrival", "outcome")


@query("SELECT event_id, 'raw:' || sha256('6:raw-v1' || strlen(event_type)::VARCHAR || ':' || event_type || strlen(event_id::VARCHAR)::VARCHAR || ':' || event_id) AS id FROM events")
def s05_stable_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.stable_id("raw", "raw-v1", F.col("event_type"), F.col("event_id")).alias("id"))


@query("SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_shipdate < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 6 DAY")
def s22_expired_partitions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    last = x.agg(F.max("day").cast("string")).first()[0]
    return I.expired_partitions(x, "day", last).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("""WITH c AS (SELECT event_type AS topic, user_id % 4 AS partition, min(event_id) AS committed FROM events GROUP BY ALL), e AS (SELECT event_type AS topic, user_id % 4 AS partition, min(event_id) AS earliest FROM events WHERE event_id > 100 GROUP BY ALL)
SELECT topic, partition, committed, earliest, earliest - committed AS lost FROM c JOIN e USING (topic, partition) WHERE committed < earliest""")
def s23_retention_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), "event_id")
    return I.retention_gaps(e.groupBy("topic", "partition").agg(F.min("event_id").alias("committed")), e.where("event_id > 100").groupBy("topic", "partition").agg(F.min("event_id").alias("earliest")))


@query("SELECT user_id % 3 AS consumer_group, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def s25_inbox(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("consumer_group"), F.col("event_id").alias("message_id"), "event_type", "ts")
    return I.dedup_inbox(e.union(e.where("message_id % 4 = 0")), "ts").groupBy("consumer_group", "event_type").agg(F.count(F.lit(1)).alias("n"))


# --- normalisation


def conn_lines(spark, sf_dir) -> DataFrame:
    """Network-sensor payloads made from events: a fault in every ninth row."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    rec = F.struct(
        F.when(i % 9 == 0, "yesterday").otherwise((1704067200 + i).cast("string")).alias("ts"), F.when(i % 9 != 1, F.concat(F.lit("10.0.0."), (i % 200).cast("string"))).alias("id.orig_h"), F.lit("10.1.0.1").alias("id.resp_h"),
        (i % 70000).alias("id.orig_p"), F.lit(443).alias("id.resp_p"), F.lit("TCP").alias("proto"), (i % 7 - 1).alias("duration"), i.alias("orig_bytes"), F.when(i % 5 != 0, i * 2).alias("resp_bytes"), F.when(i % 2 == 0, "-").otherwise("SSL").alias("service"),
    )
    return e.select(i.alias("raw_event_id"), F.to_json(rec).alias("payload"))


@query("""SELECT event_id AS raw_event_id, CASE WHEN event_id % 9 <> 1 THEN '10.0.0.' || (event_id % 200) END AS source_ip, CASE WHEN event_id % 70000 <= 65535 THEN (event_id % 70000)::INT END AS source_port, 'tcp' AS transport,
 CASE WHEN event_id % 7 > 0 THEN (event_id % 7 - 1) * 1000000000 END AS duration, CASE WHEN event_id % 5 <> 0 THEN event_id * 3 END AS bytes, CASE WHEN event_id % 2 = 1 THEN 'ssl' END AS protocol, 'unknown' AS outcome, CASE event_id % 9 WHEN 0 THEN 'UIM_EVENT_TIME_INVALID' WHEN 1 THEN 'UIM_ZEEK_ENDPOINTS_REQUIRED' END AS error_code FROM events""")
def n03_conn(spark, sf_dir):
    return I.normalize_conn(conn_lines(spark, sf_dir)).select("raw_event_id", "source_ip", "source_port", "transport", "duration", "bytes", "protocol", "outcome", "error_code")


@query("""SELECT 'quar:' || sha256('quarantine-v1|' || event_id || '|' || c) AS quarantine_id, event_id AS raw_event_id, 'UIM' AS stage, c AS code, c AS reason FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'UIM_EVENT_TIME_INVALID' WHEN 1 THEN 'UIM_ZEEK_ENDPOINTS_REQUIRED' END AS c FROM events) WHERE c IS NOT NULL""")
def n12_quarantine(spark, sf_dir):
    return I.to_quarantine(I.normalize_conn(conn_lines(spark, sf_dir)))


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'h' || user_id END AS domain, CASE WHEN event_id % 3 = 0 THEN '/' ELSE '/p' END AS path, CASE WHEN event_id % 10 <> 0 THEN (200 + event_id % 300)::INT END AS status_code, CASE WHEN event_id % 10 = 0 THEN 'unknown' WHEN 200 + event_id % 300 >= 400 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 4 = 0 THEN 'UIM_HTTP_HOST_REQUIRED' END AS error_code FROM events""")
def n05_http(spark, sf_dir):
    i = F.col("event_id")
    rec = F.struct(F.when(i % 4 != 0, F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("host"), F.when(i % 3 != 0, "/p").alias("uri"), F.when(i % 10 == 0, "-").otherwise((200 + i % 300).cast("string")).alias("status_code"), F.lit(1).alias("ts"), F.lit("10.0.0.1").alias("id.orig_h"), F.lit("10.0.0.2").alias("id.resp_h"))
    return I.normalize_http(table(spark, sf_dir, "events").select("event_id", F.to_json(rec).alias("payload"))).select("event_id", "domain", "path", "status_code", "outcome", "error_code")


@query("""SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN event_type || '.example' END AS question, CASE WHEN event_id % 2 = 0 THEN 'NOERROR' END AS response_code, CASE WHEN event_id % 6 = 0 THEN 'UIM_DNS_QUERY_REQUIRED' END AS error_code FROM events""")
def n04_dns(spark, sf_dir):
    i = F.col("event_id")
    rec = F.struct(F.when(i % 6 != 0, F.concat("event_type", F.lit(".example"))).alias("query"), F.when(i % 2 == 0, "NOERROR").otherwise("-").alias("rcode_name"), F.lit(1).alias("ts"), F.lit("10.0.0.1").alias("id.orig_h"), F.lit("10.0.0.2").alias("id.resp_h"))
    return I.normalize_dns(table(spark, sf_dir, "events").select("event_id", F.to_json(rec).alias("payload"))).select("event_id", "question", "response_code", "error_code")


@query("""SELECT code, domain, outcome, count(*) AS n FROM (SELECT c AS code, CASE c WHEN '4625' THEN 'authentication' WHEN '4768' THEN 'authentication' WHEN '4720' THEN 'iam' END AS domain,
 CASE c WHEN '4625' THEN 'failure' WHEN '4768' THEN CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failure' END WHEN '4720' THEN 'success' END AS outcome FROM (SELECT event_id, ['4625', '4768', '4720', '9999'][event_id % 4 + 1] AS c FROM events)) GROUP BY ALL""")
def n08_windows_semantics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, ("4625", "4768", "4720", "9999"))), (F.col("event_id") % 4 + 1).cast("int")).alias("code"), F.when(F.col("event_id") % 2 == 0, "0x0").otherwise("0x6").alias("status"))
    return I.join_windows_semantics(e).groupBy("code", "domain", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'keep-errors' WHEN event_type = 'view' AND user_id = 7 THEN 'views-of-7' WHEN event_type = 'view' THEN 'views' ELSE 'none' END AS rule, count(*) AS n, event_type = 'view' AS would_drop FROM events GROUP BY ALL")
def n14_shadow_counts(spark, sf_dir):
    rules = [{"id": "views-of-7", "equal": {"event_type": "view", "user_id": 7}}, {"id": "views", "equal": {"event_type": "view"}}, {"id": "keep-errors", "equal": {"event_type": "error"}, "protected": True}]
    return I.shadow_counts(table(spark, sf_dir, "events"), rules)


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type = 'view' OR user_id = 7) GROUP BY ALL")
def n15_drop_filter(spark, sf_dir):
    return I.drop_filter(table(spark, sf_dir, "events"), {"event_type": "view", "user_id": 7}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# --- entities, attribution and relations

HOLD = """h AS (SELECT * FROM (SELECT l_partkey AS part, l_suppkey AS supp, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_to FROM lineitem) WHERE valid_to IS NULL OR valid_from < valid_to),
pr AS (SELECT o_orderkey, (o_orderkey % 200 + 1) AS part, o_orderdate AS at0 FROM orders)"""


def holders(spark, sf_dir) -> DataFrame:
    x = E.history_intervals(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_shipdate", ["l_orderkey", "l_linenumber"])
    return x.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("entity_id"), "valid_from", "valid_to", (F.col("l_suppkey") % 2 == 0).alias("strong"))


def probes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 200 + 1).alias("part"), F.col("o_orderdate").alias("at"))


@query(f"WITH {HOLD} SELECT o_orderkey, part, supp AS entity_id FROM pr JOIN h USING (part) WHERE at0 >= valid_from AND (valid_to IS NULL OR at0 < valid_to)")
def j01_attribute(spark, sf_dir):
    return R.interval_join(probes(spark, sf_dir), holders(spark, sf_dir), ["part"], "at").select("o_orderkey", "part", "entity_id")


@query(f"""WITH {HOLD}, c AS (SELECT o_orderkey, supp, at0 >= valid_from AND (valid_to IS NULL OR at0 < valid_to) AS hit FROM pr LEFT JOIN h USING (part)),
g AS (SELECT o_orderkey, count(DISTINCT supp) FILTER (hit) AS n, min(supp) FILTER (hit) AS s, count(supp) AS known FROM c GROUP BY o_orderkey)
SELECT o_orderkey, CASE n WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN s END AS entity_id, CASE WHEN n = 1 THEN CASE WHEN s % 2 = 0 THEN 1.0 ELSE 0.8 END ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN n = 0 THEN CASE WHEN known > 0 THEN 'no_active_occurrence_at_event_time' ELSE 'no_matching_entity' END END AS reason FROM g""")
def e08_adjudicate(spark, sf_dir):
    x = R.adjudicate(probes(spark, sf_dir), holders(spark, sf_dir), ["part"], ["o_orderkey"], "at")
    return x.select("o_orderkey", "state", "entity_id", "confidence", "reason")


@query("""SELECT kind, canonical, strong, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'ip' ELSE 'hostname' END AS kind, CASE event_id % 3 WHEN 0 THEN 'user' || user_id || '@example.com' WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || (event_id % 11) END ELSE 'host' || user_id END AS canonical, false AS strong FROM events) GROUP BY ALL""")
def e01_identifiers(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id").cast("string")
    kind = F.when(i % 3 == 0, "email").when(i % 3 == 1, "ip").otherwise("hostname")
    value = F.when(i % 3 == 0, F.concat(F.lit(" User"), u, F.lit("@Example.com"))).when(i % 3 == 1, F.concat(F.when(i % 2 == 0, "10.0.0.").otherwise("10.0."), (i % 11).cast("string"))).otherwise(F.concat(F.lit("HOST"), u, F.lit(".")))
    return E.normalize_identifiers(table(spark, sf_dir, "events").select(kind.alias("kind"), value.alias("value"))).groupBy("kind", "canonical", "strong").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT user_id, max(event_id % 5 = 0) AS has_sid, count(DISTINCT event_type) FILTER (event_id % 5 <> 0) > 1 AS names, count(*) FILTER (event_id % 5 <> 0) AS m, min(event_type) FILTER (event_id % 5 <> 0) AS t FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN has_sid THEN 'sid' ELSE 'username' END AS kind, CASE WHEN has_sid THEN 'S-1-' || user_id ELSE t END AS canonical, names AS contradiction FROM k""")
def e03_select_canonical(spark, sf_dir):
    sid = F.col("event_id") % 5 == 0
    x = table(spark, sf_dir, "events").select("user_id", F.when(sid, "sid").otherwise("username").alias("kind"), F.when(sid, F.concat(F.lit("S-1-"), F.col("user_id").cast("string"))).otherwise(F.col("event_type")).alias("value"))
    return E.select_canonical(E.normalize_identifiers(x), "user_id")


@query(f"""WITH i AS (SELECT o_orderkey, o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS b FROM orders) SELECT o_orderkey, coalesce(max(b) OVER (PARTITION BY o_custkey ORDER BY a, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a, false) AS overlaps FROM i""")
def e13_overlapping(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("valid_from"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days")).alias("valid_to"))
    return E.overlapping(x, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "overlaps")


# --- feedback


@query("""SELECT rule_id, count(*) FILTER (f = 'true_positive') AS tp, count(*) FILTER (f = 'false_positive') AS fp, count(*) FILTER (f = 'false_negative') AS fn, count(*) FILTER (f = 'inconclusive') AS inconclusive,
 round(CASE WHEN count(*) FILTER (f IN ('true_positive', 'false_positive')) > 0 THEN count(*) FILTER (f = 'true_positive') / count(*) FILTER (f IN ('true_positive', 'false_positive')) ELSE 0 END, 6) AS precision
FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'rule' || (doc_id % 5) END AS rule_id, CASE WHEN toxic = 1 THEN 'false_negative' WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS f FROM labels) GROUP BY ALL""")
def v02_feedback_metrics(spark, sf_dir):
    return A.feedback_metrics(feedback(spark, sf_dir)).withColumn("precision", r6("precision"))


def feedback(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "false_negative").when(F.col("quality") == 1, "true_positive").otherwise("false_positive")
    rule = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("rule"), (F.col("doc_id") % 5).cast("string")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("finding_id"), kind.alias("feedback_type"), rule.alias("rule_id"), (F.col("doc_id") % 7).alias("created_at"))


@query("""SELECT finding_id, arg_max(f, o) AS label FROM (SELECT doc_id % 50 AS finding_id, CASE WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS f, (doc_id % 7) * 1000000000 + doc_id AS o FROM labels WHERE toxic <> 1) GROUP BY finding_id""")
def v04_finding_labels(spark, sf_dir):
    return A.finding_labels(feedback(spark, sf_dir))


@query(f"""WITH {EV} SELECT entity_id, {T.format("date_trunc('hour', ts)")} AS hour, array_to_string(list(DISTINCT event_id ORDER BY event_id), ',') AS findings, count(*) AS n FROM ev WHERE outcome = 'failure' GROUP BY entity_id, date_trunc('hour', ts)""")
def v07_auto_cases(spark, sf_dir):
    x = A.auto_cases(events(spark, sf_dir).where("outcome = 'failure'").select("entity_id", F.col("event_id").alias("finding_id"), F.col("ts").alias("at")))
    return x.select("entity_id", V.text_time(F.col("hour")).alias("hour"), joined("findings").alias("findings"), "n")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 50), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60),
c AS (SELECT count(*) FILTER (a.user_id IS NOT NULL AND e.user_id IS NOT NULL) AS tp, count(*) FILTER (e.user_id IS NULL) AS fp, count(*) FILTER (a.user_id IS NULL) AS fn FROM a FULL JOIN e ON a.user_id = e.user_id)
SELECT tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall FROM c""")
def v01_evaluate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = A.evaluate_scenario(e.where("event_type = 'error' and value > 50"), e.where("event_type = 'purchase' and value > 60"), "user_id")
    return x.withColumn("precision", r6("precision")).withColumn("recall", r6("recall"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, strlen('{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}') + 1 AS w FROM lineitem),
r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n, sum(w) OVER (ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM l) SELECT n, bytes FROM r WHERE n <= 5000 AND bytes <= 100000""")
def s19_export(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.export_lines(x, ["l_orderkey", "l_linenumber"], 5000, 100_000).select("n", "bytes")


# --- finding lists, evidence and overview


def stored_findings(spark, sf_dir) -> DataFrame:
    """Orders as findings: priority is severity, status F is closed."""
    status = F.when(F.col("o_orderstatus") == "F", "retracted").otherwise("open")
    severity = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").otherwise("low")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderdate").cast("timestamp").alias("at"), status.alias("status"), severity.alias("severity"))


FINDINGS = """fi AS (SELECT o_orderkey AS finding_id, o_orderdate AS at0, CASE WHEN o_orderstatus = 'F' THEN 'retracted' ELSE 'open' END AS status,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'high' ELSE 'low' END AS severity FROM orders)"""


@query(f"""WITH {FINDINGS}, u AS (SELECT finding_id, at0, 'open' AS status FROM fi UNION ALL SELECT finding_id, at0 + INTERVAL 1 DAY, status FROM fi), r AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY at0 DESC) AS n FROM u)
SELECT finding_id, {T.format('at0')} AS at, status FROM r WHERE n = 1 AND status <> 'retracted' ORDER BY at0 DESC, finding_id LIMIT 100""")
def q20_merge_findings(spark, sf_dir):
    x = stored_findings(spark, sf_dir).select("finding_id", "at", "status")
    out = S.merge_findings(x.withColumn("status", F.lit("open")), x.withColumn("at", F.col("at") + F.expr("interval 1 day")), "finding_id", "at", 100)
    return out.withColumn("at", V.text_time(F.col("at")))


@query(f"WITH {FINDINGS} SELECT finding_id, {T.format('at0')} AS at FROM fi WHERE severity = 'critical' AND status = 'open' ORDER BY at0 DESC, finding_id LIMIT 200")
def q19_list_findings(spark, sf_dir):
    return S.list_findings(stored_findings(spark, sf_dir), 200, severity="critical", status="open").select("finding_id", V.text_time(F.col("at")).alias("at"))


@query(f"WITH {FINDINGS} SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND severity IN ('high', 'critical')) AS open_high, {T.format('max(at0)')} AS latest FROM fi")
def q22_findings_overview(spark, sf_dir):
    return S.findings_overview(stored_findings(spark, sf_dir)).withColumn("latest", V.text_time(F.col("latest")))


@query("SELECT (epoch(TIMESTAMP '2024-03-01') - floor(epoch(max(ts))))::BIGINT AS age, epoch(TIMESTAMP '2024-03-01') - floor(epoch(max(ts))) > 300 AS degraded FROM events")
def q23_freshness(spark, sf_dir):
    return S.freshness(table(spark, sf_dir, "events"), "ts", "2024-03-01")


@query(f"WITH {EV}, m AS (SELECT *, count(*) OVER () > 200 AS truncated FROM ev WHERE entity_id = 7 AND outcome = 'failure') SELECT event_id, {T.format('ts')} AS ts, truncated FROM m ORDER BY m.ts, event_id LIMIT 200")
def q21_evidence(spark, sf_dir):
    x = events(spark, sf_dir)
    found = x.where("outcome = 'failure'").groupBy(F.col("entity_id").alias("finding_id")).agg(F.collect_list("event_id").alias("evidence"))
    return S.evidence(found, x, 7).select("event_id", V.text_time(F.col("ts")).alias("ts"), "truncated")


# --- more of ingest, entities, baselines, revisions and feedback


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type || '.example' END AS server_name, 'TLSv12' AS version, CASE WHEN event_id % 5 = 0 THEN 'UIM_TLS_SERVER_NAME_REQUIRED' END AS error_code FROM events""")
def n06_tls(spark, sf_dir):
    rec = F.struct(F.when(F.col("event_id") % 5 != 0, F.concat("event_type", F.lit(".example"))).alias("server_name"), F.lit("TLSv12").alias("version"), F.lit(1).alias("ts"), F.lit("10.0.0.1").alias("id.orig_h"), F.lit("10.0.0.2").alias("id.resp_h"))
    return I.normalize_tls(table(spark, sf_dir, "events").select("event_id", F.to_json(rec).alias("payload"))).select("event_id", "server_name", "version", "error_code")


@query("""SELECT quality, reasons, usable_for, count(*) AS n FROM (SELECT CASE WHEN value > 50 OR user_id = 7 THEN 'partial' ELSE 'qualified' END AS quality, concat_ws(',', CASE WHEN value > 50 THEN 'large' END, CASE WHEN user_id = 7 THEN 'seven' END) AS reasons, 'event_query,authentication_features' AS usable_for FROM events) GROUP BY ALL""")
def n10_quality(spark, sf_dir):
    x = I.with_quality(table(spark, sf_dir, "events"), [(F.col("value") > 50, "large"), (F.col("user_id") == 7, "seven")], F.lit("authentication"))
    return x.groupBy("quality", F.array_join("reasons", ",").alias("reasons"), F.array_join("usable_for", ",").alias("usable_for")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, {T.format('ts')} AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-18'")
def s08_prune_receipts(spark, sf_dir):
    return I.prune_receipts(table(spark, sf_dir, "events"), "ts", "2024-01-20").select("event_id", V.text_time(F.col("ts")).alias("ts"))


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_custkey AS case_id, o_orderdate AS ended, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'done' END AS outcome, (SELECT max(o_orderdate) FROM orders) AS now FROM orders)
SELECT job_id FROM j WHERE ended < now - to_days(CASE outcome WHEN 'failed' THEN 90 ELSE 30 END) AND case_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def s24_prunable_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("ended"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("outcome"))
    links = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("case_id"))
    held = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("case_id"))
    now = o.agg(F.max("o_orderdate").cast("string")).first()[0]
    return I.prunable(jobs, links, held, now, {"failed": 90, "done": 30}).select("job_id")


@query("SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'conflict' ELSE 'idempotent' END AS outcome, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'inserted', count(*) FROM customer")
def e22_register_rules(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("rule"), F.lit("1").alias("version"), F.col("c_mktsegment").alias("content"), "c_nationkey")
    changed = c.withColumn("content", F.when(F.col("c_nationkey") % 2 == 0, "changed").otherwise(F.col("content")))
    new = changed.unionByName(c.withColumn("version", F.lit("2")))
    return M.register(c.drop("c_nationkey"), new, ["rule", "version"], "content").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {HOLD} SELECT part, supp AS entity_id FROM h WHERE valid_from <= TIMESTAMP '1996-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-01-01')")
def j02_relations_at(spark, sf_dir):
    return E.relations_at(holders(spark, sf_dir), "1996-01-01").select("part", "entity_id")


@query(f"WITH {EV} SELECT entity_id, outcome AS role, count(*) AS n FROM ev WHERE outcome <> 'unknown' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def e17_role_counts(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("role", F.col("outcome")).withColumn("state", F.when(F.col("outcome") != "unknown", "resolved").otherwise("unresolved"))
    return E.role_counts(x, "2024-01-05", "2024-01-20")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events WHERE value <= 80 GROUP BY ALL")
def d01_eligible(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("org", F.lit("tenant")).withColumn("quality", F.when(F.col("value") > 80, "rejected").when(F.col("value") > 50, "partial").when(F.col("value").isNotNull(), "qualified"))
    return A.eligible(x.union(x), "tenant").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {T.format("min(date_trunc('day', ts))")} AS first_start, {T.format("max(date_trunc('day', ts)) + INTERVAL 1 DAY")} AS last_end, count(DISTINCT user_id) AS entities FROM events")
def b06_sample_range(spark, sf_dir):
    x = A.sample_range(samples(spark, sf_dir))
    return x.select(V.text_time(F.col("first_start")).alias("first_start"), V.text_time(F.col("last_end")).alias("last_end"), "entities")


@query(f"SELECT o_custkey AS lineage, max(struct_pack(a := o_orderdate, v := o_orderkey)).v AS version, {T.format('max(o_orderdate)')} AS created_at FROM orders GROUP BY o_custkey")
def b08_latest_models(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lineage"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return A.latest_models(m, ["lineage"]).withColumn("created_at", V.text_time(F.col("created_at")))


@query(f"WITH {FRAMES} SELECT k AS business_key, (max(revision) + 1)::INT AS revision, 'retracted' AS operation FROM fr GROUP BY k HAVING arg_max(op, revision) = 'upsert'")
def r05_switch_generation(spark, sf_dir):
    return A.switch_generation(A.current_view(frames(spark, sf_dir)), "failure-burst", "g1", "2024-02-01").select("business_key", "revision", "operation")


@query("""WITH f AS (SELECT doc_id AS id, doc_id % 50 AS finding_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 30 ELSE doc_id % 40 END AS case_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS f, (doc_id % 7) * 1000000000 + doc_id AS o FROM labels),
l AS (SELECT finding_id, arg_max(f, o) AS label FROM f WHERE f IS NOT NULL GROUP BY finding_id) SELECT id, finding_id, label, case_id, c_mktsegment AS case_status FROM f LEFT JOIN l USING (finding_id) LEFT JOIN customer ON c_custkey = case_id""")
def j04_feedback_evaluation(spark, sf_dir):
    f = feedback(spark, sf_dir).withColumn("target_case", F.when(F.col("id") % 2 == 0, F.col("id") % 30)).withColumn("source_case", F.col("id") % 40)
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("status"))
    return A.feedback_evaluation(f, A.finding_labels(f), cases).select("id", "finding_id", "label", "case_id", "case_status")


# --- streams


@query(f"""WITH {EV} SELECT entity_id, {T.format("date_trunc('day', ts)")} AS window_start, count(*) AS attempts, count(*) FILTER (outcome = 'failure') AS failures, count(DISTINCT host_id)::INT AS distinct_devices, count(DISTINCT source_ip)::INT AS distinct_ips
FROM ev WHERE entity_id IS NOT NULL GROUP BY entity_id, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev) - INTERVAL 10 MINUTE""")
def f18_stream_features(spark, sf_dir):
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    x = W.replay(shaped(raw), "1 day")
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "attempts", "failures", "distinct_devices", "distinct_ips")


@query(f"""WITH {EV}, a AS (SELECT *, event_id AS arrival, ts - to_minutes((event_id % 9)::INT) AS received FROM ev UNION ALL SELECT *, event_id + 1000000000, ts FROM ev WHERE outcome = 'failure'),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrival) AS n, ts > received + INTERVAL 5 MINUTE AS ahead FROM a),
c AS (SELECT *, max(CASE WHEN n = 1 AND NOT ahead THEN ts END) OVER (PARTITION BY entity_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS m FROM b)
SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN ahead THEN 'future_rejected' WHEN ts < m THEN 'late_accepted' ELSE 'added' END AS disposition, count(*) AS n FROM c GROUP BY 1""")
def f13_disposition_counts(spark, sf_dir):
    x = events(spark, sf_dir)
    one = x.withColumn("arrival", F.col("event_id")).withColumn("received", F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 9).cast("int")))
    two = x.where("outcome = 'failure'").withColumn("arrival", F.col("event_id") + 1_000_000_000).withColumn("received", F.col("ts"))
    return W.dispositions(one.unionByName(two), "arrival", "received").groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
