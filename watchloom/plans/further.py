"""Further registered queries: entity and relation upkeep, cases, feature records, raw lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import analysis as A
from watchloom.operators import casework as C
from watchloom.operators import entities as E
from watchloom.operators import occurrences as O
from watchloom.operators import records as R
from watchloom.plans.registry import CONTRIB, FEAT, T, frames, joined, query, r6, samples, table
from watchloom.sources import ingest as I

# --- raw lines


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{' || props ELSE props END AS v FROM events)
SELECT event_id, CASE WHEN json_valid(v) THEN json_extract(v, '$.k')::BIGINT END AS k, CASE WHEN NOT coalesce(json_valid(v), false) THEN 'JSON_INVALID' END AS error_code FROM x""")
def s01_read_raw(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value"))
    x = I.read_raw(lines, "k long")
    return x.select("event_id", F.when(F.col("error_code").isNull(), F.col("raw.k")).alias("k"), "error_code")


# --- entities and relations


@query("""WITH seen AS (SELECT event_type AS space, user_id::VARCHAR AS canonical, min(ts) AS f FROM events GROUP BY ALL),
n AS (SELECT *, CASE WHEN canonical::BIGINT % 3 = 1 THEN 2 ELSE 1 END AS o FROM seen WHERE canonical::BIGINT % 3 <> 0), k AS (SELECT *, CASE WHEN o > 1 THEN canonical || '#' || o ELSE canonical END AS key FROM n)
SELECT 'ent:' || sha256('9:entity-v1' || '6:tenant' || '4:user' || strlen(space) || ':' || space || strlen(key) || ':' || key) AS entity_id, space, canonical, o::INT AS occurrence, strftime(f, '%Y-%m-%d %H:%M:%S') AS valid_from FROM k""")
def e05_register_entities(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.lit("user").alias("entity_type"), F.col("event_type").alias("space"), F.col("user_id").cast("string").alias("canonical"), F.col("ts").cast("timestamp").alias("ts"))
    third = F.col("canonical").cast("long") % 3
    known = seen.where(third != 2).groupBy("entity_type", "space", "canonical").agg(F.max("ts").alias("last"))
    known = known.select("entity_type", "space", "canonical", F.lit(1).alias("occurrence"), F.when(third == 1, F.col("last")).alias("valid_to"))
    x = E.register_entities(seen, known, "tenant")
    return x.select("entity_id", "space", "canonical", "occurrence", V.text_time(F.col("valid_from")).alias("valid_from"))


@query("""WITH e AS (SELECT event_type || ':' || user_id AS key, user_id % 5 = 0 AS strong, min(ts) AS f, CASE WHEN user_id % 4 = 0 THEN max(ts) END AS t FROM events GROUP BY event_type, user_id),
q AS (SELECT event_id, event_type || ':' || user_id AS key, ts AS tm FROM events WHERE event_id % 3 = 0), x AS (SELECT q.*, strong, t IS NULL AS open, tm > f AS ok FROM q JOIN e USING (key)),
y AS (SELECT *, coalesce(bool_or(NOT strong AND open AND ok) OVER (PARTITION BY key ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM x)
SELECT event_id, CASE WHEN strong THEN 'strong_refused' WHEN NOT open OR done THEN 'no_active_occurrence' WHEN ok THEN 'closed' ELSE 'invalid_end' END AS outcome FROM y""")
def e06_transfer_weak(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", "user_id"))
    known = e.groupBy("key", "user_id").agg(F.min("ts").alias("valid_from"), F.max("ts").alias("last"))
    known = known.select("key", (F.col("user_id") % 5 == 0).alias("strong"), "valid_from", F.when(F.col("user_id") % 4 == 0, F.col("last")).alias("valid_to"))
    return O.transfer_weak(known, e.where("event_id % 3 = 0").select("event_id", "key", F.col("ts").alias("at")), ["at", "event_id"]).select("event_id", "outcome")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate AS tm, o_orderkey IS NULL AS missing, o_orderdate + INTERVAL 30 DAY AS f, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 60 DAY END AS t
 FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON l_orderkey = o_orderkey),
y AS (SELECT *, t IS NULL AND tm > f AS ok FROM x),
z AS (SELECT *, coalesce(t, min(CASE WHEN ok THEN tm END) OVER (PARTITION BY l_orderkey ORDER BY tm, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS e FROM y)
SELECT l_orderkey, l_linenumber, CASE WHEN missing THEN 'missing' WHEN e = tm THEN 'unchanged' WHEN e IS NOT NULL THEN 'conflict' WHEN ok THEN 'closed' ELSE 'invalid_end' END AS outcome FROM z""")
def e14_close_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0")
    later = lambda d: F.col("o_orderdate") + F.make_dt_interval(days=F.lit(d))
    rel = o.select(F.col("o_orderkey").alias("relation_id"), later(30).alias("valid_from"), F.when(F.col("o_orderkey") % 4 == 0, later(60)).alias("valid_to"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation_id"), "l_linenumber", F.col("l_shipdate").alias("at"))
    return O.close_relations(rel, asked, ["at", "l_linenumber"]).select(F.col("relation_id").alias("l_orderkey"), "l_linenumber", "outcome")


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 200""")
def e16_list_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rel = o.select("o_custkey", F.col("o_orderkey").alias("relation_id"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("valid_to"))
    return O.list_relations(rel, "o_custkey").select("o_custkey", F.col("relation_id").alias("o_orderkey"), "place")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '5') AND c_mktsegment = 'MACHINERY' AND (c_name > 'Customer#000000020' OR (c_name = 'Customer#000000020' AND c_custkey > 20)) ORDER BY c_name, c_custkey LIMIT 50""")
def e18_search_entities(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_key"), F.col("c_mktsegment").alias("entity_type"))
    return O.search_entities(x, "5", "MACHINERY", ("Customer#000000020", 20), 50).select(F.col("entity_id").alias("c_custkey"), F.col("canonical_key").alias("c_name"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY n), '') AS latest FROM customer LEFT JOIN (SELECT * FROM x WHERE n <= 5) ON c_custkey = o_custkey GROUP BY c_custkey""")
def e20_entity_detail(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey", "o_orderdate")
    return O.entity_detail(c, o, "o_orderdate", "o_orderkey").select(F.col("entity_id").alias("c_custkey"), joined("latest").alias("latest"))


@query("""SELECT o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey % 2 = 0) THEN 'entity_missing'
 WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'rule_missing' ELSE 'ok' END AS outcome FROM orders""")
def j06_require_registered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("rule_version"))
    known = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("entity_id"))
    rules = o.where(F.col("rule_version").isin("1-URGENT", "2-HIGH")).select("rule_version")
    return O.require_registered(o, known, rules).select("o_orderkey", "outcome")


# --- feature records, samples, risk


@query(f"WITH {FEAT} SELECT entity_id, count(DISTINCT CASE WHEN w + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20' THEN w END) AS complete_days FROM ft GROUP BY entity_id")
def b02_complete_days(spark, sf_dir):
    return R.complete_days(samples(spark, sf_dir), "2024-01-20", "entity_id")


@query(f"""WITH {FEAT} SELECT entity_id, {T.format('w')} AS window_start, 'failure_burst' AS rule FROM ft WHERE failures >= 2
UNION ALL SELECT entity_id, {T.format('w')}, 'failure_then_success' FROM ft WHERE failures >= 2 AND failure_then_success >= 1""")
def d07_record_rules(spark, sf_dir):
    return R.record_rules(samples(spark, sf_dir), 2).select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "rule")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'inserted' WHEN o_orderkey % 4 + 1 > 2 THEN 'corrected' WHEN o_orderkey % 4 + 1 < 2 THEN 'stale_revision'
 WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'idempotent' END AS outcome FROM orders""")
def f15_merge_samples(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    store = o.where("id % 3 = 0").select("id", F.lit(2).alias("revision"), F.col("o_orderstatus").alias("hash"))
    new = o.select("id", (F.col("id") % 4 + 1).cast("int").alias("revision"), F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("o_orderstatus")).alias("hash"))
    return R.merge_samples(store, new).select("id", "outcome")


@query(f"WITH {CONTRIB} SELECT entity_id, round(sum(amount * pow(0.5, epoch(TIMESTAMP '2024-02-05' - at0) / 86400 / 7)), 6) AS risk FROM ct GROUP BY entity_id HAVING sum(amount * pow(0.5, epoch(TIMESTAMP '2024-02-05' - at0) / 86400 / 7)) > 0")
def r11_risk_view(spark, sf_dir):
    return R.risk_view(A.risk_contributions(frames(spark, sf_dir)), "2024-02-05").select("entity_id", r6("risk").alias("risk"))


@query(f"""WITH {CONTRIB}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY at0, k, revision)::INT AS object_revision FROM ct)
SELECT a.k AS business_key, a.revision::INT AS revision, a.object_revision, round(greatest(0, sum(b.amount * pow(0.5, epoch(a.at0 - b.at0) / 86400 / 7))), 6) AS risk
FROM n a JOIN n b ON a.entity_id = b.entity_id AND b.at0 <= a.at0 AND b.at0 >= a.at0 - INTERVAL 30 DAY GROUP BY ALL""")
def r12_risk_objects(spark, sf_dir):
    x = R.risk_objects(A.risk_contributions(frames(spark, sf_dir)))
    return x.select("business_key", "revision", "object_revision", r6("risk").alias("risk"))


# --- cases


def cases(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("open")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), status.alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("medium").alias("severity"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("assignee"),
        F.when(status == "closed", F.col("o_orderdate").cast("timestamp")).alias("closed_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderpriority").alias("title"),
    )


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus <> 'F' AND o_custkey % 5 = 0) AS unassigned,
 count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01') AS closed_today FROM orders""")
def v08_case_overview(spark, sf_dir):
    return C.case_overview(cases(spark, sf_dir), "1998-01-01 13:00:00")


@query("""SELECT o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent')
 AND (o_orderdate < TIMESTAMP '1998-01-01' OR (o_orderdate = TIMESTAMP '1998-01-01' AND o_orderkey < 100)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def v09_list_cases(spark, sf_dir):
    x = C.list_cases(cases(spark, sf_dir), "Urgent", ("1998-01-01", 100), status="in_progress")
    return x.select("case_id", V.text_time(F.col("updated_at")).alias("updated_at"))


@query("""SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS finding_id, 'false_positive' AS feedback_type, o_orderpriority AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def v06_verdict_feedback(spark, sf_dir):
    verdict = F.when(F.col("status") == "closed", "false_positive")
    x = cases(spark, sf_dir).select("case_id", verdict.alias("verdict"), F.col("title").alias("reason"), F.col("updated_at").alias("at"))
    return C.verdict_feedback(x, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("finding_id")))


@query("""SELECT o_orderkey AS case_id, coalesce((SELECT string_agg(p::VARCHAR, ',' ORDER BY p) FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey = o_orderkey)), '') AS findings,
 coalesce((SELECT string_agg(s::VARCHAR, ',' ORDER BY s) FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_orderkey = o_orderkey)), '') AS links FROM orders""")
def v11_case_snapshots(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("finding_id"), F.col("l_suppkey").alias("link"))
    return C.case_snapshots(cases(spark, sf_dir).select("case_id"), x, x).select("case_id", joined("findings").alias("findings"), joined("links").alias("links"))
