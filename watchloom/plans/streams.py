"""Queries of the streaming jobs, replayed from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.plans.registry import EV, T, events, joined, query, r6
from watchloom.streaming import arrivals as B
from watchloom.streaming import findings as L
from watchloom.streaming import ingestion as G
from watchloom.streaming.windows import shared_folder

#: Events arrive up to an hour late, in three rounds.
ASOF = f"""{EV}, ar AS (SELECT *, ts + to_minutes((event_id % 7 * 10)::INT) AS arrival FROM ev),
ro AS (SELECT *, CASE WHEN arrival < TIMESTAMP '2024-01-11' THEN 0 WHEN arrival < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS round FROM ar),
x AS (SELECT r, ro.* FROM ro JOIN (SELECT unnest([0, 1, 2]) AS r) ON round <= r),
bu AS (SELECT r, 'failure-burst' AS rule_id, entity_id, date_trunc('day', ts) AS w, date_trunc('day', ts) + INTERVAL 1 DAY AS at0, least(1.0, count(*) / 5) AS score, count(*) AS failures, list(event_id ORDER BY event_id) AS e
 FROM x WHERE outcome = 'failure' GROUP BY ALL HAVING count(*) >= 3),
fs AS (SELECT a.r, a.entity_id, a.event_id, a.ts, date_trunc('day', a.ts) AS w, list(b.event_id ORDER BY b.ts, b.event_id) AS e, count(*) AS failures FROM x a JOIN x b ON a.r = b.r AND a.entity_id = b.entity_id AND b.outcome = 'failure'
 AND b.ts >= a.ts - INTERVAL 3 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) WHERE a.outcome = 'success' GROUP BY ALL HAVING count(*) >= 3),
ft AS (SELECT r, 'failure-then-success' AS rule_id, entity_id, w, ts AS at0, 0.9 AS score, failures, list_append(e, event_id) AS e FROM (SELECT *, row_number() OVER (PARTITION BY r, entity_id, w ORDER BY ts, event_id) AS n FROM fs) WHERE n = 1),
al AS (SELECT * FROM bu UNION ALL SELECT * FROM ft),
ch AS (SELECT *, (e IS DISTINCT FROM lag(e) OVER k OR at0 IS DISTINCT FROM lag(at0) OVER k)::INT AS changed, score - coalesce(lag(score) OVER k, 0) AS amount FROM al WINDOW k AS (PARTITION BY rule_id, entity_id, w ORDER BY r))"""


def arrivals(spark, sf_dir):
    """Events with the round in which they arrive."""
    arrival = F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 7 * 10).cast("int"))
    x = events(spark, sf_dir).withColumn("received", arrival)
    return x.withColumn("round", F.when(F.col("received") < "2024-01-11", 0).when(F.col("received") < "2024-01-21", 1).otherwise(2))


@query(f"""WITH {ASOF} SELECT entity_id, rule_id, {T.format('w')} AS window_start, {T.format('arg_max(at0, r)')} AS at, sum(changed)::INT AS revision, arg_max(failures, r) AS failures, round(arg_max(score, r), 6) AS score, array_to_string(arg_max(e, r), ',') AS evidence
FROM ch GROUP BY entity_id, rule_id, w""")
def f18_stream_findings(spark, sf_dir):
    folder = L.replay(arrivals(spark, sf_dir), 3)
    x = L.current(L.written(spark, folder, "frames"))
    return x.select("entity_id", "rule_id", V.text_time(F.col("window_start")).alias("window_start"), V.text_time(F.col("at")).alias("at"), "revision", "failures", r6("score").alias("score"), joined("evidence").alias("evidence"))


@query(f"""WITH {ASOF} SELECT entity_id, round(greatest(0, sum(CASE WHEN epoch(TIMESTAMP '2024-02-05' - at0) / 86400 > 30 THEN 0 ELSE amount * pow(0.5, epoch(TIMESTAMP '2024-02-05' - at0) / 86400 / 7) END)), 6) AS risk, count(*) AS contributions FROM ch WHERE changed = 1 GROUP BY entity_id""")
def f18_stream_risk(spark, sf_dir):
    folder = L.replay(arrivals(spark, sf_dir), 3)
    return L.entity_risk(L.written(spark, folder, "risk"), "2024-02-05").select("entity_id", r6("risk").alias("risk"), "contributions")


@query(f"""WITH {EV}, w AS (SELECT entity_id, date_trunc('day', ts) AS s, count(*) AS attempts, count(*) FILTER (outcome = 'failure') AS failures FROM ev GROUP BY ALL)
SELECT entity_id, {T.format('s')} AS window_start, attempts, failures FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts + to_minutes((event_id % 7 * 10)::INT)) FROM ev) - INTERVAL 1 HOUR""")
def f18_stream_windows(spark, sf_dir):
    folder = L.replay(arrivals(spark, sf_dir), 3)
    x = L.written(spark, folder, "windows")
    last = x.groupBy("entity_id", "window_start").agg(F.max_by(F.struct("attempts", "failures"), "revision").alias("x"))
    return last.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), "x.attempts", "x.failures")


#: Arrivals with events that come two and nine days late, again, or before their time; the state machine as a recursion over each entity's arrivals.
STEPS = f"""{EV}, aa AS (SELECT entity_id, event_id, ts, CASE WHEN event_id % 40 = 0 THEN ts - INTERVAL 10 MINUTE WHEN event_id % 25 = 0 THEN ts + INTERVAL 9 DAY WHEN event_id % 10 = 0 THEN ts + INTERVAL 2 DAY ELSE ts END AS received FROM ev WHERE entity_id IS NOT NULL
 UNION ALL SELECT entity_id, event_id, ts, ts + INTERVAL 1 HOUR FROM ev WHERE entity_id IS NOT NULL AND event_id % 6 = 0),
an AS (SELECT *, epoch_us(received) AS arrival, date_trunc('day', ts) AS s, row_number() OVER (PARTITION BY entity_id ORDER BY received, event_id, ts) AS i FROM aa),
rs AS (SELECT DISTINCT entity_id, 0::BIGINT AS i, NULL::TIMESTAMP AS mx, NULL::TIMESTAMP AS la, NULL::TIMESTAMP AS fl, []::STRUCT(s TIMESTAMP, ids BIGINT[])[] AS ws, NULL::BIGINT AS event_id, NULL::BIGINT AS arrival, '' AS told, NULL::VARCHAR AS why, []::BIGINT[] AS lost FROM an
 UNION ALL SELECT entity_id, i, CASE WHEN ok THEN greatest(coalesce(mx, ts), ts) ELSE mx END, CASE WHEN ok THEN received ELSE la END, CASE WHEN told = 'future_rejected' THEN fl ELSE fl2 END,
  CASE WHEN NOT ok THEN ws WHEN has THEN list_transform(ws, lambda w: CASE WHEN w.s = s THEN {{'s': w.s, 'ids': list_append(w.ids, event_id)}} ELSE w END) WHEN full_ THEN list_append(list_filter(ws, lambda w: w.s <> old), {{'s': s, 'ids': [event_id]}}) ELSE list_append(ws, {{'s': s, 'ids': [event_id]}}) END,
  event_id, arrival, told, CASE WHEN told = 'late_rejected' THEN CASE WHEN wm >= s + INTERVAL 1 DAY THEN 'window_closed' ELSE 'beyond_retention' END END, CASE WHEN ok AND NOT has AND full_ THEN list_filter(ws, lambda w: w.s = old)[1].ids ELSE [] END
 FROM (SELECT *, told IN ('added', 'late_accepted') AS ok FROM (SELECT *, CASE WHEN ts > received + INTERVAL 5 MINUTE THEN 'future_rejected' WHEN NOT has AND (wm >= s + INTERVAL 1 DAY OR full_ AND s <= old) THEN 'late_rejected'
   WHEN has AND list_contains(list_filter(ws, lambda w: w.s = s)[1].ids, event_id) THEN 'duplicate' WHEN has AND len(list_filter(ws, lambda w: w.s = s)[1].ids) >= 3 THEN 'capacity_rejected' WHEN ts < wm THEN 'late_accepted' ELSE 'added' END AS told
  FROM (SELECT *, greatest(coalesce(mx - INTERVAL 6 DAY, TIMESTAMP '1900-01-01'), coalesce(fl2, TIMESTAMP '1900-01-01')) AS wm, len(list_filter(ws, lambda w: w.s = s)) > 0 AS has, len(ws) >= 4 AS full_, list_min(list_transform(ws, lambda w: w.s)) AS old
   FROM (SELECT an.*, rs.mx, rs.la, rs.fl, rs.ws, CASE WHEN rs.la IS NOT NULL AND an.received - rs.la >= INTERVAL 5 MINUTE THEN greatest(coalesce(rs.fl, TIMESTAMP '1900-01-01'), an.received - INTERVAL 6 DAY) ELSE rs.fl END AS fl2
    FROM rs JOIN an ON an.entity_id = rs.entity_id AND an.i = rs.i + 1)))))"""
_BOUNDS = B.Bounds(window=86_400, lateness=6 * 86_400, windows=4, contributions=3)


def late_arrivals(spark, sf_dir):
    x, i = events(spark, sf_dir).where("entity_id is not null"), F.col("event_id")
    day = lambda n: F.col("ts") + F.expr(f"interval {n}")
    one = x.withColumn("received_at", F.when(i % 40 == 0, day("-10 minutes")).when(i % 25 == 0, day("9 days")).when(i % 10 == 0, day("2 days")).otherwise(F.col("ts")))
    both = one.unionByName(x.where(i % 6 == 0).withColumn("received_at", day("1 hour")))
    return both.withColumn("arrival", F.unix_micros("received_at"))


@query(f"WITH RECURSIVE {STEPS} SELECT entity_id, event_id, arrival, told AS disposition FROM rs WHERE i > 0")
def f12_dispositions(spark, sf_dir):
    return B.dispositions(late_arrivals(spark, sf_dir), _BOUNDS, block_rows=5_000)[0]


@query(f"WITH RECURSIVE {STEPS} SELECT entity_id, event_id, arrival, why AS reason FROM rs WHERE why IS NOT NULL UNION ALL SELECT entity_id, unnest(lost), arrival, 'window_evicted' FROM rs WHERE len(lost) > 0")
def f12_backfill(spark, sf_dir):
    return B.dispositions(late_arrivals(spark, sf_dir), _BOUNDS, block_rows=5_000)[1].select("entity_id", "event_id", "arrival", "reason")


def log_folder(spark, sf_dir) -> str:
    """Connection records of events as two folders of NDJSON files, the second with a part of the first again; faults by event_id."""
    i = F.col("event_id")
    x = events(spark, sf_dir)
    rec = F.to_json(F.struct(F.when(i % 9 == 0, "yesterday").otherwise((1704067200 + i).cast("string")).alias("ts"), i.cast("string").alias("uid"), F.when(i % 11 != 0, F.concat(F.lit("10.0.0."), (i % 200).cast("string"))).alias("id.orig_h"), F.lit("10.1.0.1").alias("id.resp_h"), F.lit("TCP").alias("proto"), i.alias("orig_bytes"), F.lit(5).alias("resp_bytes")))
    line = F.when(i % 13 == 0, F.concat(F.lit("{broken "), i.cast("string"))).when(i % 17 == 0, F.rpad(i.cast("string"), 400, "x")).otherwise(rec)
    base = shared_folder(spark)
    for part, own in (("a", x.where(i % 2 == 0)), ("b", x.where((i % 2 == 1) | (i % 4 == 0)))):
        own.select(line.alias("value")).write.text(f"{base}/logs/{part}")
    return base


@query("""WITH x AS (SELECT event_id AS i, 1 AS n FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 2 = 1 OR event_id % 4 = 0)
SELECT CASE WHEN i % 13 <> 0 AND i % 17 = 0 THEN 'LINE_TOO_LONG' END AS error_code, count(*) AS n, sum(CASE WHEN i % 13 = 0 THEN 8 + length(i::VARCHAR) WHEN i % 17 = 0 THEN 400 END)::BIGINT AS fault_bytes FROM x GROUP BY 1""")
def s02_read_log_files(spark, sf_dir):
    from watchloom.sources.ingest import read_log_files

    x = read_log_files(spark, f"{log_folder(spark, sf_dir)}/logs/*", 300)
    return x.groupBy("error_code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("value").startswith('{"'), F.octet_length("value"))).cast("long").alias("fault_bytes"))


def ingested(spark, sf_dir) -> str:
    """Both folders through the stream, the second after a restart."""
    base = log_folder(spark, sf_dir)
    vendor = ("zeek", "p", "zeek.conn")
    for part in ("a", "b"):
        G.start(G.log_lines(spark, f"{base}/logs/{part}", 300), f"{base}/out", f"{base}/checkpoint-{part}", part, "tenant", vendor, available_now=True).awaitTermination()
    return f"{base}/out"


_CODES = "CASE WHEN i % 13 = 0 THEN 'DIP_JSON_INVALID' WHEN i % 17 = 0 THEN 'LINE_TOO_LONG' WHEN i % 9 = 0 THEN 'UIM_EVENT_TIME_INVALID' WHEN i % 11 = 0 THEN 'UIM_ZEEK_ENDPOINTS_REQUIRED' END"


@query(f"""WITH x AS (SELECT event_id AS i, {_CODES.replace('i %', 'event_id %')} AS code FROM events)
SELECT 'tcp' AS transport, 'unknown' AS outcome, '10.0.0.' || (i % 200) AS source_ip, i + 5 AS bytes, count(*) AS n FROM x WHERE code IS NULL GROUP BY ALL""")
def s10_stream_events(spark, sf_dir):
    x = G.events(spark, ingested(spark, sf_dir), ["transport", "outcome", "source_ip", "bytes"])
    # a record that stands in files of both folders is one event
    return x.groupBy("transport", "outcome", "source_ip", "bytes").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT event_id AS i, {_CODES.replace('i %', 'event_id %')} AS code FROM events)
SELECT CASE WHEN code LIKE 'UIM_%' THEN 'UIM' ELSE 'DIP' END AS stage, code, count(*) AS n FROM x WHERE code IS NOT NULL GROUP BY ALL""")
def s11_quarantine(spark, sf_dir):
    x = G.quarantine(spark, ingested(spark, sf_dir), ["stage", "code"])
    return x.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n"))
