"""Queries of attribution over all holders and of relations with cardinality, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import attribution as R
from watchloom.operators import relations as L
from watchloom.plans.registry import T, holders, joined, query, table

#: Each line of an order asks who held its part at the order's date: all parts are asked.
LINES = """h AS (SELECT * FROM (SELECT l_partkey AS part, l_suppkey AS supp, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS valid_to FROM lineitem) WHERE valid_to IS NULL OR valid_from < valid_to),
ln AS (SELECT o_orderkey, l_linenumber AS line, l_partkey AS part, o_orderdate AS at0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def lines(spark, sf_dir):
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select("o_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("o_orderdate").alias("at"))


@query(f"WITH {LINES} SELECT o_orderkey, line, part, supp AS entity_id, count(*) OVER (PARTITION BY o_orderkey, line) AS holders FROM ln JOIN h USING (part) WHERE at0 >= valid_from AND (valid_to IS NULL OR at0 < valid_to)")
def j01_attribute_lines(spark, sf_dir):
    x = R.interval_join(lines(spark, sf_dir), holders(spark, sf_dir), ["part"], "at")
    n = x.groupBy("o_orderkey", "line").agg(F.count(F.lit(1)).alias("holders"))
    return x.join(n, ["o_orderkey", "line"]).select("o_orderkey", "line", "part", "entity_id", "holders")


@query(f"""WITH {LINES}, ro AS (SELECT o_orderkey AS k, at0, CASE WHEN o_orderkey % 11 = 0 OR line % 5 = 0 THEN NULL ELSE part END AS part, o_orderkey % 11 <> 0 AS named, line % 5 <> 0 AS valid,
 CASE WHEN o_orderkey % 13 = 0 THEN 'identity_space_unregistered' WHEN o_orderkey % 17 = 0 THEN 'registration_failed' END AS failure FROM ln),
c AS (SELECT ro.*, supp, supp IS NOT NULL AND failure IS NULL AND at0 >= valid_from AND (valid_to IS NULL OR at0 < valid_to) AS hit FROM ro LEFT JOIN h USING (part)),
g AS (SELECT k, coalesce(list_sort(list(DISTINCT supp) FILTER (hit)), []) AS cs, bool_or(supp % 2 = 0) FILTER (hit) AS strong, bool_or(supp % 2 = 1) FILTER (hit) AS weak, count(supp) AS known, bool_or(named) AS named, bool_or(named AND valid) AS valid, max(failure) AS failure,
 count(DISTINCT part) AS ids, count(DISTINCT part) FILTER (hit) AS agree FROM c GROUP BY k)
SELECT k AS o_orderkey, CASE len(cs) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
 CASE WHEN failure IS NOT NULL THEN failure WHEN NOT named THEN 'no_identifiers' WHEN NOT valid THEN 'identifier_invalid' WHEN len(cs) > 1 THEN CASE WHEN strong AND weak THEN 'strong_weak_conflict' ELSE 'multiple_active_candidates' END
  WHEN len(cs) = 0 THEN CASE WHEN known > 0 THEN 'no_active_occurrence_at_event_time' ELSE 'no_matching_entity' END END AS reason,
 CASE WHEN len(cs) = 1 THEN cs[1] END AS entity_id, CASE WHEN len(cs) = 1 THEN CASE WHEN strong THEN 1.0 ELSE 0.8 END ELSE 0.0 END::DOUBLE AS confidence, array_to_string(cs, ',') AS candidates,
 CASE WHEN failure = 'identity_space_unregistered' THEN 'lookup_skipped:identity_space_unregistered' WHEN failure IS NOT NULL THEN 'registration_failed_role_forced_unresolved' WHEN NOT named THEN 'no_identifiers_reported' WHEN NOT valid THEN 'all_identifiers_failed_normalization'
  WHEN len(cs) = 0 THEN CASE WHEN known > 0 THEN 'occurrences_exist_but_none_covers_event_time' ELSE 'no_registered_entity_matches' END
  WHEN len(cs) > 1 THEN CASE WHEN strong AND weak THEN 'strong_and_weak_identifiers_resolve_to_different_entities' ELSE 'multiple_active_candidates_at_event_time' END || ',candidates_preserved_not_overwritten'
  ELSE CASE WHEN strong THEN 'resolved_by_strong_identifier' || CASE WHEN ids > 1 THEN ',strong_identifier_priority_over_weak' ELSE '' END ELSE 'resolved_by_weak_identifier_occurrence_at_event_time' END || CASE WHEN agree > 1 THEN ',multiple_identifiers_agree' ELSE '' END END AS trail
FROM g""")
def e08_attributions(spark, sf_dir):
    k = F.col("o_orderkey")
    named, valid = k % 11 != 0, F.col("line") % 5 != 0
    roles = lines(spark, sf_dir).withColumn("identified", named).withColumn("valid", valid).withColumn("failure", F.when(k % 13 == 0, R.UNREGISTERED).when(k % 17 == 0, R.FAILED)).withColumn("part", F.when(named & valid, F.col("part")))
    x = R.adjudicate(roles, holders(spark, sf_dir), ["part"], ["o_orderkey"], "at")
    return x.select("o_orderkey", "state", "reason", "entity_id", "confidence", joined("candidates").alias("candidates"), F.array_join("trail", ",").alias("trail"))


REQUESTS = """o AS (SELECT o_custkey AS f, CASE WHEN o_custkey % 10 = 9 THEN 'owns' WHEN o_custkey % 2 = 0 THEN 'assigned_to' ELSE 'member_of' END AS type, o_orderkey % 3 AS t, o_orderkey AS e, o_orderdate::TIMESTAMP AS a, o_orderkey AS k FROM orders),
rq AS (SELECT f, type, t, e, CASE WHEN k % 5 = 0 THEN 'transfer' ELSE 'assert' END AS action, a, CASE WHEN k % 4 <> 0 AND k % 5 <> 0 THEN a + INTERVAL 30 DAY END AS b, k AS arrival FROM o
 UNION ALL SELECT f, type, t, e, 'assert', a, a + INTERVAL 30 DAY, k + 10000000 FROM o WHERE k % 7 = 0 UNION ALL SELECT f, type, t, e, 'assert', a + INTERVAL 1 DAY, NULL, k + 20000000 FROM o WHERE k % 11 = 0),
nq AS (SELECT *, CASE WHEN type <> 'assigned_to' THEN t END AS g, row_number() OVER (PARTITION BY f, type, CASE WHEN type <> 'assigned_to' THEN t END ORDER BY arrival, e) AS i FROM rq),
rs AS (SELECT f, type, g, 0::BIGINT AS i, []::STRUCT(a TIMESTAMP, b TIMESTAMP, t BIGINT, e BIGINT)[] AS held, NULL::BIGINT AS t, NULL::BIGINT AS e, NULL::TIMESTAMP AS a, NULL::BIGINT AS arrival, '' AS outcome FROM nq WHERE i = 1
 UNION ALL SELECT f, type, g, i, CASE outcome WHEN 'inserted' THEN list_append(held, {'a': a, 'b': b, 't': t, 'e': e}) WHEN 'transferred' THEN list_append(list_transform(held, lambda h: {'a': h.a, 'b': coalesce(h.b, a), 't': h.t, 'e': h.e}), {'a': a, 'b': NULL, 't': t, 'e': e}) ELSE held END, t, e, a, arrival, outcome
 FROM (SELECT nq.*, rs.held, CASE WHEN nq.type = 'owns' THEN 'unknown_type' WHEN nq.action = 'transfer' AND nq.type <> 'assigned_to' THEN 'multi_holder'
   WHEN nq.action = 'transfer' THEN CASE WHEN len(list_filter(rs.held, lambda h: h.b IS NULL)) = 0 THEN 'no_active' WHEN list_filter(rs.held, lambda h: h.b IS NULL)[1].t = nq.t THEN 'conflict_holder' WHEN nq.a <= list_filter(rs.held, lambda h: h.b IS NULL)[1].a THEN 'conflict_end' ELSE 'transferred' END
   WHEN len(list_filter(rs.held, lambda h: h.t = nq.t AND h.e = nq.e)) > 0 THEN CASE WHEN list_filter(rs.held, lambda h: h.t = nq.t AND h.e = nq.e)[1].a = nq.a THEN 'replayed' ELSE 'conflict_start' END
   WHEN len(list_filter(rs.held, lambda h: h.t = nq.t AND (h.b IS NULL OR h.b > nq.a) AND (nq.b IS NULL OR h.a < nq.b))) > 0 THEN 'conflict_pair'
   WHEN len(list_filter(rs.held, lambda h: (h.b IS NULL OR h.b > nq.a) AND (nq.b IS NULL OR h.a < nq.b))) > 0 THEN 'conflict_holder' ELSE 'inserted' END AS outcome
  FROM rs JOIN nq ON nq.f = rs.f AND nq.type = rs.type AND nq.g IS NOT DISTINCT FROM rs.g AND nq.i = rs.i + 1))"""


def requests(spark, sf_dir):
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("from_id"), F.when(F.col("o_custkey") % 10 == 9, "owns").when(F.col("o_custkey") % 2 == 0, "assigned_to").otherwise("member_of").alias("type"),
        (k % 3).alias("to_id"), k.alias("event_id"), F.when(k % 5 == 0, "transfer").otherwise("assert").alias("action"), a.alias("valid_from"),
        F.when((k % 4 != 0) & (k % 5 != 0), a + F.expr("interval 30 days")).alias("valid_to"), k.alias("arrival"),
    )
    e = F.col("event_id")
    again = o.where(e % 7 == 0).withColumn("action", F.lit("assert")).withColumn("valid_to", F.col("valid_from") + F.expr("interval 30 days")).withColumn("arrival", e + 10_000_000)
    moved = o.where(e % 11 == 0).withColumn("action", F.lit("assert")).withColumn("valid_from", F.col("valid_from") + F.expr("interval 1 day")).withColumn("valid_to", F.lit(None).cast("timestamp")).withColumn("arrival", e + 20_000_000)
    return o.unionByName(again).unionByName(moved)


@query(f"WITH RECURSIVE {REQUESTS} SELECT f AS from_id, type, t AS to_id, e AS event_id, arrival, outcome FROM rs WHERE i > 0")
def e13_decide_relations(spark, sf_dir):
    return L.decide(requests(spark, sf_dir)).select("from_id", "type", "to_id", "event_id", "arrival", "outcome")


@query(f"""WITH RECURSIVE {REQUESTS}, last AS (SELECT f, type, g, arg_max(held, i) AS held FROM rs GROUP BY ALL), x AS (SELECT f, type, unnest(held) AS h FROM last)
SELECT f AS from_id, type, h.t AS to_id, h.e AS event_id, {T.format('h.a')} AS valid_from, {T.format('h.b')} AS valid_to FROM x""")
def e15_relations_after(spark, sf_dir):
    x = L.accepted(L.decide(requests(spark, sf_dir)))
    return x.select("from_id", "type", "to_id", "event_id", V.text_time(F.col("valid_from")).alias("valid_from"), V.text_time(F.col("valid_to")).alias("valid_to"))
