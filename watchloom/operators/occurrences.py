"""Closing, listing and looking up entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transfer_weak(entities: DataFrame, requests: DataFrame, order: list[str]) -> DataFrame:
    """Outcome of each request(key, at, ...) to close the open occurrence of a weak identity.

    strong_refused; no_active_occurrence, also after an earlier request has closed it;
    invalid_end, if at is not after the start; closed.  entities has one row a key with
    strong, valid_from, valid_to.  Requests of a key are taken in order.
    """
    e = entities.select("key", "strong", F.col("valid_to").isNull().alias("_open"), F.col("valid_from").alias("_from"))
    x = requests.join(e, "key", "left")
    ok = F.coalesce(~F.col("strong") & F.col("_open") & (F.col("at") > F.col("_from")), F.lit(False))
    before = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    gone = ~F.coalesce("_open", F.lit(False)) | F.coalesce(F.max(ok).over(before), F.lit(False))
    outcome = F.when(F.col("strong"), "strong_refused").when(gone, "no_active_occurrence").when(ok, "closed").otherwise("invalid_end")
    return x.withColumn("outcome", outcome).drop("strong", "_open", "_from")


def close_relations(relations: DataFrame, requests: DataFrame, order: list[str], task_rows: int = 1_000_000) -> DataFrame:
    """Outcome of each request(relation_id, at, ...): missing, unchanged (closed at that time), conflict, invalid_end or closed.

    A task joins and orders some task_rows requests, in three sorts that are held at once, however many there are in all.
    """
    n = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // task_rows))
    r = relations.select("relation_id", F.lit(True).alias("_there"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    x = requests.repartition(n, "relation_id").join(r.repartition(n, "relation_id"), "relation_id", "left")
    ok = F.col("_to").isNull() & (F.col("at") > F.col("_from"))
    before = Window.partitionBy("relation_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("_to", F.first(F.when(ok, F.col("at")), ignorenulls=True).over(before))
    outcome = F.when(F.col("_there").isNull(), "missing").when(end == F.col("at"), "unchanged").when(end.isNotNull(), "conflict").when(ok, "closed").otherwise("invalid_end")
    return x.withColumn("outcome", outcome).drop("_there", "_from", "_to")


def list_relations(relations: DataFrame, entity: str, most: int = 200) -> DataFrame:
    """The relations of each entity, open ones first, then the newest; place from 1 to most."""
    w = Window.partitionBy(entity).orderBy(F.col("valid_to").isNull().desc(), F.desc("valid_from"), "relation_id")
    return relations.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def search_entities(entities: DataFrame, part: str, entity_type: str | None, after: tuple | None, n: int) -> DataFrame:
    """A page of the entities whose key holds the text, by (canonical_key, entity_id) after the given pair."""
    x = entities.where(F.col("canonical_key").contains(part))
    if entity_type is not None:
        x = x.where(F.col("entity_type") == entity_type)
    if after is not None:
        x = x.where((F.col("canonical_key") > after[0]) | ((F.col("canonical_key") == after[0]) & (F.col("entity_id") > after[1])))
    return x.orderBy("canonical_key", "entity_id").limit(n)


def entity_detail(entities: DataFrame, attributions: DataFrame, time: str, key: str, most: int = 5) -> DataFrame:
    """Each entity with its latest attributions, newest first; none is an empty list."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(time), F.desc(key))
    last = attributions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    lists = last.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(key).alias("k")))), lambda x: x["k"]).alias("latest"))
    return entities.join(lists, "entity_id", "left").withColumn("latest", F.coalesce("latest", F.array().cast(lists.schema["latest"].dataType)))


def require_registered(relations: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of relations(entity_id, rule_version): entity_missing, rule_missing or ok."""
    known = entities.select("entity_id", F.lit(True).alias("_e")).dropDuplicates(["entity_id"])
    stored = rules.select("rule_version", F.lit(True).alias("_r")).dropDuplicates(["rule_version"])
    x = relations.join(known, "entity_id", "left").join(stored, "rule_version", "left")
    return x.withColumn("outcome", F.when(F.col("_e").isNull(), "entity_missing").when(F.col("_r").isNull(), "rule_missing").otherwise("ok")).drop("_e", "_r")
