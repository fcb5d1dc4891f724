"""Attribution of event roles to entities over validity intervals, by a bucketed interval join.

An identifier's timeline, from its first start to its last time, is cut into as many
equal blocks as it has ``per_block`` intervals; an interval lies in each block that it
touches, an event in one.  The join is on (identifier, block), so an identifier with
very many intervals and events costs about their sum: each event meets the intervals
of its own block only, and a hot identifier is spread over its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.entities import in_interval

# Reasons of roles that aren't resolved.
NO_IDENTIFIERS = "no_identifiers"
INVALID = "identifier_invalid"
UNREGISTERED = "identity_space_unregistered"
NO_MATCH = "no_matching_entity"
NOT_ACTIVE = "no_active_occurrence_at_event_time"
CONFLICT = "strong_weak_conflict"
SEVERAL = "multiple_active_candidates"
FAILED = "registration_failed"


def _second(t: Column) -> Column:
    return F.unix_seconds(t.cast("timestamp"))


def blocks_of(intervals: DataFrame, key: list[str], per_block: int = 32) -> DataFrame:
    """For each key: how many intervals, the first start, the width of a block in seconds and the last block."""
    start, end = _second(F.col("valid_from")), _second(F.coalesce("valid_to", "valid_from"))
    x = intervals.groupBy(*key).agg(F.count(F.lit(1)).alias("known"), F.min(start).alias("_first"), F.max(F.greatest(start, end)).alias("_last"))
    width = F.greatest(F.lit(1), F.ceil((F.col("_last") - F.col("_first") + 1) * per_block / F.col("known")))
    return x.withColumn("_width", width.cast("long")).withColumn("_top", F.expr("(_last - _first) div _width")).drop("_last")


def block(t: Column) -> Column:
    """The block of a time, within those of its key."""
    return F.greatest(F.lit(0), F.least(F.col("_top"), F.floor((_second(t) - F.col("_first")) / F.col("_width")))).cast("long")


def in_blocks(intervals: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """intervals with ``_block``: a row for each block that an interval touches."""
    last = F.when(F.col("valid_to").isNull(), F.col("_top")).otherwise(block(F.col("valid_to")))
    x = intervals.join(blocks, key).withColumn("_block", F.explode(F.sequence(block(F.col("valid_from")), F.greatest(block(F.col("valid_from")), last))))
    return x.drop("known", "_first", "_width", "_top")


def interval_join(events: DataFrame, intervals: DataFrame, key: list[str], at: str, how: str = "inner", per_block: int = 32) -> DataFrame:
    """events with the intervals(valid_from, valid_to, ...) of their key that hold at their time; ``known``: how many the key has.

    With how="left", events that no interval holds stay, once, with nulls.  A null key
    or time meets nothing.
    """
    blocks = blocks_of(intervals, key, per_block)
    own = events.join(blocks, key, how).withColumn("_block", F.coalesce(block(F.col(at)), F.lit(0))).drop("_first", "_width", "_top")
    parts = in_blocks(intervals, blocks, key).withColumnsRenamed({c: f"_r_{c}" for c in [*key, "_block"]})
    same = reduce(lambda a, b: a & b, [own[c] == parts[f"_r_{c}"] for c in [*key, "_block"]]) & in_interval(F.col(at))
    got = own.join(parts, same, how).drop("_block", *[f"_r_{c}" for c in [*key, "_block"]])
    return got.withColumn("known", F.coalesce("known", F.lit(0)))


def adjudicate(roles: DataFrame, entities: DataFrame, key: list[str], role_key: list[str], at: str) -> DataFrame:
    """State of each role: resolved by one candidate (1.0 strong, 0.8 weak), ambiguous by several, unresolved by none.

    roles has a row for each identifier of a role; entities(key, entity_id, strong,
    valid_from, valid_to).  A role without identifiers has one row with a null key and
    ``identified`` false, one whose identifier is invalid a null key and ``valid`` false
    (both columns may be absent); ``failure`` forces a role unresolved for that reason.
    """
    for name, value in (("identified", F.lit(True)), ("valid", F.lit(True)), ("failure", F.lit(None).cast("string"))):
        if name not in roles.columns:
            roles = roles.withColumn(name, value)
    c = interval_join(roles, entities, key, at, "left")
    hit = F.when(F.col("entity_id").isNotNull() & F.col("failure").isNull(), F.struct("entity_id", "strong", "valid_from", "valid_to"))
    g = c.groupBy(*role_key).agg(
        F.array_sort(F.array_distinct(F.collect_list(hit["entity_id"]))).alias("candidates"), F.max(hit["strong"]).alias("any_strong"), F.min(hit["strong"]).alias("all_strong"),
        F.max_by(hit, hit["valid_from"]).alias("one"), F.max("known").alias("known"), F.max("identified").alias("identified"), F.max(F.col("identified") & F.col("valid")).alias("valid"), F.max("failure").alias("failure"),
        # sets of a role's few identifiers; two distinct counts would write each row three times
        F.size(F.collect_set(F.when(F.col("valid") & F.col("identified"), F.struct(*key)))).alias("identifiers"), F.size(F.collect_set(F.when(hit.isNotNull(), F.struct(*key)))).alias("agree"),
    )
    n = F.size("candidates")
    reason = (
        F.when(F.col("failure").isNotNull(), F.col("failure")).when(~F.col("identified"), NO_IDENTIFIERS).when(~F.col("valid"), INVALID)
        .when(n > 1, F.when(F.col("any_strong") != F.col("all_strong"), CONFLICT).otherwise(SEVERAL))
        .when(n == 0, F.when(F.col("known") > 0, NOT_ACTIVE).otherwise(NO_MATCH))
    )
    state = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    said = lambda test, text: F.when(test, F.lit(text))
    sure = n == 1
    trail = F.array_compact(F.array(
        said(F.col("failure") == UNREGISTERED, "lookup_skipped:identity_space_unregistered"), said(F.col("failure") == FAILED, "registration_failed_role_forced_unresolved"),
        said(F.col("failure").isNull() & ~F.col("identified"), "no_identifiers_reported"), said(F.col("failure").isNull() & F.col("identified") & ~F.col("valid"), "all_identifiers_failed_normalization"),
        said(reason == NOT_ACTIVE, "occurrences_exist_but_none_covers_event_time"), said(reason == NO_MATCH, "no_registered_entity_matches"),
        said(sure & F.col("any_strong"), "resolved_by_strong_identifier"), said(sure & F.col("any_strong") & (F.col("identifiers") > 1), "strong_identifier_priority_over_weak"),
        said(sure & ~F.col("any_strong"), "resolved_by_weak_identifier_occurrence_at_event_time"), said(sure & (F.col("agree") > 1), "multiple_identifiers_agree"),
        said(reason == CONFLICT, "strong_and_weak_identifiers_resolve_to_different_entities"), said(reason == SEVERAL, "multiple_active_candidates_at_event_time"), said(n > 1, "candidates_preserved_not_overwritten"),
    ))
    confidence = F.when(sure, F.when(F.col("any_strong"), 1.0).otherwise(0.8)).otherwise(0.0)
    one = lambda c: F.when(sure, F.col("one")[c]).alias(c)
    return g.select(*role_key, state.alias("state"), reason.alias("reason"), one("entity_id"), confidence.alias("confidence"), one("valid_from"), one("valid_to"), "candidates", trail.alias("trail"))
