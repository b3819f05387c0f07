"""References whose target is missing, deleted or only comes later, found with hot keys split off.

References are first reduced to one row per key and period with their number. Keys that hold more than a set
share of them are few by construction. Where the validity intervals of just those keys are within a bound, they
are broadcast; beyond it, both sides are cut into spans of time, so that a hot key meets its intervals in many
tasks. All other keys meet their intervals in a shuffled anti join. Both orphan sets are united, and only orphans
are joined with the owners of the references again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.skew import join_by_key
from verdigris.session import materialise

#: Rows of validity intervals that may be broadcast for hot keys (about 100 bytes each in memory).
BROADCAST_ROWS = 200_000
#: Keys are hot if they hold more than this share of the references.
HEAVY_SHARE = 0.01


def instant(text: Column) -> Column:
    """A time with date, hour and minute in ISO spelling, as its UTC wall clock; otherwise null.

    A blank or ``T`` may stand between date and time, an offset or ``Z`` may follow, and none means UTC.
    """
    text = F.trim(text)
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?) ?(Z|z|[+-]\d{2}:?\d{2})?$"
    local = F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    local = F.when(F.regexp_like(text, F.lit(pattern)), local).try_cast("timestamp_ntz")
    zone = F.regexp_replace(F.regexp_extract(text, pattern, 3), ":", "")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    shift = F.when(zone.startswith("+"), -minutes).when(zone.startswith("-"), minutes).otherwise(F.lit(0))
    return F.timestamp_add("MINUTE", F.coalesce(shift, F.lit(0)), local)


def validity(history: DataFrame, key: str, kind: str, at: str, opening: list[str], order: str | None = None) -> DataFrame:
    """Intervals [valid_from, valid_to) of each key's states, with ``valid`` true after an opening change.

    Exact duplicates count once, arrival order doesn't matter, changes without a key or a time are left
    out; of changes at one instant the one with the highest ``order`` is the last. Neighbours are found inside
    the days of a key first, and then between its days, so that a key's history is never one task's work.
    """
    tie = [F.col(f"`{order}`")] if order else []
    changes = history.select(F.col(f"`{key}`").alias("key"), F.col(f"`{kind}`").alias("kind"), F.col(f"`{at}`").cast("timestamp_ntz").alias("at"), *[t.alias("tie") for t in tie])
    changes = changes.filter("key is not null and at is not null").distinct().withColumn("day", F.col("at").cast("date"))
    inside = Window.partitionBy("key", "day").orderBy("at", *["tie" for _ in tie], "kind")
    between = Window.partitionBy("key").orderBy("day")
    days = changes.groupBy("key", "day").agg(F.min("at").alias("first")).withColumn("next_day", F.lead("first").over(between)).drop("first")
    return (
        changes.withColumn("next", F.lead("at").over(inside))
        .join(days, ["key", "day"])
        .select("key", F.col("at").alias("valid_from"), F.coalesce("next", "next_day").alias("valid_to"), F.coalesce(F.col("kind").isin(*opening), F.lit(False)).alias("valid"))
        .filter("valid_to is null or valid_to > valid_from")
    )


def present_keys(history: DataFrame, registry: DataFrame, key: str, active: str) -> tuple[DataFrame, DataFrame]:
    """(keys open at all times: listed as active and without any change; keys with a row at all)."""
    listed = registry.select(F.col(f"`{key}`").alias("key"), F.col(f"`{active}`").alias("active")).filter("key is not null")
    changed = history.select(F.col(f"`{key}`").alias("key")).distinct()
    always = listed.filter("active").select("key").distinct().join(changed, "key", "left_anti")
    return always, listed.select("key").distinct()


def _without(pairs: DataFrame, valid: DataFrame, span: bool = False) -> DataFrame:
    """The pairs of key and period that lie in no interval of ``valid``."""
    right = valid.select(F.col("key").alias("__key"), F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"), F.col("untimed").alias("__untimed"), *([F.col("span").alias("__span")] if span else []))
    started = F.col("__from").isNull() | (F.col("__from") <= F.col("period"))
    running = F.col("__to").isNull() | (F.col("__to") > F.col("period"))
    timed = F.col("period").isNotNull() & ~F.col("__untimed") & started & running
    same = F.col("key") == F.col("__key")
    if span:
        same = same & F.col("span").eqNullSafe(F.col("__span"))
    return pairs.join(right, same & (timed | (F.col("period").isNull() & F.col("__untimed"))), "left_anti")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def _without_by_span(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """The same where a key has very many intervals: both sides are cut by month, null for references without a time."""
    low, high = pairs.agg(F.min(_month(F.col("period"))), F.max(_month(F.col("period")))).first()  # one row
    first, last = F.greatest(_month(F.col("valid_from")), F.lit(low).cast("int")), F.least(_month(F.col("valid_to")), F.lit(high).cast("int"))
    months = F.when(F.col("untimed"), F.array(F.lit(None).cast("int"))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    cut = valid.withColumn("span", F.explode(months))
    return _without(pairs.withColumn("span", _month(F.col("period"))), cut, True).drop("span")


def orphan_pairs(pairs: DataFrame, intervals: DataFrame, always: DataFrame, listed: DataFrame, heavy_share: float = HEAVY_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``pairs`` (key, period, n_references; one row per key and period) whose key isn't valid at ``period``.

    Where ``period`` is null, a key is an orphan only if it isn't ``listed``. An empty target makes every
    reference an orphan.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    open_rows = (
        intervals.filter("valid")
        .select("key", "valid_from", "valid_to", F.lit(False).alias("untimed"))
        .unionByName(always.select("key", no_time.alias("valid_from"), no_time.alias("valid_to"), F.lit(False).alias("untimed")))
        .unionByName(listed.select("key", no_time.alias("valid_from"), no_time.alias("valid_to"), F.lit(True).alias("untimed")))
    )
    by_key = pairs.groupBy("key").agg(F.sum("n_references").alias("n"))
    total = by_key.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = [r["key"] for r in by_key.filter(F.col("n") > max(1.0, total * heavy_share)).select("key").collect()]  # at most 1 / heavy_share keys
    if not heavy:
        return _without(pairs, open_rows)
    is_heavy = F.col("key").isin(heavy)
    hot, hot_rows = pairs.filter(is_heavy), open_rows.filter(is_heavy)
    small = hot_rows.limit(broadcast_rows + 1).count() <= broadcast_rows
    found = _without(hot, F.broadcast(hot_rows)) if small else _without_by_span(hot, hot_rows)
    return found.unionByName(_without(pairs.filter(~is_heavy), open_rows.filter(~is_heavy)))


def orphans(refs: DataFrame, intervals: DataFrame, always: DataFrame, listed: DataFrame, heavy_share: float = HEAVY_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The distinct rows of ``refs`` (key, period and any owner columns) whose key isn't valid at ``period``.

    Null keys refer to nothing and are left out; a repeated row counts once. Owner columns may have any other name.
    """
    refs, pairs = _reduced(refs)
    found = materialise(orphan_pairs(pairs, intervals, always, listed, heavy_share, broadcast_rows), "orphan-pairs")
    return join_by_key(refs, found.select("key", "period"), ["key", "period"], "left_semi").select(*[F.col(f"`{c}`") for c in refs.columns])


def _reduced(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the stored distinct references, their number per key and period)."""
    refs = materialise(refs.filter("key is not null").distinct(), "references")
    return refs, materialise(refs.groupBy("key", "period").agg(F.count(F.lit(1)).alias("n_references")), "reference-pairs")


def orphan_report(refs: DataFrame, intervals: DataFrame, always: DataFrame, listed: DataFrame, table: str) -> DataFrame:
    """Orphan references and distinct missing keys per table and month; no time gives a null month.

    Works on the counts per key and period alone; owners of references are never joined.
    """
    found = orphan_pairs(_reduced(refs)[1], intervals, always, listed)
    by_key = found.groupBy(F.date_format("period", "yyyy-MM").alias("month"), "key").agg(F.sum("n_references").alias("n"))
    return by_key.groupBy(F.lit(table).alias("table_name"), "month").agg(F.sum("n").alias("orphan_references"), F.count(F.lit(1)).alias("missing_keys"))
