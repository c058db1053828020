"""Activity feeds as bounded DataFrames: ingest, history, replay, filters, take, and waiting for a condition.

Events have a sequence number, ``seq``; it, not the timestamp, is the order. A feed is a filter on ``seq``: history is the newest
256 events up to the moment of subscription, the live part is what comes after. History is cut before any other filter, across
all entities. One sort limit serves it; no window over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 256
CALL, READ, WRITE, CLEAR = "GrainCall", "StorageRead", "StorageWrite", "StorageClear"
STORAGE = "struct<kind:string,entity_id:string,store:string,state_name:string,etag:string,state:string>"
CALLED = "struct<target_id:string,method:string,interface:string>"


def activity_kind(operation: Column) -> Column:
    """Kind of the event that a storage operation (read, write, clear) gives, or a call."""
    return F.when(operation == "read", READ).when(operation == "write", WRITE).when(operation == "clear", CLEAR).otherwise(CALL)


def ingest(raw: DataFrame, operation: str = "operation", entity: str = "entity_id", interface: str | None = None, system_prefix: str | None = None, succeeded: str | None = None, suppressed: str | None = None) -> DataFrame:
    """Events of an operation log. Storage operations count if they succeed, calls also if they fail; calls of interfaces
    under ``system_prefix``, and whatever happens inside an assertion, don't."""
    kind = activity_kind(F.col(operation))
    keep = F.lit(True)
    if suppressed:
        keep = keep & ~F.coalesce(F.col(suppressed), F.lit(False))
    if succeeded:
        keep = keep & ((kind == CALL) | F.coalesce(F.col(succeeded), F.lit(False)))
    if interface and system_prefix:
        keep = keep & ((kind != CALL) | ~F.coalesce(F.col(interface).startswith(system_prefix), F.lit(False)))
    return raw.where(keep).withColumns({"kind": kind, "entity_id": F.col(entity).cast("string")})


def stores(*feeds: tuple[str, DataFrame], known: set[str] | None = None) -> DataFrame:
    """Union of the feeds of named stores. A name given twice counts once; an unknown one is an error."""
    chosen: dict[str, DataFrame] = {}
    for name, df in feeds:
        if known is not None and name not in known:
            raise KeyError(f"No store is registered under the name '{name}'.")
        chosen.setdefault(name, df.withColumn("store", F.lit(name)))
    if not chosen:
        raise ValueError("at least one store is needed")
    first, *rest = chosen.values()
    for df in rest:
        first = first.unionByName(df)
    return first


def history(events: DataFrame, until: int | None = None, size: int = HISTORY) -> DataFrame:
    """The newest events up to ``until``."""
    seen = events if until is None else events.where(F.col("seq") <= until)
    return seen.orderBy(F.col("seq").desc()).limit(size)


def feed(events: DataFrame, subscribed_at: int, replay: bool = False, size: int = HISTORY) -> DataFrame:
    """What a subscriber from ``subscribed_at`` on sees: later events and, with ``replay``, the history before them."""
    live = events.where(F.col("seq") > subscribed_at)
    return history(events, subscribed_at, size).unionByName(live) if replay else live


def storage_operations(activities: DataFrame, entity: str | None = None) -> DataFrame:
    """Storage details, of one entity if given."""
    rows = activities.where(F.col("storage").isNotNull())
    return (rows if entity is None else rows.where(F.col("entity_id") == entity)).select("seq", "storage.*")


def calls(activities: DataFrame, target: str | None = None) -> DataFrame:
    """Call details, of one called entity if given."""
    rows = activities.where(F.col("call").isNotNull())
    return (rows if target is None else rows.where(F.col("call.target_id") == target)).select("seq", "entity_id", "call.*")


def take(activities: DataFrame, count: int) -> DataFrame:
    """The first ``count`` events."""
    return activities.orderBy("seq").limit(count)


def take_per_entity(activities: DataFrame, count: int) -> DataFrame:
    """The first ``count`` events of each entity; ranks are limited before the shuffle."""
    order = Window.partitionBy("entity_id").orderBy("seq")
    return activities.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count).drop("_n")


def first_when(activities: DataFrame, state: Column, holds) -> DataFrame:
    """For each entity the first event at which a condition on the running sum of ``state`` holds, with the number of attempts.

    A waiter tries once at the start and again at every event; its attempts are the events up to success, and one.
    """
    order = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = activities.withColumns({"state": F.sum(state).over(order), "attempts": F.count("*").over(order) + 1})
    hit = ran.where(holds(F.col("state")))
    return hit.groupBy("entity_id").agg(F.min("seq").alias("seq"), F.min("attempts").alias("attempts"))
