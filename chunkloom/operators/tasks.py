"""Task lists, latest state and queue figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chunkloom import constants as K
from chunkloom.operators.ranking import last_per_key, top_n


def task_views() -> dict[str, Column]:
    return {
        "all": F.lit(True),
        "ingest": F.contains(F.col("type"), F.lit("ingest")),
        "chat": F.contains(F.col("type"), F.lit("chat")),
        "failed": F.col("state").isin(*K.FAILED_STATES),
        "running": ~F.col("state").isin(*K.TERMINAL_STATES),
    }


def filter_tasks(tasks: DataFrame, view: str, state: str | None = None) -> DataFrame:
    rows = tasks.where(task_views()[view])
    return rows.where(F.col("state") == state) if state else rows


def in_views(rows: DataFrame, views: dict[str, Column]) -> DataFrame:
    """Each row once for each view that it is in, with the view's name as ``view``; the rows are read once, however many views there are."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(v)) for v, c in views.items()]))
    return rows.withColumn("view", F.explode(names))


def filter_tasks_by_entity(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """Newest tasks of each entity."""
    return top_n(tasks, ["entity_type", "entity_id"], [F.desc("id")], limit, "position")


def list_tasks_desc(tasks: DataFrame, limit: int = 50, state: str | None = None) -> DataFrame:
    rows = tasks.where(F.col("state") == state) if state else tasks
    return rows.orderBy(F.desc("id")).limit(limit)


def queue_counts(tasks: DataFrame) -> DataFrame:
    state = F.col("state")
    counted = tasks.agg(
        F.count_if(state == "PENDING").alias("pending"),
        F.count_if(state.isin(*K.RUNNING_STATES)).alias("running"),
        F.count_if(state.isin(*K.FAILED_STATES)).alias("failed"),
    )
    return counted.withColumn("queue_depth", F.col("pending") + F.col("running"))


def task_totals(tasks: DataFrame) -> DataFrame:
    state = F.col("state")
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        F.count_if(~state.isin(*K.TERMINAL_STATES)).alias("running_tasks"),
        F.count_if(state.isin(*K.FAILED_STATES)).alias("failed_tasks"),
        F.count_if(state == "SUCCESS").alias("success_tasks"),
    )


def latest_non_null(column: str, version: str) -> Column:
    value = F.col(column)
    return F.max_by(value, F.when(value.isNotNull(), F.col(version))).alias(column)


def latest_task_state(updates: DataFrame, key: str = "task_id", version: str = "seq") -> DataFrame:
    """Latest value of each field that an update really set."""
    fields = [c for c in updates.columns if c not in (key, version)]
    return updates.groupBy(key).agg(*[latest_non_null(c, version) for c in fields])


def merge_task_lists(remote: DataFrame, local: DataFrame, key: str = "task_id") -> DataFrame:
    """Remote rows win; local rows the server does not know stay."""
    return remote.unionByName(local.join(remote.select(key), key, "left_anti"), allowMissingColumns=True)


def dedup_union_upsert(new: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """New rows first; current rows of the same key drop out."""
    both = new.withColumn("_new", F.lit(1)).unionByName(current.withColumn("_new", F.lit(0)))
    return last_per_key(both, [key], F.col("_new")).drop("_new")


def state_tone(state: Column) -> Column:
    upper = F.upper(F.coalesce(state, F.lit("")))
    return (
        F.when(upper.isin(*K.TONE_OK), F.lit("ok"))
        .when(upper.isin(*K.TONE_ERROR), F.lit("error"))
        .when(upper.isin(*K.TONE_WARN), F.lit("warn"))
        .otherwise(F.lit("muted"))
    )


def service_state(ok: Column) -> Column:
    return F.when(ok, F.lit("ok")).when(~ok, F.lit("error")).otherwise(F.lit("unknown"))


def progress_stage_counts(tasks: DataFrame) -> DataFrame:
    """Tasks per type and stage (from the meta JSON) with the fixed progress of that stage."""
    fixed = {f"{kind}/{stage}": at for kind, stages in K.STAGE_PROGRESS.items() for stage, at in stages.items()}
    lookup = F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair])
    stage = F.get_json_object("meta_json", "$.stage")
    counted = tasks.groupBy("type", stage.alias("stage")).agg(F.count("*").alias("tasks"))
    return counted.withColumn("stage_progress", F.try_element_at(lookup, F.concat_ws("/", "type", "stage")))


def latest_users(users: DataFrame, limit: int = 20) -> DataFrame:
    return users.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
