"""Task lists, states and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkloom.constants import STAGE_PROGRESS
from chunkloom.operators import tasks as K
from chunkloom.plans import adapters as A, oracle as O
from chunkloom.plans.catalog import query


@query(O.using("tasks", body="""SELECT 'ingest' AS view, id FROM tasks WHERE contains(type, 'ingest')
  UNION ALL SELECT 'chat', id FROM tasks WHERE contains(type, 'chat')
  UNION ALL SELECT 'failed', id FROM tasks WHERE state IN ('FAILURE', 'FAILED')
  UNION ALL SELECT 'running', id FROM tasks WHERE state NOT IN ('SUCCESS', 'FAILURE', 'FAILED')
  UNION ALL SELECT 'all', id FROM tasks WHERE state = 'PENDING'"""))
def filter_tasks(spark, sf):
    views = K.task_views()
    views["all"] &= F.col("state") == "PENDING"
    return K.in_views(A.tasks(spark, sf), views).select("view", "id")


@query(O.using("tasks", body="""SELECT id, entity_type, entity_id, position::INTEGER AS position FROM (SELECT *,
  row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) AS position FROM tasks) WHERE position <= 20"""))
def filter_tasks_by_entity(spark, sf):
    return K.filter_tasks_by_entity(A.tasks(spark, sf)).select("id", "entity_type", "entity_id", "position")


@query("""SELECT o_orderkey, CASE WHEN s IN ('OK', 'SUCCESS', 'READY', 'HEALTHY') THEN 'ok' WHEN s IN ('FAILURE', 'FAILED', 'ERROR', 'UNHEALTHY') THEN 'error'
    WHEN s IN ('STARTED', 'PROGRESS', 'PROCESSING', 'PENDING', 'UPLOADED') THEN 'warn' ELSE 'muted' END AS tone,
    CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'unknown' END AS service
  FROM (SELECT o_orderkey, upper((['pending', 'Started', 'SUCCESS', 'FAILED', 'other', 'healthy'])[o_orderkey % 6 + 1]) AS s FROM orders)""")
def state_tone(spark, sf):
    i = F.col("o_orderkey")
    state = A.choose(i % 6, "pending", "Started", "SUCCESS", "FAILED", "other", "healthy")
    up = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    return A.table(spark, sf, "orders").select(
        "o_orderkey", K.state_tone(state).alias("tone"), K.service_state(up).alias("service")
    )


@query(O.using("tasks", body="""SELECT task_id, 'remote' AS source, state FROM tasks WHERE id % 3 > 0
  UNION ALL SELECT task_id, 'local', state FROM tasks WHERE id % 3 = 0"""))
def merge_task_lists(spark, sf):
    t = A.tasks(spark, sf).select("id", "task_id", "state")
    remote = t.where(F.col("id") % 3 > 0).select("task_id", F.lit("remote").alias("source"), "state")
    local = t.where((F.col("id") % 2 == 0) | (F.col("id") % 6 == 3)).select("task_id", F.lit("local").alias("source"), "state")
    return K.merge_task_lists(remote, local)


@query(O.using("tasks", body="""SELECT pending, running, failed, pending + running AS queue_depth FROM (SELECT count(*) FILTER (WHERE state = 'PENDING') AS pending,
  count(*) FILTER (WHERE state IN ('STARTED', 'PROGRESS')) AS running, count(*) FILTER (WHERE state IN ('FAILURE', 'FAILED')) AS failed FROM tasks)"""))
def queue_counts(spark, sf):
    return K.queue_counts(A.tasks(spark, sf))


_STAGE_ROWS = ", ".join(
    f"('{kind}', {n}, '{stage}', {at})" for kind, stages in STAGE_PROGRESS.items() for n, (stage, at) in enumerate(stages.items())
)


@query(O.using("tasks", extra=(("stages", f"SELECT * FROM (VALUES {_STAGE_ROWS}) s(type, n, stage, fixed)"),), body="""SELECT type, stage, count(*) AS tasks, any_value(fixed)::INTEGER AS stage_progress
  FROM tasks JOIN stages USING (type) WHERE n = CASE type WHEN 'ingest_document' THEN (id // 3) % 8 WHEN 'chat_generate' THEN (id // 3) % 6 ELSE 0 END GROUP BY type, stage"""))
def progress_stage_counts(spark, sf):
    return K.progress_stage_counts(A.tasks(spark, sf))


@query(O.using("latest_tasks", body="SELECT task_id, state, progress, error FROM latest_tasks"))
def latest_task_state(spark, sf):
    return K.latest_task_state(A.task_updates(spark, sf))


@query(O.using("tasks", body="SELECT id, type, state FROM tasks ORDER BY id DESC LIMIT 100"))
def list_tasks_desc(spark, sf):
    return K.list_tasks_desc(A.tasks(spark, sf), 100).select("id", "type", "state")


@query(O.using("users", body="SELECT id, username, created_at FROM users ORDER BY created_at DESC, id DESC LIMIT 50"))
def latest_users(spark, sf):
    return K.latest_users(A.users(spark, sf), 50)


@query(O.using("tasks", body="""SELECT task_id, CASE WHEN id % 4 = 0 THEN 'SUCCESS' ELSE state END AS state, CASE WHEN id % 4 = 0 THEN 100 ELSE progress END AS progress FROM tasks"""))
def dedup_union_upsert(spark, sf):
    t = A.tasks(spark, sf)
    new = t.where(F.col("id") % 4 == 0).select("task_id", F.lit("SUCCESS").alias("state"), F.lit(100).alias("progress"))
    return K.dedup_union_upsert(new, t.select("task_id", "state", "progress"), "task_id")
