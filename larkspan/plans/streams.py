"""Streams as queries, each beside the DuckDB SQL of what it comes to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.plans.registry import query
from larkspan.sources import adapters as A
from larkspan.sources.shared import shared_folder
from larkspan.streaming import metrics as S
from larkspan.streaming import state as T


@query("", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    t = S.finished(S.tumbling_counts(S.event_stream(spark, d)))
    return t.select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_timestamp("start") / 86400).cast("int")).cast("string").alias("day"), "event_type", "n", "cents")


@query("", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return S.finished(S.latest_states(S.event_stream(spark, d)))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


# Events that the watermark has passed, a day behind the last one.
_PASSED = "w AS (SELECT epoch_us(max(ts)) // 1000 - 86400000 AS mark FROM events)"


@query("", f"""WITH {_PASSED}, e AS (SELECT epoch_us(ts) // 1000 AS ms, CAST(round((value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id), 0)) * 100) AS BIGINT) AS cents FROM events),
 d AS (SELECT CAST(ms // 86400000 AS BIGINT) AS day, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM e, w WHERE ms <= mark GROUP BY ALL) SELECT day, n, cents, CAST(sum(cents) OVER (ORDER BY day) AS BIGINT) AS readiness FROM d""")
def stream_running_readiness(spark: SparkSession, d: str) -> DataFrame:
    """The sum of all projects' latest values at the end of each day, from the changes of each project in event order."""
    changes = T.drained(T.changes_in_order(S.event_stream(spark, d)), _folder(spark))
    days = changes.groupBy(F.floor(F.col("ms") / 86_400_000).cast("long").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("change") * 100).cast("long")).alias("cents"))
    return days.selectExpr("day", "n", "cents", "sum(cents) OVER (ORDER BY day) AS readiness")  # one row a day


@query("", f"""WITH {_PASSED}, e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, max(event_id) AS event_id FROM events GROUP BY ALL)
 SELECT user_id, ms, event_id, ms + 86400000 AS expired_ms FROM e, w WHERE ms + 86400000 <= mark AND NOT EXISTS (SELECT 1 FROM e n WHERE n.user_id = e.user_id AND n.ms > e.ms AND n.ms <= e.ms + 86400000)""")
def stream_expired_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that a key has not renewed for a day."""
    return T.drained(T.expired_entries(S.event_stream(spark, d), days=1), _folder(spark))


@query("", """WITH c AS (SELECT l_partkey AS spec_id, l_suppkey AS offer_id, max(CAST(100 - floor(l_discount * 100 + 0.5) - 5 * (l_linenumber % 8) AS INT)) AS confidence FROM lineitem GROUP BY ALL),
 settled AS (SELECT DISTINCT l_partkey AS spec_id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 29 = 0)
 SELECT spec_id, offer_id, confidence, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY confidence DESC, offer_id) AS INT) AS rank FROM c WHERE spec_id IN (SELECT user_id FROM events) AND spec_id NOT IN (SELECT spec_id FROM settled)""")
def stream_unsettled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the specs that events name, batch by batch, without those that are confirmed."""
    lines = A.items(spark, d)
    links = lines.selectExpr("spec_id", "CAST(l_returnflag = 'R' AND invoice_id % 29 = 0 AS INT) AS is_confirmed")
    offers = lines.selectExpr("spec_id", "supplier_id AS offer_id", "CAST(100 - floor(l_discount * 100 + 0.5) - 5 * (row_index % 8) AS INT) AS confidence").groupBy("spec_id", "offer_id").agg(F.max("confidence").alias("confidence"))
    named = S.event_stream(spark, d).selectExpr("user_id AS spec_id")
    return T.drained(named, _folder(spark), T.unsettled(links, offers)).distinct()
