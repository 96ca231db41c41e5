"""Streams, task queues, quorums and personal data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talweg.operators import parts, pii
from talweg.plans.registry import query
from talweg.sources.tables import table
from talweg.streaming import events, waits

C = F.col


@query("stm_01_task_queue")
def _(spark, d):
    """Each user's tasks through a queue of two slots and twenty waiting."""
    tasks = table(spark, d, "events").where("user_id is not null").select("user_id", "event_id", F.unix_timestamp(C("ts").cast("timestamp")).cast("double").alias("at"), (C("value") * 3600).alias("seconds"))
    return events.queue_outcomes(tasks)


@query("stm_02_distinct_calls", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    """Calls coalesced by key, as a stream; the delay spans the whole log, so each key is seen once."""
    return events.drained(events.distinct_events(events.event_stream(spark, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "distinct")


@query("stm_03_replays", "SELECT user_id, least(count(*), 5) AS attempts, count(*) >= 5 AS given_up FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, d):
    """Attempts of what failed, given up at the fifth."""
    return table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("attempts"), (F.count(F.lit(1)) >= 5).alias("given_up"))


@query("stm_04_last_progress", "SELECT user_id, last(event_type ORDER BY ts, event_id) AS state FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("stm_05_quorum", "SELECT l_orderkey, max(l_quantity) FILTER (k <= greatest(2, n - 1)) AS last_awaited FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1")
def _(spark, d):
    """Answers awaited in order of arrival, until all but one, two at least, are there."""
    w = Window.partitionBy("l_orderkey")
    ranked = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.row_number().over(w.orderBy("l_quantity", "l_linenumber")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return ranked.groupBy("l_orderkey").agg(F.max(F.when(C("k") <= F.greatest(F.lit(2), C("n") - 1), C("l_quantity"))).alias("last_awaited"))


@query("stm_06_cascade", "SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag <> 'R') AS answered_by FROM lineitem GROUP BY 1")
def _(spark, d):
    """The first valid answer by order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(C("l_returnflag") != "R", C("l_linenumber"))).alias("answered_by"))


_HOUR, _DAY = 3_600_000, 86_400_000
_QUORUM = f"""WITH a AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS asked, epoch_us(ts) // 1000 - epoch_us(date_trunc('day', ts)) // 1000 AS ms, epoch_us(date_trunc('day', ts)) // 1000 AS day FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, asked ORDER BY ms) AS k FROM a),
 t AS (SELECT user_id, asked, any_value(day) AS day, least({18 * _HOUR}, coalesce(min(ms) FILTER (k = 2) + {2 * _HOUR}, {18 * _HOUR})) AS due, coalesce(min(ms) FILTER (k = 2) + {2 * _HOUR} <= {18 * _HOUR}, false) AS agreed FROM r GROUP BY 1, 2),
 c AS (SELECT user_id, asked, day, due, agreed, count(*) FILTER (k <= 3 AND ms <= due) AS answers, max(ms) FILTER (k = 3 AND ms <= due) AS third FROM r JOIN t USING (user_id, asked, day) GROUP BY ALL)
SELECT user_id, asked, CASE WHEN third IS NOT NULL THEN 'all' WHEN agreed THEN 'quorum' ELSE 'time' END AS ended_by, answers, coalesce(third, due) AS waited
FROM c WHERE day + coalesce(third, due) < (SELECT epoch_us(max(ts)) // 1000 FROM events WHERE user_id IS NOT NULL) - {_HOUR}"""


@query("stm_05_quorum_in_time", _QUORUM)
def _(spark, d):
    """Three answers of a user a day, as a stream: all, or two and two hours of grace, or what has come after 18 hours."""
    answers = events.event_stream(spark, d).withColumn("asked", F.date_trunc("day", "ts"))
    ended = waits.quorum_waits(answers, ["user_id"], "asked", "ts", 3, 2 * _HOUR, 18 * _HOUR, _DAY, "1 hour")
    return events.drained(ended.withColumn("asked", C("asked").cast("timestamp_ntz")), "quorum")


_CASCADE = """WITH n AS (SELECT l_orderkey, l_linenumber, l_quantity AS needs, l_returnflag <> 'R' AS valid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag <> 'R') AS k FROM lineitem),
 a AS (SELECT *, 60 - coalesce(sum(least(needs, 40)) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM n),
 b AS (SELECT *, rest >= 5 AS tried, rest >= 5 AND valid AND needs <= least(40, rest) AS good FROM a),
 f AS (SELECT l_orderkey, min(k) FILTER (good) AS first, min(k) FILTER (NOT tried) AS cut FROM b GROUP BY 1)
SELECT l_orderkey, any_value(l_linenumber) FILTER (k = first) AS answered_by, count(*) FILTER (tried AND k <= coalesce(first, k)) AS attempts,
 CASE WHEN any_value(first) IS NOT NULL THEN 'answered' WHEN any_value(cut) IS NOT NULL THEN 'out of time' ELSE 'failed' END AS outcome,
 sum(least(needs, 40, rest)) FILTER (tried AND k <= coalesce(first, k)) AS seconds FROM b JOIN f USING (l_orderkey) GROUP BY 1"""


@query("stm_06_cascade_in_time", _CASCADE)
def _(spark, d):
    """Services asked one after the other: each gets 40 seconds, all together 60, and none is begun with less than 5 left; the first valid answer ends it."""
    calls = table(spark, d, "lineitem").select("l_orderkey", C("l_linenumber").alias("k"), C("l_quantity").cast("double").alias("needs"), (C("l_returnflag") != "R").alias("valid"))
    return waits.cascades(calls, ["l_orderkey"], "k", "needs", "valid", 40.0, 60.0)


@query("stm_08_closed_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2")
def _(spark, d):
    """Events by day and kind, as a stream in append mode: days that are over."""
    return events.drained(events.closed_windows(events.event_stream(spark, d)), "windows")


@query("pii_01_spans")
def _(spark, d):
    """Personal data in all documents, with the masked text's digest."""
    return pii.detected(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "spans", F.sha2("masked", 256).alias("masked_sha256"))


def first_names(spark, d):
    """name: the one-word names of nations stand for a dictionary of first names, which the tables lack; it doesn't grow with them."""
    return table(spark, d, "nation").select(C("n_name").alias("name")).where("name NOT LIKE '% %'")


@query("pii_06_lines")
def _(spark, d):
    """Personal data in all lines of all documents, with its surroundings: what one line tells is known in the lines after it."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return parts.detected(lines, "doc_id", "line", "text", first_names(spark, d)).where(F.size("detections") > 0).select("doc_id", "line", "detections", F.sha2("masked", 256).alias("masked_sha256"))


@query("pii_06_conversations")
def _(spark, d):
    """Personal data in all turns: a person named in one turn is known in the turns after it."""
    found = parts.detected(table(spark, d, "conversations"), "conv_id", "turn", "text", first_names(spark, d))
    return found.select("conv_id", "turn", F.size("detections").alias("n"), F.sha2("masked", 256).alias("masked_sha256"))


@query("pii_07_references", "SELECT sha256(text) AS fingerprint, min(doc_id) AS first, max(doc_id) AS last, count(*) AS passes FROM documents GROUP BY 1")
def _(spark, d):
    """A known fingerprint passes once more, a new one begins."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("fingerprint")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("passes"))
