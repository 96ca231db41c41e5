"""Waiting for answers to a question, in event time: all of them, or a quorum and a grace, or a limit.

A question is a key and the moment at which it was asked. Its wait ends with the `n`-th answer, or `grace` after the
quorum (all but one, two at least), or `limit` after it was asked, whichever is first; answers that come later, or after
the n-th, do not count. A wait is told once no answer can change it: when the watermark has passed its end.

The state of a question is its `n` earliest answers and whether it was told, so it is bounded whatever the order and number
of the rows. Python is called for `BUCKETS` groups of questions in each span of the horizon, not for each question, which costs
some milliseconds a call; a group's state is that of its questions, and grows with them. A timer of the event time tells those
whose wait is over and, once the watermark has passed all moments that a question may have, removes it. Answers that come out of order within the watermark's delay give the same result as in order; those beyond the
delay are dropped by Spark. A restarted stream goes on from its checkpoint.

Moments are whole milliseconds. Rows without a moment, an asked moment or any part of the key belong to no question;
rows that repeat are answers of their own; an empty stream tells nothing.

A cascade asks one service after the other within a budget of time (`cascades`, of batches).
"""

from __future__ import annotations

import pickle
from bisect import insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


BUCKETS = 64


def wait_end(asked: int, answers: list[int], n: int, grace: int, limit: int) -> tuple[int, str, int]:
    """(end, why, answers that count) for the earliest answers, in order."""
    last = asked + limit
    quorum = max(2, n - 1)
    why, end = "time", last
    if len(answers) >= quorum and answers[quorum - 1] + grace <= last:
        why, end = "quorum", answers[quorum - 1] + grace
    if len(answers) >= n and answers[n - 1] <= end:
        why, end = "all", answers[n - 1]
    return end, why, sum(a <= end for a in answers[:n])


def _values(column: pd.Series) -> list:
    """The values of a column; NaN, which equals nothing, as None."""
    return [v if v == v else None for v in column.tolist()]


def quorum_waits(stream: DataFrame, key: list[str], asked: str, at: str, n: int, grace: int, limit: int, horizon: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """key, asked, ended_by (all, quorum, time), answers, waited (ms) of each wait that is over, as a stream.

    `at` is the moment of an answer and `asked` that of its question; grace, limit and `horizon` (after which a question has
    no more rows) are milliseconds, `limit` at most `horizon`. Keys are plain values (no arrays)."""
    if not 0 <= limit <= horizon:
        raise ValueError("the limit must lie within the horizon")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, asked, at]])
    rows = stream.where(known).withWatermark(at, delay).select(*key, asked, at, F.unix_millis(asked).alias("asked_ms"), F.unix_millis(at).alias("at_ms"))

    def each(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        questions = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for b in batches:
                for question, ms in zip(zip(*(_values(b[c]) for c in (*key, "asked_ms")), strict=True), b["at_ms"].tolist(), strict=True):
                    answers, _ = questions.setdefault(question, ([], False))
                    if len(answers) < n or ms < answers[-1]:
                        insort(answers, ms)
                        del answers[n:]
        now, out, due = state.getCurrentWatermarkMs(), [], None
        for question, (answers, told) in list(questions.items()):
            gone = question[-1] + horizon
            if not told:
                end, why, count = wait_end(question[-1], answers, n, grace, limit)
                if told := end < now:
                    out.append((*question, why, count, end - question[-1]))
                    questions[question] = answers, told
            if told and gone < now:
                del questions[question]
                continue
            next_due = gone if told else end
            due = next_due if due is None else min(due, next_due)
        if questions:
            state.update((pickle.dumps(questions),))
            state.setTimeoutTimestamp(max(due, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    fields = [*(rows.schema[c] for c in key), T.StructField("asked_ms", T.LongType())]
    out = T.StructType([*fields, *T.StructType.fromDDL("ended_by string, answers long, waited long").fields])
    names = out.names
    kept = T.StructType.fromDDL("questions binary")
    rows = rows.withColumns({"_span": F.floor(F.col("asked_ms") / max(horizon, 1)), "_bucket": F.pmod(F.xxhash64(*key, "asked_ms"), F.lit(buckets))})
    found = rows.groupBy("_span", "_bucket").applyInPandasWithState(each, out, kept, "append", "EventTimeTimeout")
    return found.select(*key, F.timestamp_millis("asked_ms").alias(asked), "ended_by", "answers", "waited")


def cascades(calls: DataFrame, key: list[str], order: str, needs: str, valid: str, most: float, budget: float, least: float = 5.0) -> DataFrame:
    """key, answered_by, attempts, outcome (answered, failed, out of time), seconds of each cascade of calls.

    A call takes the seconds it `needs`, but at most `most` and what is left of the budget; with less than `least` left no
    further one is begun. The first that is valid and in time answers. Null needs are an answer that never comes, null
    `valid` is false; calls of equal order follow by needs and validity. The rows of one key meet in one task: a chain of
    services is short.
    """
    rows = calls.select(*key, F.col(order).alias("k"), F.coalesce(F.col(needs), F.lit(float("inf"))).alias("needs"), F.coalesce(F.col(valid), F.lit(False)).alias("valid"))
    w = Window.partitionBy(*key).orderBy("k", "needs", "valid")
    spent = F.coalesce(F.sum(F.least("needs", F.lit(most))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.select(*key, "k", "valid", "needs", (F.lit(budget) - spent).alias("rest"), F.row_number().over(w).alias("step")).where(F.col("rest") >= least)
    good = F.col("valid") & (F.col("needs") <= F.least(F.lit(most), F.col("rest")))
    taken = F.least("needs", F.lit(most), "rest")
    before = F.coalesce(F.max(good).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    left = rows.select("*", good.alias("good"), taken.alias("taken"), before.alias("over")).where(~F.col("over"))
    ended = left.groupBy(*key).agg(F.max(F.when(F.col("good"), F.col("k"))).alias("answered_by"), F.count(F.lit(1)).alias("attempts"), F.sum("taken").alias("seconds"), F.bool_or("good").alias("answered"))
    asked = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("services"))
    outcome = F.when(F.col("answered"), "answered").when(F.col("attempts") < F.col("services"), "out of time").otherwise("failed")
    same = reduce(lambda a, b: a & b, [ended[c].eqNullSafe(asked[c]) for c in key])
    return ended.join(asked, same).select(*(ended[c] for c in key), "answered_by", "attempts", outcome.alias("outcome"), "seconds")
