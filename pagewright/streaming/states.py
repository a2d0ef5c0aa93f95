"""Requests and replies as a stream: the state of each sentence, bursts of results, and the fence of generations.

There is no event time here: a reply is late when its request is not the one that is open, not when time has passed. State
is kept by document and sentence, so a hot document is spread over its sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: What events hold: kind is ask, reply, failure, retry or reset.
EVENT = "doc string, id string, seq bigint, kind string, request_id bigint, text string"
STATE = "doc string, id string, seq bigint, status string, text string"

_KEPT = "seq bigint, status string, request_id bigint, text string"


def step(state: tuple, event: tuple) -> tuple:
    """The state (seq, status, request, text) after an event (seq, kind, request, text).

    A reply or failure counts only for the open request; a request only where nothing is open or done; a retry only after
    an error. Events that do not count leave all as it is.
    """
    _, status, request, _ = state
    seq, kind, number, text = event
    if kind == "reset":
        return seq, "none", None, None
    if kind == "ask" and status in ("none", "error"):
        return seq, "pending", number, None
    if kind == "retry" and status == "error":
        return seq, "none", None, None
    if kind in ("reply", "failure") and status == "pending" and number == request:
        return seq, "done" if kind == "reply" else "error", None, text
    return state


_EMPTY = (-1, "none", None, None)


def _plain(value):
    return None if value is None or value is pd.NA or value != value else value


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    for r in frame.sort_values("seq", kind="stable").itertuples(index=False):
        number = _plain(r.request_id)
        yield int(r.seq), r.kind, None if number is None else int(number), _plain(r.text)


_FOLDED = "struct<seq:bigint, status:string, request_id:bigint, text:string>"


def _stepped(state: Column, event: Column) -> Column:
    """step() as an expression."""
    status, kind = state["status"], event["kind"]
    to = lambda name, request, text: F.struct(event["seq"], F.lit(name) if isinstance(name, str) else name, request, text).cast(_FOLDED)
    nothing = F.lit(None)
    counts = (status == "pending") & event["request_id"].eqNullSafe(state["request_id"])
    return (
        F.when(kind == "reset", to("none", nothing, nothing))
        .when((kind == "ask") & status.isin("none", "error"), to("pending", event["request_id"], nothing))
        .when((kind == "retry") & (status == "error"), to("none", nothing, nothing))
        .when(kind.isin("reply", "failure") & counts, to(F.when(kind == "reply", "done").otherwise("error"), nothing, event["text"]))
        .otherwise(state)
    )


def states(events: DataFrame) -> DataFrame:
    """Last state of each sentence of a batch of events, by order of seq; of events of one seq, as sort order has them.

    What stands before the last reset of a sentence does not count, so it goes no further than an aggregate that meets it
    where it is read; of the events after it the same ones count once.
    """
    last = events.where("kind = 'reset'").groupBy("doc", "id").agg(F.max("seq").alias("_reset"))
    rows = events.join(last, ["doc", "id"], "left").where("_reset is null or seq >= _reset").drop("_reset")
    ordered = F.array_sort(F.collect_set(F.struct("seq", "kind", "request_id", "text")))
    start = F.struct(F.lit(_EMPTY[0]), F.lit(_EMPTY[1]), F.lit(None), F.lit(None)).cast(_FOLDED)
    folded = rows.groupBy("doc", "id").agg(F.aggregate(ordered, start, _stepped).alias("s"))
    return folded.select("doc", "id", "s.seq", "s.status", "s.text")


def track(events: DataFrame) -> DataFrame:
    """As states, for a stream: each change of state, as it happens; within a micro-batch in order of seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = held.get if held.exists else _EMPTY
        state = tuple(_plain(v) for v in before)
        state = (int(state[0]), state[1], None if state[2] is None else int(state[2]), state[3])
        start = state
        for event in _rows(pd.concat(list(frames))):
            state = step(state, event)
        held.update(state)
        if state != start:
            yield pd.DataFrame([(*key, state[0], state[1], state[3])], columns=["doc", "id", "seq", "status", "text"])

    return events.groupBy("doc", "id").applyInPandasWithState(update, STATE, _KEPT, "update", GroupStateTimeout.NoTimeout)


def dirty_changes(events: DataFrame) -> DataFrame:
    """(doc, seq, dirty): when a document becomes dirty or clean, of events(doc, seq, kind), kind edit, save or backup."""
    own = Window.partitionBy("doc").orderBy("seq")
    rows = events.where(F.col("kind").isin("edit", "save", "backup")).withColumn("dirty", F.col("kind") != "save")
    before = F.coalesce(F.lag("dirty").over(own), F.lit(False))
    return rows.withColumn("before", before).where("dirty <> before").select("doc", "seq", "dirty")


def progress(events: DataFrame) -> DataFrame:
    """(job, seq, percent, increment) of events(job, seq, done, total): share done, and by how much it grew."""
    percent = F.col("done") * 100.0 / F.nullif(F.col("total"), F.lit(0))
    rows = events.withColumn("percent", F.coalesce(percent, F.lit(0.0)))
    last = F.coalesce(F.lag("percent").over(Window.partitionBy("job").orderBy("seq")), F.lit(0.0))
    return rows.select("job", "seq", "percent", (F.col("percent") - last).alias("increment"))


def fenced(results: DataFrame, generations: DataFrame) -> DataFrame:
    """Results whose generation is the current one of their document: generations(doc, current)."""
    return results.join(generations, "doc").where(F.col("generation") == F.col("current")).drop("current")


def bursts(results: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Deliver results in bursts, one writer at a time; every None: what there is, then stop."""
    writer = results.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
