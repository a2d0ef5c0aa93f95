"""From page events to requests, and jobs over whole documents with progress and cancelling.

What a page event asks for is a join of the event with the sentences of the pages in its range and their states; it works
on a stream of events against tables of sentences and states. A job runs in waves of pages under a tag, so
that it can be stopped between waves and, by cancelling what has the tag, inside one.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import probe


def wanted(events: DataFrame, sentences: DataFrame, states: DataFrame) -> DataFrame:
    """(doc, seq, id): sentences to be asked for by events(doc, seq, page, rng, explicit, n_pages).

    An event that a user causes (explicit) asks for its own page and also for sentences that failed before; one that comes
    from turning pages asks for the pages in its range and for sentences that nothing is known of. sentences(doc, page, id),
    states(doc, id, status); a sentence without a state has the state none. Null pages ask for nothing.
    """
    own = events.withColumn("rng", F.when(F.col("explicit"), "page").otherwise(F.col("rng")))
    pages = probe.pages_in_range(own).select("doc", "seq", "explicit", F.col("wanted").alias("page"))
    rows = pages.join(sentences.select("doc", "page", "id"), ["doc", "page"]).join(states.select("doc", "id", "status"), ["doc", "id"], "left")
    open_ = F.coalesce("status", F.lit("none"))
    return rows.where((open_ == "none") | (F.col("explicit") & (open_ == "error"))).select("doc", "seq", "id").distinct()


def status_of(ids: DataFrame, states: DataFrame) -> DataFrame:
    """(doc, id, status) of ids(doc, id); none where no state is known."""
    return ids.join(states.select("doc", "id", "status"), ["doc", "id"], "left").withColumn("status", F.coalesce("status", F.lit("none")))


def retried(states: DataFrame) -> DataFrame:
    """States after a call to try again: errors are forgotten, so that the next event asks for them."""
    return states.withColumn("status", F.when(F.col("status") == "error", "none").otherwise(F.col("status")))


def dispatched(messages: DataFrame, kind: Column, handlers: dict[str, Callable[[DataFrame], None]]) -> list[str]:
    """Hand the messages of each kind to its handler, in the order of handlers; kinds without one are left alone."""
    for name, handle in handlers.items():
        handle(messages.where(kind == name))
    return list(handlers)


class Job:
    """Work over the pages of documents in waves, in page order, which can be watched and stopped."""

    def __init__(self, spark: SparkSession, on_progress: Callable[[int, int], None] | None = None):
        self.spark, self.on_progress = spark, on_progress
        self.tag = f"pagewright-job-{uuid.uuid4().hex}"
        self.done = self.total = 0
        self.cancelled, self.finished = threading.Event(), threading.Event()

    def run(self, rows: DataFrame, work: Callable[[DataFrame], None], pages_a_wave: int = 1) -> int:
        """Call work with the rows(page, ...) of each wave; the number of pages done. A failed wave ends the job, with its
        error unless the job was cancelled. Only the number of pages of the longest document reaches the driver."""
        self.total = rows.agg(F.coalesce(F.max("page"), F.lit(0)).alias("n")).first().n
        self._context().addJobTag(self.tag)
        try:
            while self.done < self.total and not self.cancelled.is_set():
                last = min(self.total, self.done + pages_a_wave)
                work(rows.where(F.col("page").between(self.done + 1, last)))
                if self.cancelled.is_set():
                    break
                self.done = last
                if self.on_progress is not None:
                    self.on_progress(self.done, self.total)
        except Exception:
            if not self.cancelled.is_set():
                raise
        finally:
            self._context().removeJobTag(self.tag)
            self.finished.set()
        return self.done

    def cancel(self) -> None:
        """Stop before the next wave and interrupt the present one; also what closing a viewer does to its jobs."""
        self.cancelled.set()
        self._context().cancelJobsWithTag(self.tag)

    def _context(self) -> SparkContext:
        """Tags of the context: those of the session reach only jobs of the thread that cancels."""
        return self.spark.sparkContext


class Jobs:
    """Jobs by owner: what an owner leaves behind is stopped."""

    def __init__(self):
        self.held: dict[str, list[Job]] = {}

    def add(self, owner: str, job: Job) -> Job:
        self.held.setdefault(owner, []).append(job)
        return job

    def release(self, owner: str) -> int:
        """Cancel the unfinished jobs of an owner; how many they were."""
        open_ = [job for job in self.held.pop(owner, []) if not job.finished.is_set()]
        for job in open_:
            job.cancel()
        return len(open_)
