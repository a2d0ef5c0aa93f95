"""Jobs over pages, page events, the store of pages, the service, files that we wrote ourselves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.operators import cache, enrich, layout, probe, settings
from pagewright.sources import pages as P
from pagewright.sources.store import PageStore
from pagewright.streaming import jobs, states

D = "/root/testdata/sf0.001"


def test_wanted(spark):
    sentences = spark.createDataFrame([("d", n, f"{n}-{k}") for n in (1, 2, 3) for k in (1, 2)], "doc string, page int, id string")
    held = spark.createDataFrame([("d", "1-1", "error"), ("d", "2-1", "done"), ("d", "2-2", "pending"), ("d", "3-1", "error")], "doc string, id string, status string")
    events = spark.createDataFrame([("d", 1, 2, "nearby", False, 3), ("d", 2, 3, "manual", True, 3), ("d", 3, 3, "manual", False, 3), ("d", 4, None, "page", False, 3), ("e", 5, 1, "page", True, 1)], "doc string, seq int, page int, rng string, explicit boolean, n_pages int")
    got = sorted((r.seq, r.id) for r in jobs.wanted(events, sentences, held).collect())
    assert got == [(1, "1-2"), (1, "3-2"), (2, "3-1"), (2, "3-2")]
    again = sorted((r.seq, r.id) for r in jobs.wanted(events, sentences, jobs.retried(held)).collect())
    assert (1, "1-1") in again and (1, "3-1") in again
    assert jobs.wanted(events.limit(0), sentences, held).count() == 0
    assert {r.id: r.status for r in jobs.status_of(sentences.select("doc", "id"), held).collect()}["1-2"] == "none"


def test_wanted_on_a_stream(spark, tmp_path):
    sentences = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc string, page int, id string")
    held = spark.createDataFrame([], "doc string, id string, status string")
    spark.createDataFrame([("d", 1, 2, "page", False, 3)], "doc string, seq int, page int, rng string, explicit boolean, n_pages int").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("doc string, seq int, page int, rng string, explicit boolean, n_pages int").parquet(str(tmp_path / "in"))
    query = jobs.wanted(events, sentences, held).writeStream.format("memory").queryName("wanted_now").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert [r.id for r in spark.table("wanted_now").collect()] == ["b"]


def test_jobs(spark):
    rows = spark.createDataFrame([("d", n, f"s{n}") for n in range(1, 6)], "doc string, page int, id string")
    seen, steps = [], []
    job = jobs.Job(spark, lambda done, total: steps.append((done, total)))
    assert job.run(rows, lambda wave: seen.extend(r.id for r in wave.orderBy("page").collect()), 2) == 5
    assert seen == ["s1", "s2", "s3", "s4", "s5"] and steps == [(2, 5), (4, 5), (5, 5)] and job.finished.is_set()
    stopped = jobs.Job(spark)
    stopped.on_progress = lambda done, total: stopped.cancel() if done == 2 else None
    assert stopped.run(rows, lambda wave: wave.count()) == 2 and stopped.cancelled.is_set()
    held = jobs.Jobs()
    open_ = held.add("viewer", jobs.Job(spark))
    held.add("viewer", job)
    assert held.release("viewer") == 1 and open_.cancelled.is_set() and not job.cancelled.is_set() and held.release("viewer") == 0
    assert open_.run(rows, lambda wave: wave.count()) == 0

    def fail(wave):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        jobs.Job(spark).run(rows, fail)
    assert jobs.Job(spark).run(rows.limit(0), fail) == 0


def test_a_job_is_interrupted_inside_a_wave(spark):
    import threading
    import time

    job = jobs.Job(spark)
    rows = spark.createDataFrame([(1,), (2,)], "page int")
    slow = F.udf(lambda n: time.sleep(60) or n, "int")
    threading.Timer(4, job.cancel).start()
    began = time.monotonic()
    assert job.run(rows, lambda wave: wave.select(slow("page")).collect()) == 0
    assert time.monotonic() - began < 45


def test_dispatch(spark):
    messages = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "type string, n int")
    got = {}
    jobs.dispatched(messages, F.col("type"), {"a": lambda m: got.update(a=m.count()), "c": lambda m: got.update(c=m.count())})
    assert got == {"a": 2, "c": 0}


def test_page_store(spark, tmp_path):
    pages = spark.read.parquet(f"{D}/page_texts.parquet").dropDuplicates(["paper_id", "page"])
    calls = []

    def segment(some):
        calls.append(some.count())
        return layout.sentences(some)

    store = PageStore(spark, str(tmp_path / "pages"), segment)
    assert store.cached().count() == 0 == store.ready().count()
    keys = [tuple(r) for r in pages.select("paper_id", "page").orderBy("paper_id", "page").limit(3).collect()]
    some = pages.where(F.concat_ws("/", "paper_id", "page").isin([f"{a}/{b}" for a, b in keys]))
    first = store.ensure(some.where(F.col("page") == keys[0][1]))
    n = first.count()
    assert n > 0
    store.ensure(some)
    assert [tuple(r) for r in store.ready().collect()] == keys and sum(calls) == 3
    assert sorted(map(str, store.cached().drop("rects").collect())) == sorted(map(str, layout.sentences(some).select(*store.cached().columns).drop("rects").collect()))
    one = store.cached().first()
    at = one.rects[0]
    probes = spark.createDataFrame([("p", one.paper_id, one.page, at.x + at.w / 2, at.y + at.h / 2), ("q", "nowhere", 1, 0.0, 0.0)], "probe_id string, doc string, page int, px double, py double")
    assert [r.id for r in store.hits(probes).collect()] == [one.sent_id]
    assert store.get(spark.createDataFrame([(one.paper_id, one.sent_id)], "paper_id string, sent_id string")).first().text == one.text
    store.reset()
    assert store.cached().count() == 0 and [r.id for r in store.hits(probes).collect()] == []
    assert [r.id for r in store.hits(probes, pages).collect()] == [one.sent_id]

    def broken(some):
        raise RuntimeError("cannot")

    bad = PageStore(spark, str(tmp_path / "bad"), broken)
    with pytest.raises(RuntimeError):
        bad.ensure(some)
    bad.segment = layout.sentences
    assert bad.ensure(some).count() > 0


def test_service(spark, tmp_path):
    told = []
    service = enrich.Service(spark, settings.read_settings({"targetLanguage": "de"}), str(tmp_path / "store"), client=enrich.EchoClient(), on_change=lambda: told.append(1))
    rows = spark.createDataFrame([("d", 1, 1, "One here.", "g"), ("d", 2, 2, "One  here.", "g")], "doc string, ord long, id long, text string, grp string")
    assert {r.translation for r in service.translate(rows).collect()} == {"T(One here.)"}
    assert cache.read(spark, service.store).count() == 1
    service.given = service.client = enrich.EchoClient("again {0}")
    assert {r.translation for r in service.translate(rows).collect()} == {"T(One here.)"}
    service.changed(settings.read_settings({"targetLanguage": "fr", "glossary": {"here": "ici"}}))
    assert told == [1] and {r.translation for r in service.translate(rows).collect()} == {"again One here."}
    locked = enrich.Service(spark, settings.read_settings({}), str(tmp_path / "none"))
    assert not locked.ready() and {r.code for r in locked.translate(rows).collect()} == {"noApiKey"}
    locked.changed(settings.read_settings({"baseUrl": "http://localhost:1/v1"}))
    assert locked.ready()


def test_watched_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"ours")
    (tmp_path / "in" / "b.bin").write_bytes(b"theirs")
    (tmp_path / "in" / "c.txt").write_bytes(b"other")
    own = P.own_write(spark.createDataFrame([(f"file:{tmp_path}/in/a.bin", bytearray(b"ours")), (f"file:{tmp_path}/in/b.bin", bytearray(b"older"))], "path string, content binary"))
    got = []
    query = P.watched_files(spark, str(tmp_path / "in"), "*.bin").writeStream.foreachBatch(lambda df, _: got.extend(r.path for r in P.not_own(df, own).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [p.rpartition("/")[2] for p in got] == ["b.bin"]


def test_messages(spark):
    rows = [('{"type":"translate","requestId":1,"sentences":[{"id":"a","text":"t","group":"g"}],"jobId":3}', True, False), ('{"type":"translate","requestId":1,"sentences":[],"jobId":"3"}', False, False), ('{"type":"translate","requestId":1,"sentences":[]}', True, False), ('{"open":"x"}', False, True), ('{"open":3}', False, False), ("[]", False, False), (None, False, False)]
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, m string")
    got = frame.select("i", P.is_valid_message(F.col("m")).alias("v"), P.is_link_message(F.col("m")).alias("l")).orderBy("i").collect()
    assert [(r.v, r.l) for r in got] == [r[1:] for r in rows]


def test_late_replies(spark):
    rows = [("d", "a", 1, "ask", 1, None), ("d", "a", 2, "ask", 2, None), ("d", "a", 3, "reply", 2, "late"), ("d", "a", 4, "failure", 1, "no"), ("d", "a", 5, "retry", None, None), ("d", "a", 6, "ask", 3, None), ("d", "a", 7, "reply", 1, "old"), ("d", "a", 8, "reply", 3, "new"),
            ("d", "b", 1, "ask", 1, None), ("d", "b", 2, "reset", None, None), ("d", "b", 3, "reply", 1, "x"), ("d", "c", 1, "reply", 1, "x")]
    frame = spark.createDataFrame(rows, states.EVENT)
    got = {r.id: (r.seq, r.status, r.text) for r in states.states(frame.unionByName(frame)).collect()}
    assert got == {"a": (8, "done", "new"), "b": (2, "none", None), "c": (-1, "none", None)}
    state = states._EMPTY
    for r in rows[:8]:
        state = states.step(state, (r[2], r[3], r[4], r[5]))
    assert (state[0], state[1], state[3]) == got["a"]


def test_places(spark):
    n = spark.createDataFrame([(9, 4), (2, 4), (None, 4), (3, 0)], "p int, n int")
    assert [r.v for r in n.select(probe.kept_page(F.col("p"), F.col("n")).alias("v")).collect()] == [4, 2, 1, 1]
