"""Probes, rendering, page files, messages and states."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagewright.operators import probe, render
from pagewright.sources import pages
from pagewright.streaming import states

RECTS = "doc string, page int, id string, ord bigint, x double, y double, w double, h double"


def test_hit_test_ties(spark):
    rects = spark.createDataFrame([("d", 1, "a", 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, "b", 2, 0.0, 0.0, 10.0, 10.0), ("d", 1, "c", 3, 50.0, 0.0, 10.0, 10.0)], RECTS)
    points = spark.createDataFrame([("p1", "d", 1, 5.0, 5.0), ("p2", "d", 1, 13.0, 5.0), ("p3", "d", 1, 13.1, 5.0), ("p4", "d", 1, 52.0, 12.0), ("p5", "x", 1, 5.0, 5.0)], "probe_id string, doc string, page int, px double, py double")
    assert {r.probe_id: r.id for r in probe.hit_test(points, rects).collect()} == {"p1": "b", "p2": "b", "p4": "c"}
    lines = rects.withColumn("line", F.col("ord"))
    got = {r.probe_id: (r.id, r.within) for r in probe.line_at(points, lines).collect()}
    assert got["p1"] == ("a", 0.5) and got["p4"][0] == "c" and "p5" not in got
    views = spark.createDataFrame([("v", "d", 1, 40.0, 0.0, 100.0, 100.0), ("w", "d", 1, 20.0, 0.0, 30.0, 5.0)], "view_id string, doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {r.view_id: r.id for r in probe.first_in_view(views, rects).collect()} == {"v": "c"}


def test_page_at(spark):
    places = spark.createDataFrame([("d", 1, 0.0, 5000.0), ("d", 2, 5000.0, 9000.0)], "doc string, page int, top double, bottom double")
    points = spark.createDataFrame([(1, "d", 4999.0), (2, "d", 5000.0), (3, "d", 9000.0), (4, "e", 1.0)], "point_id int, doc string, py double")
    assert {r.point_id: r.page for r in probe.page_at(points, places).collect()} == {1: 1, 2: 2}


def test_sections(spark):
    rows = [("d", 1, i, r, t) for i, (r, t) in enumerate([("code", "a"), ("figure", "f1"), ("code", "b"), ("figure", "f2"), ("figure", "f3"), ("paragraph", "p"), ("code", "c"), ("figure", "f4")])]
    got = [(r.role, r.n_blocks, r.text) for r in render.sections(spark.createDataFrame(rows, "doc string, page int, idx int, role string, text string")).orderBy("first_idx").collect()]
    assert got == [("code", 2, "a\nb"), ("figure", 1, None), ("figure", 2, None), ("paragraph", 1, "p"), ("code", 1, "c"), ("figure", 1, None)]


def test_paragraphs(spark):
    sentences = spark.createDataFrame([("d", "g", 2, "b", "Two."), ("d", "g", 1, "a", "One."), ("d", "h", 3, "c", "三。")], "doc string, grp string, ord int, id string, text string")
    done = spark.createDataFrame([("d", "a", "一。")], "doc string, id string, translation string")
    got = {r.grp: (r.target_text, r.source_text) for r in render.paragraphs(sentences, done, "zh-CN").collect()}
    assert got == {"g": ("一。Two. ", "One. Two. "), "h": ("三。", "三。")}
    assert render.paragraphs(sentences, done, "en").where("grp = 'g'").first().target_text == "一。 Two. "


def test_page_files(spark, tmp_path):
    page = {"source": "x.pdf", "page": 2, "view": [0, 0, 595, 842], "styles": {"f": {"fontFamily": "serif"}}, "items": [{"str": "a", "transform": [10, 0, 0, 10, 72.12345, 700.0005], "width": 5, "height": 10, "fontName": "f", "hasEOL": True}, {"type": "mark"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p2.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "in" / "bad.json").write_text("{nothing")
    rows = pages.read_json_pages(spark, str(tmp_path / "in")).collect()
    assert len(rows) == 1 and len(rows[0].text_items) == 1 and rows[0].styles["f"].font_family == "serif"
    pages.write_json_pages(pages.read_json_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    back = pages.read_json_lines(spark, str(tmp_path / "out")).collect()
    assert back[0].text_items[0].matrix == [10.0, 0.0, 0.0, 10.0, 72.123, 700.001]


def test_rounding_and_files(spark, tmp_path):
    assert [r.v for r in spark.createDataFrame([(-0.5,), (0.5,), (1.2345,)], "x double").select(pages.rounded(F.col("x"), 0).alias("v")).collect()] == [0.0, 1.0, 1.0]
    (tmp_path / "a.bin").write_bytes(b"mine")
    (tmp_path / "b.bin").write_bytes(b"theirs")
    own = spark.sql("select sha1(cast('mine' as binary)) as sha1")
    assert [r.path.rpartition("/")[2] for r in pages.changed_files(spark, str(tmp_path), own).collect()] == ["b.bin"]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.ts").write_text("t(\"one\", 1); t('two'); u('three')")
    assert {r.literal for r in pages.string_literals(spark, str(tmp_path / "src")).collect()} == {"one", "two"}


def test_messages(spark):
    cases = [('{"type":"dirty"}', True), ('{"type":"data"}', False), ('{"type":"dataError","requestId":1,"message":"m"}', True), ('{"type":"dataError","requestId":"1","message":"m"}', False), ('{"type":"nope"}', False), ("[]", False), ("broken", False), (None, False), ('{"type":"translate","requestId":1,"sentences":[{"id":"a","text":"t","group":"g"}]}', True), ('{"type":"translate","requestId":1,"sentences":[{"id":"a"}]}', False), ('{"type":"translate","requestId":1,"sentences":[]}', True)]
    frame = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string")
    assert [r.v for r in frame.select("i", pages.is_valid_message(F.col("m")).alias("v")).orderBy("i").collect()] == [v for _, v in cases]


EVENTS = [
    ("d", "a", 1, "ask", 7, None), ("d", "a", 2, "reply", 8, "late"), ("d", "a", 3, "reply", 7, "ok"), ("d", "a", 4, "failure", 7, "x"), ("d", "b", 5, "ask", 9, None), ("d", "b", 6, "failure", 9, "bad"),
    ("d", "b", 7, "retry", None, None), ("d", "b", 8, "ask", 10, None), ("d", "c", 9, "reply", 1, "unknown"), ("d", "e", 10, "ask", 2, None), ("d", "e", 11, "reset", None, None), ("d", "e", 12, "reply", 2, "stale"),
]
EXPECTED = {"a": ("done", "ok"), "b": ("pending", None), "c": ("none", None), "e": ("none", None)}


def test_states_of_a_batch(spark):
    got = states.states(spark.createDataFrame(EVENTS, states.EVENT)).collect()
    assert {r.id: (r.status, r.text) for r in got} == EXPECTED


def test_states_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "events")
    for part in (EVENTS[:5], EVENTS[5:]):
        spark.createDataFrame(part, states.EVENT).coalesce(1).write.mode("append").parquet(source)
    last = {}

    def deliver(frame, _):
        last.update({r.id: (r.seq, r.status, r.text) for r in frame.collect()})

    stream = spark.readStream.schema(states.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    states.bursts(states.track(stream), deliver, str(tmp_path / "cp"), every=None).awaitTermination()
    assert {k: v[1:] for k, v in last.items()} == {k: v for k, v in EXPECTED.items() if k != "c"}


def test_fence(spark):
    results = spark.createDataFrame([("d", 1, "old"), ("d", 2, "new")], "doc string, generation int, text string")
    assert [r.text for r in states.fenced(results, spark.createDataFrame([("d", 2)], "doc string, current int")).collect()] == ["new"]


def test_small_operators(spark):
    from pagewright.operators import settings
    from pagewright.sources.pages import is_inside

    defaults = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, value string")
    given = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y")], "name string, value string")
    assert {r.name: r.value for r in settings.overlaid(given, defaults).collect()} == {"a": "x", "b": "B"}
    assert settings.other_providers(spark, "https://api.openai.com/V1/").count() == len(settings.PROVIDERS) - 1
    rows = spark.createDataFrame([("https://h/d/x", "https://h/d/i.html"), ("https://h/e", "https://h/d/i.html"), ("nonsense", "https://h/d/"), (None, "https://h/d/")], "u string, b string")
    assert [r.v for r in rows.select(is_inside(F.col("u"), F.col("b")).alias("v")).collect()] == [True, False, False, False]
    codes = spark.createDataFrame([("noApiKey", []), ("http", ["500", "x"]), ("unknown", ["1"])], "code string, args array<string>")
    assert [r.v for r in codes.select(settings.error_message(F.col("code"), F.col("args"), F.lit("?")).alias("v")).collect()] == ["There is no key for the service.", "The service replied with status 500: x", "?"]
    assert spark.range(1).select(settings.target_unset(F.lit(None), F.lit(None)).alias("v")).first().v is True
    urls = spark.createDataFrame([("http://localhost:1/v1",), ("https://x.org",), ("no address",)], "u string")
    assert [r.v for r in urls.select(settings.needs_api_key(F.col("u")).alias("v")).collect()] == [False, True, True]


def test_table_functions(spark):
    from pagewright.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([(1, "One here. Two there."), (2, None)], "id int, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, s.idx, s.start_pos, s.end_pos, s.sentence FROM texts, LATERAL sentences_of(text) s ORDER BY id, idx").collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 9, "One here."), (1, 2, 10, 20, "Two there.")]
    spark.read.parquet("/root/testdata/sf0.001/page_texts.parquet").limit(3).createOrReplaceTempView("some_pages")
    from pagewright.operators import layout

    layout.register_views(spark.table("some_pages"))
    assert spark.sql("SELECT b.text FROM page_blocks b JOIN page_sentences s USING (paper_id, page, block_id)").count() > 3
    assert spark.sql("SELECT max(line_idx) FROM page_lines").first()[0] > 3
