"""Batches, replies, the store and the pipeline with clients that need no network."""

from __future__ import annotations

import datetime
import json

import pytest

from pagewright.operators import batching, cache, enrich, reply, settings

SENTENCES = "doc string, ord bigint, id string, text string, grp string"
ROWS = [("d", 1, "a", "Der erste Satz ist nicht lang und gut.", "g1"), ("d", 2, "b", "Der zweite Satz ist mit dem Hund.", "g1"), ("d", 3, "c", "Das ist der dritte und letzte Satz.", "g2")]


def run(spark, rows, client, store=(), **options):
    results, answers = enrich.translate(spark.createDataFrame(rows, SENTENCES), spark.createDataFrame(list(store), "key string, translation string"), client, enrich.Options(**{"target": "en", **options}))
    return {r.id: r for r in results.collect()}, answers.collect()


def test_pack_keeps_groups_and_budgets():
    assert batching.pack([10] * 5, ["a", "a", "b", "b", None], 25, 40) == [0, 0, 1, 1, 2]
    assert batching.pack([30, 30, 5], ["a", "a", "b"], 40, 40) == [0, 1, 1]
    assert batching.pack([1] * 90, [None] * 90, 1000, 40) == [0] * 40 + [1] * 40 + [2] * 10
    assert batching.pack([], []) == [] and batching.pack([5000], ["a"]) == [0]


def test_translate_and_reopen(spark):
    first, answers = run(spark, ROWS, enrich.EchoClient())
    assert {i: r.translation for i, r in first.items()} == {r[2]: f"T({r[3]})" for r in ROWS} and sum(a.api_calls for a in answers) == 1
    again, answers = run(spark, ROWS, enrich.EchoClient(), [(a.key, a.translation) for a in answers])
    assert answers == [] and {i: r.translation for i, r in again.items()} == {i: r.translation for i, r in first.items()}


def test_pass_through_and_duplicates(spark):
    rows = [*ROWS, ("d", 4, "e", "This is already in the target language.", None), ("d", 5, "dup", ROWS[0][3] + " ", None), ("d", 6, "null", None, None)]
    got, answers = run(spark, rows, enrich.EchoClient())
    assert got["e"].cache_key == "" and got["e"].translation == rows[3][3]
    assert got["dup"].translation == got["a"].translation and len(answers) == 3
    assert got["null"].code == "noTranslation" and got["null"].translation is None


class Faulty:
    """Fails for requests of more than one sentence, or leaves out sentences, or for good."""

    def __init__(self, how):
        self.how = how

    def complete(self, messages, max_tokens):
        rows = json.loads(messages[-1]["content"])["sentences"]
        if self.how == "transient" and len(rows) > 1:
            raise enrich.ApiError("timeout", 60, retryable=True)
        if self.how == "fatal":
            raise enrich.ApiError("unauthorized")
        drop = len(rows) > 1 if self.how == "drops" else self.how == "always"
        return json.dumps([{"id": r["id"], "translation": "ok " + r["text"]} for r in rows[drop:]]), {"prompt_tokens": 1, "completion_tokens": 2}


@pytest.mark.parametrize(("how", "done", "calls", "code"), [("transient", 3, 4, None), ("drops", 3, 2, None), ("fatal", 0, 1, "unauthorized"), ("always", 2, 2, "noTranslation")])
def test_retries(spark, how, done, calls, code):
    got, answers = run(spark, ROWS, Faulty(how))
    assert sum(r.translation is not None for r in got.values()) == done
    assert sum(a.api_calls for a in answers) == calls
    assert {r.code for r in got.values()} - {None} == ({code} if code else set())


def test_http_client():
    sent, slept = [], []
    replies = [(429, {"retry-after": "7"}, b""), (503, {}, b""), (200, {}, json.dumps({"choices": [{"message": {"content": "x"}}], "usage": {"prompt_tokens": 3}}).encode())]

    def send(url, headers, body, timeout):
        sent.append((url, headers, json.loads(body)))
        return replies[min(len(sent) - 1, 2)]

    client = enrich.HttpClient("https://api.deepseek.com/", "m", "k", send=send, sleep=slept.append)
    assert client.complete([{"role": "user", "content": "q"}], 99) == ("x", {"prompt_tokens": 3})
    assert sent[0][0] == "https://api.deepseek.com/chat/completions" and sent[0][2]["thinking"] == {"type": "disabled"} and sent[0][2]["max_tokens"] == 99
    assert slept[0] == 7.0 and 1.5 <= slept[1] <= 2.5
    replies[0] = (401, {}, b"")
    sent.clear()
    with pytest.raises(enrich.ApiError) as error:
        client.complete([], 1)
    assert error.value.code == "unauthorized" and len(sent) == 1
    local = enrich.HttpClient("http://localhost:1", "m", send=send)
    sent[:] = [None, None]
    local.complete([], 1)
    assert "Authorization" not in sent[-1][1]


REPLIES = [
    (1, '{"translations":[{"id":"s1","translation":" a "},{"id":"x","translation":"no"}]}'), (2, '```json\n[{"id":"s1","zh":"b"}]\n```'), (3, "not json"), (4, None), (5, ""),
    (6, '[{"id":5,"translation":"n"},{"id":"s1","translation":""},{"id":"s2","translation":"old"},{"id":"s2","translation":"new"}]'), (7, '[{"id":"s1","translation":" ","zh":"z"}, 3, null]'), (8, '{"translations":{}}'),
]


def test_parse_replies(spark):
    frame = spark.createDataFrame([(n, c, ["s1", "s2"]) for n, c in REPLIES], "reply_id int, content string, expected array<string>")
    got = {(r.reply_id, r.id): r.translation for r in reply.parse(frame).collect()}
    assert got == {(1, "s1"): "a", (2, "s1"): "b", (6, "s2"): "new"}
    assert got == {(n, i): t for n, c in REPLIES if c for i, t in reply.read(c, ["s1", "s2"]).items()}
    assert {(r.reply_id, r.id) for r in reply.missing(frame).collect()} == {(n, s) for n, _ in REPLIES for s in ("s1", "s2")} - set(got)


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    schema = "key string, translation string, t timestamp"
    assert cache.read(spark, path).count() == 0
    cache.upsert(spark.createDataFrame([("aa1", "one", at(1)), ("bb1", "two", at(1)), ("cc1", " ", at(1))], schema), path)
    cache.upsert(spark.createDataFrame([("aa1", "older", at(0)), ("aa2", "three", at(2)), ("bb1", "newer", at(5))], schema), path)
    assert {r.key: r.translation for r in cache.read(spark, path).collect()} == {"aa1": "one", "aa2": "three", "bb1": "newer"}
    hits, misses = cache.split(spark.createDataFrame([("aa1",), ("zz",)], "key string"), cache.read(spark, path))
    assert [r.key for r in hits.collect()] == ["aa1"] and [r.key for r in misses.collect()] == ["zz"]
    cache.clear(spark, path)
    assert cache.read(spark, path).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "aa.json").write_text('{"aa9": {"zh": "x", "t": 1000}, "aa8": {"zh": ""}}')
    (tmp_path / "old" / "bb.json").write_text("broken")
    assert [(r.key, r.translation, r.shard) for r in cache.read_json(spark, str(tmp_path / "old")).collect()] == [("aa9", "x", "aa")]


def test_settings():
    bad = settings.read_settings({"temperature": 9, "maxCharsPerRequest": -5, "translateRange": "all", "glossary": {"a": 1, " b ": "x", " ": "y", "ja": {"b": "jb", "c": "jc"}}, "extraBody": "s", "targetLanguage": "ja", "baseUrl": " "})
    assert (bad.temperature, bad.max_chars_per_request, bad.translate_range, bad.extra_body, bad.base_url) == (2, 3000, "nearby", {}, "https://api.deepseek.com")
    assert bad.glossary == {"b": "jb", "c": "jc"} and bad.target_language == "ja" and not bad.target_language_is_auto
    assert "from Simplified Chinese (简体中文) into English" in settings.system_prompt({}, "en", "zh-CN")
    assert "from the language it is written in into English" in settings.system_prompt({}, "en")
    with pytest.raises(ValueError, match="Unsupported"):
        settings.system_prompt({}, "en", "tlh")
    assert settings.system_prompt({"b": "2", "a": "1"}, "en").endswith("a = 1\nb = 2")


def test_stats_and_missing_key(spark):
    results, answers = enrich.translate(spark.createDataFrame(ROWS, SENTENCES), spark.createDataFrame([], "key string, translation string"), Faulty("drops"), enrich.Options(target="en"))
    row = enrich.stats(answers, results).first()
    assert (row.api_calls, row.translated, row.failed, row.done, row.completion_tokens) == (2, 3, 0, 3, 4)
    assert {r.code for r in enrich.without_key(spark.createDataFrame(ROWS, SENTENCES)).collect()} == {"noApiKey"}
