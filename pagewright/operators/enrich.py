"""Enrichment of sentences by an outside model: pass-through, keys, one call for equal texts, store, requests, results.

The relational part is one plan: sentences already in the target language pass, equal keys are asked once, keys in the
store are not asked, the rest is packed into requests. A request is one row; an Arrow kernel calls a client for it, reads
the reply, asks for what is missing one by one, and turns failures into rows. What it returns is written to reliable
storage before it is used twice, so that a retried plan does not ask again.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, language, patterns as P
from ..session import cut, partitions, ship
from . import batching, cache, reply, settings as S


class ApiError(Exception):
    """A failed call: code of the error, its arguments, and whether another try may succeed."""

    def __init__(self, code: str, *args: Any, retryable: bool = False, wait: float | None = None):
        super().__init__(code)
        self.code, self.values, self.retryable, self.wait = code, [str(a) for a in args], retryable, wait


class Client(Protocol):
    """What a model call must offer; implementations are sent to the workers."""

    def complete(self, messages: list[dict[str, str]], max_tokens: int) -> tuple[str, dict[str, int]]:
        """Content of the reply and token counts; raises ApiError."""


@dataclass
class EchoClient:
    """A client without a network: T(text), and failures by rule."""

    template: str = "T({0})"
    fails: Callable[[str], bool] | None = None

    def complete(self, messages: list[dict[str, str]], max_tokens: int) -> tuple[str, dict[str, int]]:
        rows = json.loads(messages[-1]["content"])["sentences"]
        out = [{"id": r["id"], "translation": self.template.replace("{0}", r["text"])} for r in rows if not (self.fails and self.fails(r["text"]))]
        return json.dumps({"translations": out}), {"prompt_tokens": sum(len(r["text"]) for r in rows), "completion_tokens": 0}


@dataclass
class HttpClient:
    """A chat endpoint over HTTP, with retries."""

    base_url: str
    model: str
    api_key: str = ""
    temperature: float = 0.7
    timeout: float = 60.0
    extra: dict[str, Any] = field(default_factory=dict)
    retries: int = 3
    base_delay: float = 1.0
    longest_wait: float = 60.0
    send: Callable[[str, dict[str, str], bytes, float], tuple[int, dict[str, str], bytes]] | None = None
    sleep: Callable[[float], None] = time.sleep

    def complete(self, messages: list[dict[str, str]], max_tokens: int) -> tuple[str, dict[str, int]]:
        for attempt in range(self.retries + 1):
            try:
                return self._once(messages, max_tokens)
            except ApiError as error:
                if not error.retryable or attempt == self.retries:
                    raise
                delay = self.base_delay * 2**attempt * random.uniform(0.75, 1.25)
                self.sleep(delay if error.wait is None else min(error.wait, self.longest_wait))
        raise AssertionError

    def _once(self, messages: list[dict[str, str]], max_tokens: int) -> tuple[str, dict[str, int]]:
        body = {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": max_tokens, "response_format": {"type": "json_object"}, "stream": False}
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})}
        url = self.base_url.rstrip("/") + "/chat/completions"
        try:
            status, given, content = (self.send or _send)(url, headers, json.dumps(body | S.request_extras(self.base_url, self.extra)).encode(), self.timeout)
        except TimeoutError as error:
            raise ApiError("timeout", round(self.timeout), retryable=True) from error
        except OSError as error:
            raise ApiError("network", error, retryable=True) from error
        if status != 200:
            wait = given.get("retry-after", "")
            text = content.decode(errors="replace")[:200]
            code = S.STATUS_CODES.get(status, "http")
            raise ApiError(code, *((status, text) if code == "http" else ()), retryable=status in S.RETRYABLE, wait=float(wait) if wait.replace(".", "", 1).isdigit() else None)
        try:
            reply = json.loads(content)
            return reply["choices"][0]["message"]["content"], reply.get("usage") or {}
        except (ValueError, LookupError, TypeError) as error:
            raise ApiError("noTranslation", retryable=True) from error


def _send(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, dict[str, str], bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
            return reply.status, {k.lower(): v for k, v in reply.headers.items()}, reply.read()
    except urllib.error.HTTPError as error:
        return error.code, {k.lower(): v for k, v in error.headers.items()}, error.read()


@dataclass(frozen=True)
class Options:
    target: str = P.DEFAULT_TARGET
    source: str = P.AUTO
    model: str = "m1"
    glossary: dict[str, str] = field(default_factory=dict)
    max_chars: int = batching.MAX_CHARS
    max_sentences: int = batching.MAX_SENTENCES
    #: Calls in flight of one task; how many tasks there are is up to the session.
    concurrency: int = 2


_ANSWER = "key string, translation string, code string, args array<string>, api_calls int, prompt_tokens int, completion_tokens int"


def _caller(client: Client, options: Options):
    def ask(texts: list[str], source: str) -> tuple[dict[int, str], dict[str, int]]:
        ids = [f"s{i + 1}" for i in range(len(texts))]
        message = json.dumps({"sentences": [{"id": i, "text": t} for i, t in zip(ids, texts, strict=True)]}, ensure_ascii=False)
        dense = next((row[3] in ("han", "kana", "hangul") for row in P.LANGUAGES if row[0] == source), False)
        chars = sum(map(len, texts)) * (batching.TOKENS_DENSE if dense else batching.TOKENS_A_CHAR)
        budget = min(batching.MAX_TOKENS, int(-(-chars // 1)) + batching.TOKENS_A_SENTENCE * len(texts) + batching.TOKENS_FIXED)
        content, usage = client.complete([{"role": "system", "content": S.system_prompt(options.glossary, options.target, source)}, {"role": "user", "content": message}], budget)
        found = reply.read(content, ids)
        return {i: found[x] for i, x in enumerate(ids) if x in found}, usage

    def request(row: dict) -> Iterator[dict]:
        rows, calls = row["rows"], 0
        texts = [r["text"] for r in rows]
        found: dict[int, str] = {}
        failed: dict[int, ApiError] = {}
        usage = {"prompt_tokens": 0, "completion_tokens": 0}

        def call(places: list[int]) -> None:
            nonlocal calls
            calls += 1
            try:
                got, used = ask([texts[i] for i in places], row["source"])
            except ApiError as error:
                failed.update(dict.fromkeys(places, error))
                return
            for i, text in got.items():
                found[places[i]] = text
                failed.pop(places[i], None)
            for name in usage:
                usage[name] += used.get(name) or 0
            failed.update({i: ApiError("noTranslation", retryable=True) for i in places if i not in found})

        call(list(range(len(rows))))
        if len(rows) > 1:  # a second and last round, one by one, for what another try may bring
            for i in sorted(i for i, error in failed.items() if error.retryable):
                call([i])
        for i, r in enumerate(rows):
            error = failed.get(i)
            first = i == 0
            yield {"key": r["key"], "translation": found.get(i), "code": error.code if error else None, "args": error.values if error else None, "api_calls": calls if first else 0, **{n: v if first else 0 for n, v in usage.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(answer)
        for batch in batches:
            with ThreadPoolExecutor(max(1, options.concurrency)) as calls:
                out = [o for rows in calls.map(lambda row: list(request(row)), batch.to_pylist()) for o in rows]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.types import _parse_datatype_string

    answer = _parse_datatype_string(_ANSWER)
    return run


def translate(sentences: DataFrame, store: DataFrame, client: Client, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Results and answers for sentences(doc, ord, id, text, grp).

    results: (doc, id, translation, cache_key, code, args): one row an id; translation is null where code says why not, and
    cache_key is "" where the text passed through. answers: what the client returned, by key, with counts of calls and
    tokens; its rows with a translation are what to put into the store. Null texts fail with noTranslation.
    """
    ship(sentences.sparkSession)
    text = F.col("text")
    rows = sentences.select("doc", "ord", "id", "text", "grp")
    passes = F.coalesce(language.is_already_in(text, F.lit(options.target), F.lit(options.source)), F.lit(False))
    key = keys.cache_key(F.coalesce(text, F.lit("")), F.lit(options.model), F.lit(options.target), keys.glossary_hash(keys.glossary_of(options.glossary)))
    # both are needed twice, for what is asked and for the results: worked out once and held
    rows = cut(rows.withColumn("passes", passes).withColumn("key", F.when(~F.col("passes"), key)))
    # equal keys are asked once: the first by document and place stands for all; a partial aggregate meets hot keys early
    asked = rows.where("not passes and text is not null").groupBy("key").agg(F.min(F.struct("doc", "ord", "text", "grp")).alias("first"))
    held = store.select("key", F.col("translation").alias("held"))
    todo = asked.join(held, "key", "left_anti").select("key", "first.*").withColumn("n_chars", F.length("text"))
    batched = batching.batches(todo, options.max_chars, options.max_sentences)
    requests = batched.groupBy("doc", "section", "batch").agg(F.sort_array(F.collect_list(F.struct("seq", "key", "text"))).alias("rows"))
    whole = F.array_join(F.transform("rows", lambda r: r["text"]), " ")
    source = F.lit(options.source) if options.source != P.AUTO else F.coalesce(language.detect_language(whole), F.lit(P.AUTO))
    # a call waits for its service most of the time: as many tasks as the session has, however small the requests are
    requests = requests.select("rows", source.alias("source")).repartition(partitions(sentences.sparkSession))
    answers = cut(requests.mapInArrow(_caller(client, options), _ANSWER))
    known = answers.select("key", "translation", "code", "args").unionByName(held.withColumnRenamed("held", "translation"), allowMissingColumns=True)
    results = rows.join(known, "key", "left").select(
        "doc", "id", F.when(F.col("passes"), F.col("text")).otherwise(F.col("translation")).alias("translation"),
        F.when(F.col("passes"), "").otherwise(F.col("key")).alias("cache_key"),
        F.when(F.col("passes"), F.lit(None)).otherwise(F.when(F.col("translation").isNull(), F.coalesce("code", F.lit("noTranslation")))).alias("code"), "args",
    )
    return results, answers


def without_key(sentences: DataFrame) -> DataFrame:
    """Results where a service needs a key and there is none: every sentence fails."""
    none = F.lit(None).cast("string")
    return sentences.select("doc", "id", none.alias("translation"), none.alias("cache_key"), F.lit("noApiKey").alias("code"), F.array().cast("array<string>").alias("args"))


def stats(answers: DataFrame, results: DataFrame) -> DataFrame:
    """Counters of a run: one row."""
    calls = answers.agg(F.coalesce(F.sum("api_calls"), F.lit(0)).alias("api_calls"), F.count("translation").alias("translated"), F.count("code").alias("failed"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
    outcome = results.agg(F.count_if(F.col("cache_key") == "").alias("passed"), F.count_if(F.col("code").isNull()).alias("done"))
    return calls.join(outcome, F.lit(True))  # one row each


class Service:
    """Enrichment as settings have it: client, options and store made of them, and made anew when they change."""

    def __init__(self, spark: SparkSession, settings: S.Settings, store: str, api_key: str = "", client: Client | None = None, on_change: Callable[[], None] | None = None):
        self.spark, self.store, self.api_key, self.given, self.on_change = spark, store, api_key, client, on_change
        self.configure(settings)

    def configure(self, settings: S.Settings) -> None:
        self.settings = settings
        self.options = Options(target=settings.target_language, source=settings.source_language, model=settings.model, glossary=settings.glossary, max_chars=int(settings.max_chars_per_request))
        self.client = self.given or HttpClient(settings.base_url, settings.model, self.api_key, settings.temperature, settings.request_timeout_ms / 1000, settings.extra_body)

    def changed(self, settings: S.Settings, api_key: str | None = None) -> None:
        """Settings or key have changed: what was made of them is dropped, then those who show results are told."""
        self.api_key = self.api_key if api_key is None else api_key
        self.configure(settings)
        if self.on_change is not None:
            self.on_change()

    def ready(self) -> bool:
        """Whether a call can be made: a key is there, or the address needs none."""
        address = self.spark.createDataFrame([(self.settings.base_url,)], "u string")
        return bool(self.given or self.api_key) or not address.select(S.needs_api_key(F.col("u")).alias("v")).first().v

    def translate(self, sentences: DataFrame) -> DataFrame:
        """Results of translate(), whose new entries are in the store when it returns."""
        if not self.ready():
            return without_key(sentences)
        results, answers = translate(sentences, cache.read(self.spark, self.store), self.client, self.options)
        results = cut(results)  # the store it was joined with is about to change
        self.flush(answers)
        return results

    def flush(self, answers: DataFrame) -> None:
        """Hand answers over to the store."""
        cache.upsert(answers.where("translation is not null").select("key", "translation", F.current_timestamp().alias("t")), self.store)
