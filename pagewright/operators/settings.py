"""Settings, providers, prompts and messages: small driver-side dimensions, and the same rules as column expressions."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns as P, text as T

# Presets of services - id, name, address, model, whether it runs on this machine.
PROVIDERS = (
    ("deepseek", "DeepSeek", "https://api.deepseek.com", "deepseek-flash", False),
    ("openai", "OpenAI", "https://api.openai.com/v1", "gpt-4.1-mini", False),
    ("qwen", "Qwen (Alibaba Cloud Model Studio)", "https://dashscope.aliyuncs.com/compatible-mode/v1", "qwen-plus", False),
    ("kimi", "Kimi (Moonshot AI)", "https://api.moonshot.cn/v1", "moonshot-v1-32k", False),
    ("glm", "GLM (Zhipu AI)", "https://open.bigmodel.cn/api/paas/v4", "glm-4-flash", False),
    ("siliconflow", "SiliconFlow", "https://api.siliconflow.cn/v1", "deepseek-ai/DeepSeek-V3", False),
    ("openrouter", "OpenRouter", "https://openrouter.ai/api/v1", "openai/gpt-4o-mini", False),
    ("gemini", "Google Gemini", "https://generativelanguage.googleapis.com/v1beta/openai", "gemini-2.5-flash", False),
    ("ollama", "Ollama", "http://localhost:11434/v1", "qwen2.5:7b", True),
    ("lmstudio", "LM Studio", "http://localhost:1234/v1", "", True),
)
LOCAL_HOSTS = ("localhost", "127.0.0.1", "[::1]", "::1")
#: Error codes, which are fixed values, and what they say.
ERRORS = {
    "badRequest": "The service did not accept the request (400); model or extra fields may be wrong.",
    "unauthorized": "The service did not accept the key (401).",
    "insufficientBalance": "The account has no credit left (402).",
    "notFound": "Nothing at this address, or no such model (404).",
    "invalidParams": "The service did not accept a parameter (422); model or extra fields may be wrong.",
    "timeout": "No reply within {0} s.",
    "network": "No connection: {0}",
    "http": "The service replied with status {0}: {1}",
    "noTranslation": "The reply holds no translation.",
    "cancelled": "Stopped before it was done.",
    "noApiKey": "There is no key for the service.",
}
STATUS_CODES = {400: "badRequest", 401: "unauthorized", 402: "insufficientBalance", 404: "notFound", 422: "invalidParams"}
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)
RANGES = ("page", "nearby", "manual")


@dataclass(frozen=True)
class Settings:
    """Twelve settings; what is missing or senseless has the default."""

    base_url: str = "https://api.deepseek.com"
    model: str = "deepseek-flash"
    temperature: float = 0.7
    request_timeout_ms: float = 60_000
    max_chars_per_request: float = 3000
    glossary: dict[str, str] = field(default_factory=dict)
    translate_range: str = "nearby"
    cache_dir: str = ""
    extra_body: dict[str, Any] = field(default_factory=dict)
    target_language: str = P.DEFAULT_TARGET
    target_language_is_auto: bool = True
    source_language: str = P.AUTO


_CODES = [row[0] for row in P.LANGUAGES]


def resolve_target(setting: Any, display: str) -> str:
    if setting in _CODES:
        return setting
    ui = display.lower()
    if ui.startswith("zh"):
        return "zh-TW" if ui in ("zh-tw", "zh-hk", "zh-hant") else "zh-CN"
    base = ui.partition("-")[0]
    return base if base in _CODES else P.FALLBACK_TARGET


def glossary_for(raw: Any, target: str) -> dict[str, str]:
    """Terms of all languages, overlaid by those of one; blank terms and renderings that are no string are left out."""
    layers = [raw, raw.get(target) if target in _CODES else None] if isinstance(raw, dict) else []
    return {term.strip(): text for layer in layers if isinstance(layer, dict) for term, text in layer.items() if term.strip() and isinstance(text, str)}


def read_settings(raw: dict[str, Any], display: str = "en") -> Settings:
    """Settings as a user wrote them, made sound."""
    d = Settings()

    def number(key: str, default: float, least: float) -> float:
        value = raw.get(key, default)
        sound = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and value >= least
        return value if sound else default

    def string(key: str, default: str) -> str:
        value = raw.get(key, default)
        return value.strip() if isinstance(value, str) else default

    target = resolve_target(raw.get("targetLanguage", P.AUTO), display)
    return Settings(
        base_url=string("baseUrl", d.base_url) or d.base_url,
        model=string("model", d.model) or d.model,
        temperature=min(2, number("temperature", d.temperature, 0)),
        request_timeout_ms=number("requestTimeout", d.request_timeout_ms, 1000),
        max_chars_per_request=number("maxCharsPerRequest", d.max_chars_per_request, 200),
        glossary=glossary_for(raw.get("glossary"), target),
        translate_range=raw.get("translateRange") if raw.get("translateRange") in RANGES else d.translate_range,
        cache_dir=string("cacheDir", d.cache_dir),
        extra_body=raw["extraBody"] if isinstance(raw.get("extraBody"), dict) else {},
        target_language=target,
        target_language_is_auto=raw.get("targetLanguage") not in _CODES,
        source_language=raw.get("sourceLanguage") if raw.get("sourceLanguage") in _CODES else P.AUTO,
    )


def sound_limit(limit: Column, default: float = Settings.max_chars_per_request, least: float = 200) -> Column:
    """A limit as column: null, and what is below the least, are the default."""
    return F.when(limit >= least, limit).otherwise(default)


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PROVIDERS)], "ord int, id string, name string, base_url string, model string, local boolean")


def errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERRORS.items()), "code string, template string")


def normalize_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(T.trim_blanks(url), "/+$", ""))


def provider_of(urls: DataFrame) -> DataFrame:
    """urls(base_url, ...) with the id of the preset at that address, if there is one."""
    presets = providers(urls.sparkSession).select(normalize_url(F.col("base_url")).alias("_url"), F.col("id").alias("provider"))
    return urls.join(presets, normalize_url(urls["base_url"]) == F.col("_url"), "left").drop("_url")


def needs_api_key(url: Column) -> Column:
    """Servers on this machine need none; an address that cannot be read counts as one that does."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(~host.isin(*LOCAL_HOSTS), F.lit(True))


def request_extras(base_url: str, extra: dict[str, Any]) -> dict[str, Any]:
    """Fields to add to a request: the user's, and one default of one service."""
    host = re.match(r"https?://([^/:]+)", base_url.strip().lower())
    return {**({"thinking": {"type": "disabled"}} if host and host[1] == "api.deepseek.com" else {}), **extra}


def error_message(code: Column, args: Column, fallback: Column) -> Column:
    """Text of an error code, or the fallback where the code is unknown."""
    template = F.element_at(F.create_map(*[F.lit(x) for pair in ERRORS.items() for x in pair]), code)
    return F.coalesce(T.format_message(template, args), fallback)


def _described(code: str) -> str:
    english, own = next((row[1], row[2]) for row in P.LANGUAGES if row[0] == code)
    return english if english == own else f"{english} ({own})"


def system_prompt(glossary: dict[str, str], target: str, source: str = P.AUTO) -> str:
    """Instructions of a request, the same text for the same arguments; an unsupported pair raises ValueError."""
    if target not in _CODES or source not in (P.AUTO, *_CODES):
        raise ValueError(f"Unsupported language pair: {source} → {target}")
    english, note = next((row[1], row[5]) for row in P.LANGUAGES if row[0] == target)
    origin = "the language it is written in" if source == P.AUTO else _described(source)
    shape = {"in": {"sentences": [{"id": "s1", "text": "..."}]}, "out": {"translations": [{"id": "s1", "translation": "..."}]}}
    parts = [
        f"The user sends sentences of a research paper as JSON. Render every one of them from {origin} into {_described(target)}.",
        f"Write as papers in {english} are written: exact, and no longer than needed." + (f" {note}" if note else ""),
        "Each id gets one rendering. Do not join or divide sentences, and leave none out.",
        "Formulas, symbols, code, abbreviations, citation marks and the names of models and datasets stay as they are.",
        "The layout may have cut a sentence off. Render what is there; add neither its rest nor remarks.",
        f"The user sends {json.dumps(shape['in'])}; reply with JSON alone: {json.dumps(shape['out'])}",
    ]
    if glossary:
        parts.append("Fixed terms:\n" + "\n".join(f"{term} = {rendering}" for term, rendering in sorted(glossary.items())))
    return "\n".join(parts)


def prompts(spark: SparkSession, target: str, glossary: dict[str, str] | None = None) -> DataFrame:
    """The prompt of each source language for one target: a dimension of twelve rows."""
    return spark.createDataFrame([(source, target, system_prompt(glossary or {}, target, source)) for source in (P.AUTO, *_CODES)], "source string, target string, prompt string")


def overlaid(strings: DataFrame, defaults: DataFrame) -> DataFrame:
    """(name, value): defaults(name, value), replaced where strings(name, value) has a text that is not empty."""
    given = strings.groupBy("name").agg(F.max("value").alias("given"))
    return defaults.join(given, "name", "left").select("name", F.coalesce(F.nullif(F.col("given"), F.lit("")), F.col("value")).alias("value"))


def suggested_first(choices: DataFrame, suggestions: DataFrame) -> DataFrame:
    """choices(code, ord, ...) with place, in the order they are offered: suggestions(code, rank) first, then the others in
    their own order."""
    ranked = suggestions.groupBy("code").agg(F.min("rank").alias("rank"))
    rows = choices.join(ranked, "code", "left")
    place = F.row_number().over(Window.orderBy(F.col("rank").asc_nulls_last(), "ord"))  # a short list of choices
    return rows.withColumn("place", place).drop("rank")


def other_providers(spark: SparkSession, base_url: str) -> DataFrame:
    """The presets but the one in use."""
    current = spark.createDataFrame([(base_url,)], "base_url string").select(normalize_url(F.col("base_url")).alias("url"))
    presets = providers(spark)
    return presets.join(current, normalize_url(presets["base_url"]) == current["url"], "left_anti")


def target_unset(*scopes: Column) -> Column:
    """Whether no scope has a value."""
    return F.coalesce(*scopes).isNull()
