"""Rule-based language functions: by script, by frequent characters and by function words, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import patterns as P


def languages(spark: SparkSession) -> DataFrame:
    """The dimension of languages, eleven rows."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(P.LANGUAGES)], "ord int, code string, english_name string, native_name string, script string, spaced boolean, prompt_note string")


def _lookup(code: Column, place: int) -> Column:
    pairs = [F.lit(x) for row in P.LANGUAGES for x in (row[0], row[place])]
    return F.element_at(F.create_map(*pairs), code)


def script_of(code: Column) -> Column:
    return _lookup(code, 3)


def is_spaced(code: Column) -> Column:
    return _lookup(code, 4)


def is_supported(code: Column) -> Column:
    return F.coalesce(code.isin([row[0] for row in P.LANGUAGES]), F.lit(False))


def script_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in P.SCRIPTS.items()}


def script_shares(text: Column) -> dict[str, Column]:
    """Share of each script among the letters of all five; 0 without letters."""
    counts = script_counts(text)
    total = sum(list(counts.values())[1:], list(counts.values())[0])
    return {name: F.coalesce(count / F.nullif(total, F.lit(0)), F.lit(0.0)) for name, count in counts.items()}


def once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: expressions inside CASE are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def stop_word_hits(text: Column) -> Column:
    """Struct of how many words of a text are function words of each language; the text is read once."""
    lists = {code: row.split() for code, row in P.STOP_WORDS.items()}
    every = sorted({w for row in lists.values() for w in row})
    count = lambda kept, row: F.size(F.filter(kept, lambda w: w.isin(row)))
    kept = F.filter(words(text), lambda w: w.isin(every))
    return once(kept, lambda k: F.struct(*[count(k, row).alias(code) for code, row in lists.items()]))


def detect_latin(text: Column) -> Column:
    """The language with the most function words, if it is one; a single one decides only where no other has any."""
    ranked = lambda hits: F.sort_array(F.array(*[F.struct(hits[code].alias("n"), F.lit(code).alias("code")) for code in P.STOP_WORDS]), asc=False)

    def best(rows: Column) -> Column:
        first, second = F.get(rows, F.lit(0)), F.get(rows, F.lit(1))
        return F.when((first["n"] > second["n"]) & ((first["n"] >= 2) | (second["n"] == 0)), first["code"])

    return once(once(stop_word_hits(text), ranked), best)


def _counted(text: Column) -> Column:
    counts = script_counts(text)
    return F.struct(*[c.alias(n) for n, c in counts.items()])


def _total(counts: Column) -> Column:
    names = list(P.SCRIPTS)
    return sum((counts[n] for n in names[1:]), counts[names[0]])


def _detect(counts: Column, text: Column) -> Column:
    more = lambda n: n * 2 > _total(counts)
    forms = F.when(F.regexp_count(text, F.lit(f"[{P.TRADITIONAL}]")) > F.regexp_count(text, F.lit(f"[{P.SIMPLIFIED}]")), "zh-TW").otherwise("zh-CN")
    return (
        F.when(_total(counts) == 0, F.lit(None))
        .when((counts["kana"] > 0) & more(counts["han"] + counts["kana"]), "ja")
        .when(more(counts["hangul"]), "ko")
        .when(more(counts["han"]), forms)
        .when(more(counts["cyrillic"]), "ru")
        .when(more(counts["latin"]), detect_latin(text))
    )


def detect_language(text: Column) -> Column:
    """Code of the language, or null when unsure."""
    return once(_counted(text), lambda counts: _detect(counts, text))


def is_already_in(text: Column, target: Column, source: Column) -> Column:
    """Whether a text needs no translation. An undetected one counts as the source language where that is set and is the
    target, and most letters are of the target's script."""

    def decide(counts: Column) -> Column:
        own = F.element_at(F.create_map(*[x for name in P.SCRIPTS for x in (F.lit(name), counts[name])]), script_of(target))
        unsure = F.coalesce((source == target) & (own * 2 > _total(counts)), F.lit(False))
        return F.coalesce(_detect(counts, text) == target, unsure)

    return once(_counted(text), decide)


def resolve_target(setting: Column, display: Column) -> Column:
    """A supported code as it is; else the language of the display, else English."""
    ui = F.lower(display)
    base = F.substring_index(ui, "-", 1)
    by_display = F.when(ui.isin("zh-tw", "zh-hk", "zh-hant"), "zh-TW").when(ui.startswith("zh"), P.DEFAULT_TARGET).when(is_supported(base), base).otherwise(P.FALLBACK_TARGET)
    return F.when(is_supported(setting) & (setting != P.AUTO), setting).otherwise(by_display)


def resolve_source(setting: Column) -> Column:
    return F.when(is_supported(setting), setting).otherwise(P.AUTO)


def supported_of(locale: Column) -> Column:
    """The language of a locale, if it is supported."""
    found = resolve_target(F.lit(None).cast("string"), locale)
    return F.when(F.lower(locale).startswith(F.lower(F.substring_index(found, "-", 1))), found)
