"""Queries on texts: scans, keys, languages, sentences. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, language, patterns as P, sentences as S, text as T
from ..operators import cache
from ..session import spread
from ..sources.tables import table
from . import oracle as O

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows of blocks as they stand, copies too: see once()."""
    return spread(table(spark, d, "blocks", "block_no", *columns))


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows of work items as they stand, copies too."""
    return spread(table(spark, d, "work_items", "item_id", *columns))


def once(rows: DataFrame, *columns) -> DataFrame:
    """Columns of rows(text, ...), copies of a row once. What is worked out of a text moves, and its hash, not the text."""
    return rows.where("text is not null").select(*columns, F.xxhash64("text").alias("_text")).distinct().drop("_text")


BLOCKS = "(SELECT DISTINCT block_no, text FROM blocks WHERE text IS NOT NULL)"
ITEMS = "(SELECT DISTINCT item_id, text FROM work_items WHERE text IS NOT NULL)"


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200")
def q01_scan_filter_project(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "n_chars", "lang").where("lang = 'en' AND n_chars >= 200").select("doc_id", "source", "n_chars")


@query("""
    SELECT doc_id, idx AS block_idx, 'p1-b' || idx AS block_id, line AS text FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS idx FROM documents)
    WHERE regexp_matches(line, '\\p{L}')""")
def q02_explode_blocks(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    idx = F.col("pos").cast("long") + 1
    return lines.where(T.has_letter(F.col("text"))).select("doc_id", idx.alias("block_idx"), F.concat(F.lit("p1-b"), idx).alias("block_id"), "text")


@query(f"SELECT item_id, {O.normalize('text')} AS normalized FROM {ITEMS}")
def q03_normalize_source(spark, d):
    return once(items(spark, d, "text"), "item_id", T.normalize_source(F.col("text")).alias("normalized"))


_KEY_SQL = f"sha1({O.normalize('text')} || chr(0) || model || chr(0) || target || chr(0) || '{P.PROMPT_VERSION}' || chr(0) || '97d170e1550e')"
#: Hash of an empty glossary, as keys.glossary_hash gives it.
NO_GLOSSARY = "97d170e1550e"


def keyed(spark, d, model: str = "m1", target: str = "zh-CN") -> DataFrame:
    return once(items(spark, d, "text", "paper_id"), "item_id", "paper_id", keys.cache_key(F.col("text"), F.lit(model), F.lit(target), F.lit(NO_GLOSSARY)).alias("key"))


KEYED = f"(SELECT *, {_KEY_SQL} AS key FROM (SELECT DISTINCT item_id, text, paper_id, 'm1' AS model, 'zh-CN' AS target FROM work_items WHERE text IS NOT NULL))"


@query(f"SELECT item_id, key, left(key, 2) AS shard FROM {KEYED}")
def q04_cache_key(spark, d):
    return keyed(spark, d).select("item_id", "key", keys.shard(F.col("key")).alias("shard"))


@query(f"SELECT key, min(item_id) AS first_item, count(*) AS n_items FROM {KEYED} GROUP BY key")
def q05_dedup_by_key(spark, d):
    return keyed(spark, d).groupBy("key").agg(F.min("item_id").alias("first_item"), F.count("*").alias("n_items"))


_CACHE_SQL = f"(SELECT cache_key AS key, max(translation) AS translation FROM translated_items WHERE cache_key <> '' AND {O.trim_blanks('translation')} <> '' GROUP BY cache_key)"


def stored(spark, d) -> DataFrame:
    """What earlier replies left in the cache: key and translation."""
    rows = table(spark, d, "translated_items", "cache_key", "translation").where((F.col("cache_key") != "") & (T.trim_blanks(F.col("translation")) != ""))
    return rows.groupBy(F.col("cache_key").alias("key")).agg(F.max("translation").alias("translation"))


@query(f"""
    SELECT r.request_id, count(*) AS n_keys, count(c.key) AS n_hits
    FROM (SELECT DISTINCT r.request_id, sha1({O.normalize('w.text')} || chr(0) || r.model || chr(0) || r.target || chr(0) || '1' || chr(0) || '97d170e1550e') AS key
        FROM (SELECT request_id, model, target_language AS target, unnest(item_ids) AS item_id FROM requests) r JOIN {ITEMS} w ON w.item_id = r.item_id) r
    LEFT JOIN {_CACHE_SQL} c ON c.key = r.key GROUP BY r.request_id""")
def q06_cache_hit_miss(spark, d):
    """For each request the keys of its items, and how many of them the whole store of earlier replies holds."""
    asked = table(spark, d, "requests", "request_id", "model", "target_language", "item_ids").select("request_id", "model", "target_language", F.explode("item_ids").alias("item_id"))
    text = once(items(spark, d, "text"), "item_id", T.normalize_source(F.col("text")).alias("normalized"))
    rows = asked.join(text, "item_id").select("request_id", keys.key_of_normalized(F.col("normalized"), F.col("model"), F.col("target_language"), F.lit(NO_GLOSSARY)).alias("key")).distinct()
    hits, misses = cache.split(rows, stored(spark, d))
    counted = hits.select("request_id", F.lit(1).alias("hit")).unionByName(misses.select("request_id", F.lit(0).alias("hit")))
    return counted.groupBy("request_id").agg(F.count("*").alias("n_keys"), F.sum("hit").alias("n_hits"))


@query(f"SELECT DISTINCT t.item_id, c.translation FROM translated_items t JOIN {_CACHE_SQL} c ON c.key = t.cache_key")
def q07_fan_out(spark, d):
    ids = table(spark, d, "translated_items", "item_id", "cache_key").withColumnRenamed("cache_key", "key")
    return ids.join(stored(spark, d), "key").select("item_id", "translation").distinct()


@query(f"SELECT left(key, 2) AS shard, count(DISTINCT key) AS n_keys FROM {KEYED} GROUP BY 1")
def q08_shard_histogram(spark, d):
    return keyed(spark, d).groupBy(keys.shard(F.col("key")).alias("shard")).agg(F.count_distinct("key").alias("n_keys"))


@query("SELECT block_no, " + ", ".join(f"coalesce({O.script_count('text', s)} / nullif(" + " + ".join(O.script_count("text", x) for x in P.SCRIPTS) + f", 0), 0)::DOUBLE AS {s}" for s in P.SCRIPTS) + f" FROM {BLOCKS}")
def q09_script_shares(spark, d):
    shares = language.script_shares(F.col("text"))
    return once(blocks(spark, d, "text"), "block_no", *[c.alias(n) for n, c in shares.items()])


@query("SELECT block_no, " + ", ".join(f"{O.stop_hits('text', c)}::BIGINT AS {c}" for c in P.STOP_WORDS) + f" FROM {BLOCKS}")
def q10_stop_word_hits(spark, d):
    return once(blocks(spark, d, "text"), "block_no", language.stop_word_hits(F.col("text")).alias("hits")).select("block_no", *[F.col(f"hits.{c}").cast("long").alias(c) for c in P.STOP_WORDS])


@query(O.detect("(SELECT DISTINCT item_id, text FROM work_items WHERE text IS NOT NULL)", "item_id", "text"))
def q11_detect_language(spark, d):
    return once(items(spark, d, "text"), "item_id", language.detect_language(F.col("text")).alias("lang"))


@query("""
    SELECT target, count(*) AS n, count_if(lang = target) AS n_passed, count_if(lang = target) >= 3 AND 2 * count_if(lang = target) >= count(*) AS mostly
    FROM (""" + O.detect("(SELECT DISTINCT item_id, text FROM work_items WHERE text IS NOT NULL)", "item_id", "text") + """) CROSS JOIN (SELECT unnest(['zh-CN', 'zh-TW', 'en', 'ja', 'ko', 'fr', 'de', 'es', 'pt', 'ru', 'it']) AS target)
    GROUP BY target""")
def q12_pass_through(spark, d):
    """How much of the work is already in each of the target languages."""
    rows = once(items(spark, d, "text"), "item_id", language.detect_language(F.col("text")).alias("lang"))
    rows = rows.groupBy("lang").count()  # twelve rows at most, before targets multiply them
    targets = F.explode(F.array(*[F.lit(row[0]) for row in P.LANGUAGES])).alias("target")
    passed = F.sum(F.when(F.col("lang") == F.col("target"), F.col("count")).otherwise(0))
    return rows.select("lang", "count", targets).groupBy("target").agg(F.sum("count").alias("n"), passed.alias("n_passed"), ((passed >= 3) & (2 * passed >= F.sum("count"))).alias("mostly"))


@query(f"SELECT block_no, regexp_matches(regexp_replace(text, {O.re2(f'[{P.BLANK}]+$')}, ''), {O.re2(P.TERMINAL_END)}) AS terminal FROM {BLOCKS}")
def q13_ends_with_terminal(spark, d):
    return once(blocks(spark, d, "text"), "block_no", T.ends_with_terminal(F.col("text")).alias("terminal"))


_GARBLED_CLASS = f"[\\p{{L}}{P.BLANK}]"


@query(f"SELECT item_id, regexp_matches(text, '\\p{{L}}') AS letters, {O.count('text', _GARBLED_CLASS)} < 0.5 * length(text) AS garbled FROM {ITEMS}")
def q14_garbled(spark, d):
    return once(items(spark, d, "text"), "item_id", T.has_letter(F.col("text")).alias("letters"), T.is_garbled(F.col("text")).alias("garbled"))


@query(f"SELECT block_no, regexp_matches(text, {O.re2(P.CAPTION)}) AS caption, regexp_matches(text, {O.re2(P.SECTION_NUMBER)}) AS section, regexp_matches(text, {O.re2(P.LIST_MARKER)}) AS list FROM {BLOCKS}")
def q15_layout_flags(spark, d):
    text = F.col("text")
    return once(blocks(spark, d, "text"), "block_no", T.is_caption(text).alias("caption"), T.has_section_number(text).alias("section"), T.is_list_item(text).alias("list"))


def _sentences(spark, d) -> DataFrame:
    numbered = F.transform(S.split_sentences(F.col("text")), lambda s, i: F.struct((i.cast("long") + 1).alias("idx"), s.alias("sentence")))
    rows = once(blocks(spark, d, "text"), "block_no", F.filter(numbered, lambda s: S.is_sentence(s["sentence"])).alias("s"))
    return rows.select("block_no", F.explode_outer("s").alias("s")).where("s is not null").select("block_no", "s.idx", "s.sentence")


@query(f"WITH {O.sentences(BLOCKS, 'block_no', 'text')} SELECT block_no, idx, sentence FROM sentences WHERE {O.IS_SENTENCE}")
def q16_split_sentences(spark, d):
    return _sentences(spark, d)


@query(f"WITH {O.sentences(BLOCKS, 'block_no', 'text')} SELECT block_no, count(*) AS n, sum(length(sentence))::BIGINT AS chars, max(length(sentence))::BIGINT AS longest FROM sentences WHERE {O.IS_SENTENCE} GROUP BY block_no")
def q17_sentence_stats(spark, d):
    size = F.length("sentence").cast("long")
    return _sentences(spark, d).groupBy("block_no").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.max(size).alias("longest"))


_CJK1 = O.re2(f"^[{P.CJK}]")


@query(f"""
    SELECT run_id, CASE
        WHEN regexp_matches(right(str, 1), {_CJK1}) OR regexp_matches(left(nxt, 1), {_CJK1}) THEN 'join'
        WHEN NOT (regexp_matches(right(str, 1), '[{P.LINE_BREAK_HYPHENS}]') AND length(str) >= 2 AND regexp_matches(str[-2:-2], '^\\p{{L}}') AND regexp_matches(left(nxt, 1), '^\\p{{L}}')) THEN 'space'
        WHEN regexp_matches(left(nxt, 1), '^\\p{{Ll}}') THEN 'merge' ELSE 'keep' END AS how
    FROM (
        SELECT i.run_id AS run_id, i.str AS str, lead(i.str) OVER (PARTITION BY paper_id, page ORDER BY ord) AS nxt FROM (
            SELECT paper_id, page, unnest(text_items) AS i, generate_subscripts(text_items, 1) AS ord FROM (SELECT DISTINCT paper_id, page, text_items FROM page_texts)) WHERE i.str <> '' AND i.height = 10)
    WHERE nxt IS NOT NULL""")
def q18_line_join(spark, d):
    """How each line of a page goes on; the next one comes from the page's own array, so nothing is shuffled for it."""
    pages = table(spark, d, "page_texts", "paper_id", "page", "text_items").dropDuplicates(["paper_id", "page", "text_items"])
    lines = F.filter("text_items", lambda i: (i["str"] != "") & (i["height"] == 10))
    rows = pages.select(F.explode(F.arrays_zip(lines.alias("a"), F.slice(F.concat(F.transform(lines, lambda i: i["str"]), F.array(F.lit(None).cast("string"))), F.lit(2), F.size(lines) + 1).alias("b"))).alias("z")).select("z.*").toDF("i", "nxt")
    return rows.where("nxt is not null").select("i.run_id", T.line_join(F.col("i.str"), F.col("nxt")).alias("how"))


@query(f"""
    SELECT * FROM (SELECT s.setting, s.display, CASE
            WHEN s.setting IN {O.words(r[0] for r in P.LANGUAGES)} THEN s.setting
            WHEN lower(s.display) IN ('zh-tw', 'zh-hk', 'zh-hant') THEN 'zh-TW'
            WHEN starts_with(lower(s.display), 'zh') THEN 'zh-CN'
            WHEN split_part(lower(s.display), '-', 1) IN {O.words(r[0] for r in P.LANGUAGES)} THEN split_part(lower(s.display), '-', 1)
            ELSE 'en' END AS target
        FROM (SELECT DISTINCT target_language AS setting, source_language AS display FROM (SELECT DISTINCT target_language FROM requests), (SELECT DISTINCT source_language FROM work_items WHERE source_language IS NOT NULL)) s)""")
def q23_resolve_target(spark, d):
    settings = table(spark, d, "requests", "target_language").distinct().withColumnRenamed("target_language", "setting")
    displays = table(spark, d, "work_items", "source_language").where("source_language is not null").distinct().withColumnRenamed("source_language", "display")
    # two short lists of codes, reduced before they meet
    return settings.join(displays, F.lit(True)).select("setting", "display", language.resolve_target(F.col("setting"), F.col("display")).alias("target"))


@query("""
    SELECT request_id, item_id, replace(replace(replace('Item {0} of request {1} in {2}, {3}', '{0}', item_id::VARCHAR), '{1}', request_id::VARCHAR), '{2}', coalesce(paper_id, '{2}')) AS message
    FROM (SELECT DISTINCT request_id, item_id, paper_id FROM translated_items)""")
def q37_format_message(spark, d):
    rows = table(spark, d, "translated_items", "request_id", "item_id", "paper_id").distinct()
    args = F.array(F.col("item_id").cast("string"), F.col("request_id").cast("string"), F.col("paper_id"))
    return rows.select("request_id", "item_id", T.format_message(F.lit("Item {0} of request {1} in {2}, {3}"), args).alias("message"))


_SWAPPED = "translate(term, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"


@query(f"""
    SELECT source, left(sha1('[' || string_agg('["' || term || '","' || rendering || '"]', ',' ORDER BY lower(term), {_SWAPPED}) || ']'), 12) AS hash FROM (
        SELECT source, lang AS term, count(*)::VARCHAR AS rendering FROM documents WHERE regexp_matches(lang, '^[A-Za-z]+$') GROUP BY ALL) GROUP BY source""")
def q51_glossary_hash(spark, d):
    """Hashes of glossaries made of the labels of each source; of labels in letters only, whose order SQL can state."""
    rows = table(spark, d, "documents", "source", "lang").where("lang rlike '^[A-Za-z]+$'").groupBy("source", "lang").count()
    glossaries = rows.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", F.col("count").cast("string")))).alias("g"))  # labels, not rows
    return glossaries.select("source", keys.glossary_hash(F.col("g")).alias("hash"))
