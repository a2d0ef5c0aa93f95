"""Queries of the problems, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..sources.tables import table
from . import abuse, forms, langs, leaks, packing, pairs, pieces, sents
from ._sample import thinned


def _replies(requests: DataFrame, replies: DataFrame, rows: int = langs.SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of replies with the language that was asked for: about rows of them by hash."""
    kept = thinned(replies, rows, replies.count(), "request_id", "item_id").select("request_id", F.left("translation", F.lit(langs.SAMPLE_CHARS)).alias("text")).where("text <> ''").distinct()
    found = requests.join(F.broadcast(kept), "request_id").where("target_language <> ''").select("text", "target_language").distinct()
    return [tuple(r) for r in found.orderBy(F.xxhash64("text"), "text", "target_language").collect()]


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """The defective pairs of requests and items, with all labels that the label model keeps."""
    requests = table(spark, d, "requests", "request_id", "target_language", "item_ids")
    items = table(spark, d, "work_items", "item_id", "text", "source_language")
    replies = table(spark, d, "translated_items", "request_id", "item_id", "translation")
    model = langs.model_of(langs.sample_of(items.select("text", "source_language")), _replies(requests, replies))
    return pairs.defects(requests, items.select("item_id", "text"), replies, model)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_labels(spark, d).select("request_id", "item_id", F.element_at("labels", 1).alias("defect"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks", "block_no", "text", "profile_id")
    return pieces.pieces(blocks, table(spark, d, "translator_options", "profile_id", "max_chars_per_request", "overlap_chars"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that come out in more than one piece."""
    return p2_pieces(spark, d).where("piece_no = 1").select("block_no")


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "work_items", "item_id", "text", "source_language").toDF("rec_id", "text", "label")
    documents = table(spark, d, "documents", "doc_id", "text", "lang").toDF("rec_id", "text", "label")
    return items, documents


def _languages(spark: SparkSession, d: str, cases_only: bool) -> DataFrame:
    items, documents = _labelled(spark, d)
    model = langs.model_of(langs.sample_of(items.select("text", "label")), langs.sample_of(documents.select("text", "label")))
    parts = [langs.languages(df, model, by_line, cases_only).withColumn("tbl", F.lit(name)) for df, by_line, name in ((items, False, "work_items"), (documents, True, "documents"))]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d, True).select("tbl", "rec_id", "seg_no", "lang")


def p3_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every text and every stretch of a mixed one, with its language and a confidence."""
    return _languages(spark, d, False).select("tbl", "rec_id", "seg_no", "start_pos", "end_pos", "lang", "confidence")


def p4_strings(spark: SparkSession, d: str) -> DataFrame:
    """The strings of work_items and page_texts: (tbl, scope, id, text); a scope is what pairs must share."""
    items = table(spark, d, "work_items", "paper_id", "page", "item_id", "text").select(F.lit("work_items").alias("tbl"), F.when(F.col("page").isNotNull(), F.concat_ws("\u0000", "paper_id", F.col("page").cast("string"))).alias("scope"), F.col("item_id").alias("id"), "text", "paper_id")
    runs = table(spark, d, "page_texts", "paper_id", "text_items").select("paper_id", F.explode("text_items").alias("i")).select(F.lit("page_texts").alias("tbl"), F.col("paper_id").alias("scope"), F.col("i.run_id").alias("id"), F.col("i.str").alias("text"), "paper_id")
    return items.unionByName(runs).where("text <> '' and paper_id is not null").drop("paper_id")


def _speller(spark: SparkSession, d: str) -> forms.Spelling:
    """The speller of all texts of the two tables, also of those that are in no scope."""
    runs = table(spark, d, "page_texts", "text_items").select(F.explode("text_items").alias("i")).select(F.col("i.str").alias("text"))
    return forms.spelling_of(table(spark, d, "work_items", "text").unionByName(runs))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    strings = p4_strings(spark, d)
    return forms.with_canonical(spread(strings), "text", _speller(spark, d)).select("tbl", "id", "canonical").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    strings = p4_strings(spark, d)
    return forms.same_look(forms.with_canonical(spread(strings), "text", _speller(spark, d)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    items = sents.item_sentences(table(spark, d, "work_items", "item_id", "text")).select(F.lit("work_items").alias("tbl"), "rec_id", "end_pos")
    runs = sents.page_sentences(table(spark, d, "page_texts", "text_items", "view_box", "styles")).select(F.lit("page_texts").alias("tbl"), "rec_id", "end_pos")
    return items.unionByName(runs)


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves: (rec_id, start_pos, end_pos, sentence) of work_items."""
    items = table(spark, d, "work_items", "item_id", "text").where("text is not null").distinct()
    ends = sents.item_sentences(items)
    return ends.join(items, ends.rec_id == items.item_id).select("rec_id", "start_pos", "end_pos", F.expr("substring(text, start_pos + 1, end_pos - start_pos)").alias("sentence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).select("doc_id", "item_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The documents and items of p7_found with the share of the item that the document holds."""
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_budgets", "budget_id", "capacity_tokens"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p6_packing(spark, d), table(spark, d, "pack_budgets", "budget_id", "capacity_tokens"))


#: A document has language of a category where its score is this at least.
P8_CUTOFF = 0.5


def _judged(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text")
    return abuse.judged(documents, abuse.judge_of(documents, table(spark, d, "review_labels", "doc_id", "annotator", "label")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where((F.col("score") >= P8_CUTOFF) & (F.col("category") != abuse.GENERAL)).select("doc_id", "category").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score in each category and in general, 0 where nothing speaks for it, and the evidence for
    the highest."""
    every = (*abuse.CATEGORIES, abuse.GENERAL)
    scores = _judged(spark, d).groupBy("doc_id").agg(*[F.coalesce(F.max(F.when(F.col("category") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in every], F.max_by("evidence", "score").alias("evidence"))
    return table(spark, d, "documents", "doc_id", "source").join(scores, "doc_id", "left").fillna(0.0, list(every)).withColumn("score", F.greatest(*every))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source, how many have such language, and the rates."""
    rows = p8_scores(spark, d)
    flags = [F.sum((F.col(c) >= P8_CUTOFF).cast("long")).alias(f"n_{c}") for c in abuse.CATEGORIES]
    rates = rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum((F.col("score") >= P8_CUTOFF).cast("long")).alias("n_flagged"), *flags)
    return rates.withColumn("rate", F.col("n_flagged") / F.col("n_documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_labels, p2_found, p2_pieces, p3_found, p3_languages, p4_found, p4_canonical, p5_found, p5_sentences, p6_packing, p6_fill, p7_found, p7_shares, p8_found, p8_scores, p8_rates)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            SELECT DISTINCT b.block_no
            FROM blocks b LEFT JOIN translator_options o ON o.profile_id = b.profile_id
            WHERE length(b.text) > CASE WHEN o.max_chars_per_request >= 200 THEN o.max_chars_per_request ELSE 3000 END
        """,
    }
