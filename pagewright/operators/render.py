"""From blocks, sentences and translations to what is shown, in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language, text as T


def shown(text: Column, translation: Column, target: Column) -> Column:
    """A sentence as it is shown: its translation, else the original; a space after it where the language has them."""
    spaced = F.coalesce(language.is_spaced(target), F.lit(True))
    return F.when(translation.isNotNull(), F.when(spaced, F.concat(translation, F.lit(" "))).otherwise(translation)).otherwise(T.with_space(text))


def paragraphs(sentences: DataFrame, translations: DataFrame, target: str) -> DataFrame:
    """(doc, grp, target_text, source_text) of sentences(doc, grp, ord, id, text) and translations(doc, id, translation)."""
    rows = sentences.join(translations.select("doc", "id", "translation"), ["doc", "id"], "left")
    rows = rows.withColumn("shown", shown(F.col("text"), F.col("translation"), F.lit(target))).withColumn("plain", T.with_space(F.col("text")))
    grouped = rows.groupBy("doc", "grp").agg(F.sort_array(F.collect_list(F.struct("ord", "shown", "plain"))).alias("s"))  # a paragraph
    return grouped.select("doc", "grp", F.array_join(F.transform("s", lambda s: s["shown"]), "").alias("target_text"), F.array_join(F.transform("s", lambda s: s["plain"]), "").alias("source_text"))


def sections(blocks: DataFrame) -> DataFrame:
    """(doc, page, first_idx, role, n_blocks, text): blocks(doc, page, idx, role, text) as they are shown.

    Figures that follow each other are one place-holder without text; code blocks one listing, which figures between them do
    not break; every other block stands for itself. Blocks stay in the order of their first one.
    """
    page = Window.partitionBy("doc", "page").orderBy("idx")  # a page has few blocks
    figure, code = F.col("role") == "figure", F.col("role") == "code"
    rows = blocks.withColumn("run", F.sum(F.when(figure, 0).otherwise(1)).over(page)).withColumn("listing", F.sum(F.when(figure | code, 0).otherwise(1)).over(page))
    part = F.when(figure, F.concat(F.lit("f"), "run")).when(code, F.concat(F.lit("c"), "listing")).otherwise(F.concat(F.lit("b"), "idx"))
    grouped = rows.withColumn("part", part).groupBy("doc", "page", "part").agg(F.min("idx").alias("first_idx"), F.min("role").alias("role"), F.count("*").alias("n_blocks"), F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("t"))
    text = F.when(F.col("role") != "figure", F.array_join(F.transform("t", lambda t: t["text"]), "\n"))
    return grouped.select("doc", "page", "first_idx", "role", "n_blocks", text.alias("text"))


def in_order(shown: DataFrame) -> DataFrame:
    """Sections or paragraphs in the order they are read: by document, page and place, whenever they came."""
    return shown.orderBy("doc", "page", "first_idx")
