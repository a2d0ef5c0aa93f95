"""Packing of sentences into requests by a budget of characters and a number of sentences, in order.

Where the next request starts depends on all before it in the same document, so documents are folded in an Arrow kernel;
but the order within a document is all that matters: documents are independent.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language
from ..session import ship

# Budgets of a request, its tokens, and characters to tokens.
MAX_CHARS, MAX_SENTENCES = 3000, 40
MAX_TOKENS, TOKENS_A_SENTENCE, TOKENS_FIXED, TOKENS_DENSE, TOKENS_A_CHAR = 8192, 30, 256, 1.5, 0.8


def pack(sizes: list[int], groups: list[str | None], max_chars: int = MAX_CHARS, max_sentences: int = MAX_SENTENCES) -> list[int]:
    """The request of each sentence. Neighbours of one group stay together if they fit; what does not is split, and leaves
    its last request open for the next group."""
    out: list[int] = []
    request, chars, count = 0, 0, 0
    start = 0
    while start < len(sizes):
        end = start + 1
        while end < len(sizes) and groups[start] is not None and groups[end] == groups[start]:
            end += 1
        whole = sum(sizes[start:end])
        if count and (chars + whole > max_chars or count + end - start > max_sentences):
            request, chars, count = request + 1, 0, 0
        for size in sizes[start:end]:
            if count and (chars + size > max_chars or count >= max_sentences):
                request, chars, count = request + 1, 0, 0
            out.append(request)
            chars, count = chars + size, count + 1
        start = end
    return out


def batches(sentences: DataFrame, max_chars: int = MAX_CHARS, max_sentences: int = MAX_SENTENCES, part: int = 50_000) -> DataFrame:
    """sentences(doc, ord, grp, n_chars, ...) with batch and seq (place in it) added.

    doc may be null: such rows are one document. A document is packed in sections of part places of ord, so that one task
    never holds an unbounded document; a section starts a new request. Batches are numbered within document and section.
    """
    ship(sentences.sparkSession)
    # sections: ranges of ord, so that no window over a whole document is needed
    rows = sentences.withColumn("section", F.floor(F.col("ord") / part))
    names = [f.name for f in rows.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", batch bigint, seq int"

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending")])
        placed = pack(table["n_chars"].to_pylist(), table["grp"].to_pylist(), max_chars, max_sentences)
        seq, last = [], None
        for b in placed:
            seq.append(seq[-1] + 1 if b == last else 1)
            last = b
        return table.select(names).append_column("batch", pa.array(placed, pa.int64())).append_column("seq", pa.array(seq, pa.int32()))

    return rows.groupBy("doc", "section").applyInArrow(fold, schema)


def max_tokens(chars: Column, count: Column, source: Column) -> Column:
    """Output budget of a request; a character of the dense scripts stands for more."""
    each = F.when(language.script_of(source).isin("han", "kana", "hangul"), TOKENS_DENSE).otherwise(TOKENS_A_CHAR)
    return F.least(F.lit(MAX_TOKENS), (F.ceil(chars * each) + TOKENS_A_SENTENCE * count + TOKENS_FIXED).cast("int"))


def requests_of(batched: DataFrame) -> DataFrame:
    """One row a request: its language, sizes, token budget and message, from batched rows with text."""
    grouped = batched.groupBy("doc", "section", "batch").agg(
        F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("rows"), F.sum("n_chars").alias("chars"), F.count("*").alias("n_sentences")
    )  # at most max_sentences rows each
    source = F.coalesce(language.detect_language(F.array_join(F.transform("rows", lambda r: r["text"]), " ")), F.lit("auto"))
    message = F.to_json(F.struct(F.transform("rows", lambda r: F.struct(F.concat(F.lit("s"), r["seq"]).alias("id"), r["text"].alias("text"))).alias("sentences")))
    return grouped.withColumn("source", source).select("doc", "section", "batch", "chars", "n_sentences", "source", max_tokens(F.col("chars"), F.col("n_sentences"), F.col("source")).alias("max_tokens"), message.alias("message"))

