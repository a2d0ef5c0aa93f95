"""Sentences of a paragraph as one column expression, without a Python worker.

Text with spaces is cut at every terminator that a blank follows, and the pieces are folded from left to right: a piece
starts a new sentence unless it begins in lower case or the period before it belongs to an abbreviation, an initial, an
enumerator or a caption label. The fold knows where the sentence began, which enumerators and labels need. Chinese and
Japanese are cut after their own terminators. Apply it to paragraphs: the fold copies the open sentence at every piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T

_MARK = "\u0001"
_CLUSTER = f"[.?!][.{P.CLOSERS}]*"


def is_sentence_period(before: Column, cluster: Column, following: Column) -> Column:
    """Whether a period ends the sentence whose text before it is given; following is the text of the next piece."""
    token = F.regexp_extract(before, r"[\p{L}\p{N}.]+$", 0)
    lower = F.lower(token)
    part = F.substring_index(lower, ".", -1)
    whole = T.trim_blanks(before)
    blank = f"[{P.BLANK}]"
    return (
        F.when(token == "", True)
        .when(lower.isin(P.ABBREVIATIONS), False)
        .when(lower.contains(".") & part.isin(P.ABBREVIATIONS) & (F.length(part) > 1), False)
        .when(token.rlike(r"^\p{Lu}$"), False)
        .when(token.rlike(r"^\p{Ll}$") & (cluster == ".") & following.rlike(r"^\p{L}{1,3}\."), False)
        .when((whole == token) & token.rlike(r"^(?:\d+|[A-Za-z]|(?i:[ivxlc]+))$"), False)
        .when(F.lower(F.regexp_extract(whole, r"^(\p{L}+)" + blank + r"+[\d.]+$", 1)).isin(P.CAPTION_LABELS), False)
        .otherwise(True)
    )


def _fold(pieces: Column) -> Column:
    empty = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(state: Column, piece: Column) -> Column:
        cluster = F.regexp_extract(state["open"], f"{_CLUSTER}$", 0)
        before = F.left(state["open"], F.length(state["open"]) - F.length(cluster))
        ends = ~piece.rlike(r"^\p{Ll}") & (cluster.rlike("^[?!]") | is_sentence_period(before, cluster, piece))
        return (
            F.when(state["open"].isNull(), F.struct(piece.alias("open"), state["done"].alias("done")))
            .when(ends, F.struct(piece.alias("open"), F.array_append(state["done"], state["open"]).alias("done")))
            .otherwise(F.struct(F.concat(state["open"], F.lit(" "), piece).alias("open"), state["done"].alias("done")))
        )

    return F.reduce(pieces, empty, step, lambda state: F.array_append(state["done"], state["open"]))


def spaced_sentences(text: Column) -> Column:
    """Sentences of text with spaces between words; blanks are collapsed first."""
    plain = T.collapse_blanks(text)
    return F.when(plain != "", _fold(F.split(F.regexp_replace(plain, f"({_CLUSTER}) ", f"$1{_MARK}"), _MARK)))


def cjk_sentences(text: Column) -> Column:
    """Sentences of Chinese and Japanese text. Half-width marks end one only after its characters; the full-width period
    between digits is a decimal point."""
    plain = T.collapse_blanks(text)
    end = f"(?:[。！？]|(?<=[{P.CJK}])[!?]|(?<!\\p{{Nd}})．|．(?!\\p{{Nd}}))[{P.CJK_TERMINATORS}{P.CJK_CLOSERS}]*"
    pieces = F.transform(F.split(F.regexp_replace(plain, f"({end})", f"$1{_MARK}"), _MARK), T.trim_blanks)
    return F.filter(pieces, lambda piece: piece != "")


def split_sentences(text: Column) -> Column:
    """Array of the sentences of a paragraph; null and blank texts have none."""
    return F.coalesce(F.when(T.is_cjk_text(text), cjk_sentences(text)).otherwise(spaced_sentences(text)), F.array().cast("array<string>"))


def is_sentence(text: Column) -> Column:
    """Page numbers, symbols and text of fonts without a usable encoding are none."""
    return T.has_letter(text) & ~T.is_garbled(text)
