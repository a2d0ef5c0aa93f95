"""Problem 7: evaluation passages in documents, by Wu-Manber search.

Texts are compared in a squashed form: letters and digits only, one case, look-alikes and width forms in one spelling, so
that punctuation, blanks, line breaks and hyphens at line ends do not matter. Patterns are all windows of eight words of
an item (Chinese: characters). For each class of patterns a table gives, for every block of characters, how far the
window may be shifted; blocks that stand nowhere in the first m characters of a pattern let it jump over almost all of
them. Where the shift is zero, the hash of the block selects the patterns, and direct comparison confirms them.

Windows that follow each other make passages; a chain of passages in the order of document and item, with the most
words, gives the share of the item that the document holds. Null and empty texts hold nothing; items with fewer than
eight words are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate

from pyspark.sql import DataFrame

from ..session import ship, spread
from ._arrow import map_columns
from .forms import _FIRST, _REWRITE

WINDOW = 8
#: Items are searched in blocks of so many, so that what is broadcast has a bound (some 50 MB) whatever their number.
ITEMS_A_BLOCK = 1_000

#: Characters written without blanks between words: of a text in them each counts as a word.
_HAN = re.compile("[㐀-鿿ぁ-ヿ]")
_PLAIN_RUN = re.compile("[a-z0-9]+")
_WORDS = re.compile(r"[^\W_]+(?:[̀-゙゚ͯ]+[^\W_]*)*")
_MARK = re.compile("[̀-゙゚ͯ]")


class _Fold(dict):
    """Characters in their squashed form, filled as they are met."""

    def __missing__(self, code: int) -> str:
        text = _REWRITE.get(code, chr(code)) if code in _REWRITE else chr(code)
        text = unicodedata.normalize("NFD", text or "").translate(_FIRST).lower().translate(_FIRST)
        text = "".join(c for c in text if c.isalnum() or unicodedata.category(c) == "Mn")
        self[code] = text = unicodedata.normalize("NFC", text)
        return text


_FOLD = _Fold()


def squash(text: str) -> str:
    """The letters and digits of a text in one form."""
    if text.isascii():
        return "".join(_PLAIN_RUN.findall(text.lower()))
    out = text.translate(_FOLD)
    return unicodedata.normalize("NFC", out) if _MARK.search(out) else out


def units(text: str) -> list[str]:
    """The squashed words of an item; of one in Chinese or Japanese, its characters."""
    if len(_HAN.findall(text)) > 0.3 * len(text):
        return list(squash(text))
    rewritten = text if text.isascii() else unicodedata.normalize("NFC", text.translate(_REWRITE))
    return [w for w in map(squash, _WORDS.findall(rewritten)) if w]


class Patterns:
    """Shift and hash tables of one class of patterns."""

    def __init__(self, windows: list[tuple[str, int, int]], block: int):
        """windows: (squashed text, item, place of its first unit)."""
        self.block = block
        self.size = min(len(w) for w, _, _ in windows)
        self.jump = self.size - block + 1
        self.shift: dict[str, int] = {}
        self.hash: dict[str, list[tuple[str, int, int]]] = defaultdict(list)
        for text, item, place in windows:
            for end in range(block, self.size + 1):
                key = text[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.size - end)
            self.hash[text[self.size - block : self.size]].append((text, item, place))
        self.hash = dict(self.hash)

    def search(self, text: str, found: list[tuple[int, int, int, int]]) -> None:
        """Append (item, place of unit, start, end) of all occurrences."""
        block, size, jump, shift, table = self.block, self.size, self.jump, self.shift.get, self.hash
        at, length = size, len(text)
        while at <= length:
            key = text[at - block : at]
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - size
            for pattern, item, place in table.get(key, ()):
                if text.startswith(pattern, start):
                    found.append((item, place, start, start + len(pattern)))
            at += 1


class Leaks:
    """All patterns of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.lengths: dict[int, int] = {}
        self.offsets: dict[int, list[int]] = {}
        classes: dict[tuple[bool, int], list[tuple[str, int, int]]] = defaultdict(list)
        self.window: dict[int, int] = {}
        for item, text in items:
            words = units(text or "")
            if not words:
                continue
            self.lengths[item] = len(words)
            self.offsets[item] = [0, *accumulate(map(len, words))]
            n = self.window[item] = min(window, len(words))
            for place in range(len(words) - n + 1):
                squashed = "".join(words[place : place + n])
                # classes by length, so that a short pattern does not shorten the jumps for the long ones
                classes[bool(_HAN.search(squashed)), 24 if len(squashed) >= 24 else 16 if len(squashed) >= 16 else 8 if len(squashed) >= 8 else 1].append((squashed, item, place))
        self.patterns = [(han, Patterns(windows, {24: 8, 16: 6, 8: 4, 1: 1}[least])) for (han, least), windows in classes.items()]

    def of(self, text: str | None) -> dict[int, tuple[float, int]]:
        """For each item that the text holds a passage of: share of its words, start of the passage in the squashed text."""
        if not text:
            return {}
        plain = squash(text)
        han = bool(_HAN.search(plain))
        found: list[tuple[int, int, int, int]] = []
        for only_han, patterns in self.patterns:
            if han or not only_han:
                patterns.search(plain, found)
        if not found:
            return {}
        by_item: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        for item, place, start, end in found:
            by_item[item].add((start, place, end))
        return {item: self._chain(item, hits) for item, hits in by_item.items()}

    def _chain(self, item: int, hits: set[tuple[int, int, int]]) -> tuple[float, int]:
        """The chain of passages with the most words, in the order of both texts."""
        n, offsets = self.window[item], self.offsets[item]
        # windows on one diagonal (document start less start in the squashed item) that touch make a passage
        by_diagonal: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for start, place, _ in hits:
            by_diagonal[start - offsets[place]].append((place, start))
        passages: list[tuple[int, int, int, int]] = []
        for diagonal, rows in by_diagonal.items():
            rows.sort()
            first = last = rows[0][0]
            for place, _ in rows[1:]:
                if place > last + n:
                    passages.append((offsets[first] + diagonal, first, last + n, offsets[last + n] + diagonal))
                    first = place
                last = place
            passages.append((offsets[first] + diagonal, first, last + n, offsets[last + n] + diagonal))
        passages.sort()
        # best chain: states by end in the item, values by words; ends and values both grow
        best: list[tuple[int, int]] = []
        for _, first, end, _ in passages:
            value = end - first
            ends = [e for e, _ in best]
            k = bisect_right(ends, end)
            for e, v in best[:k]:
                value = max(value, v + end - max(first, e))
            k = bisect_right(ends, end)
            if not k or best[k - 1][1] < value:
                if k and best[k - 1][0] == end:
                    best[k - 1] = (end, value)
                else:
                    best.insert(k, (end, value))
                    k += 1
                while k < len(best) and best[k][1] <= value:
                    del best[k]
        return max(v for _, v in best) / self.lengths[item], passages[0][0]


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.45) -> DataFrame:
    """(doc_id, item_id, share): documents(doc_id, text) that hold at least share of the units of items(item_id, text)."""
    spark = documents.sparkSession
    ship(spark)
    rows = spread(documents.select("doc_id", "text").where("text <> ''"))
    # the stated query set; an item with several texts has leaked if one of them has
    held = sorted({(r.item_id, r.text) for r in items.select("item_id", "text").where("text <> '' and item_id is not null").toLocalIterator()})
    out = None
    for at in range(0, max(1, len(held)), ITEMS_A_BLOCK):
        block = held[at : at + ITEMS_A_BLOCK]
        model = spark.sparkContext.broadcast((Leaks(list(enumerate(t for _, t in block))), [k for k, _ in block]))

        def batch(columns: dict[str, list], model=model) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": [], "item_id": [], "share": []}
            patterns, ids = model.value
            for key, text in zip(columns["doc_id"], columns["text"], strict=True):
                for item, (part, _) in patterns.of(text).items():
                    if part >= share:
                        out["doc_id"].append(key)
                        out["item_id"].append(ids[item])
                        out["share"].append(round(part, 4))
            return out

        part = map_columns(rows, batch, "doc_id bigint, item_id bigint, share double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").max("share").withColumnRenamed("max(share)", "share")
