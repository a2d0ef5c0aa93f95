"""Problem 2: cutting oversized texts into pieces under a limit, at natural boundaries and with an overlap.

Balanced targets: the least number of pieces is computed, cuts are placed at equal lengths, and each is moved to the
strongest boundary near it (end of a line, a sentence, a clause, a word). Where a cut finds none within what the limits
allow, a piece is added and all cuts are placed anew. A cut, and the start of the overlap before it, never falls inside
a visible character (an extended grapheme cluster); where the overlap would, it grows to the start of that character.

A limit that is null or below MIN_LIMIT counts as DEFAULT_LIMIT; an overlap that is null or negative as 0, and one of
half the limit or more as a little less than that. Null, empty and short texts come out as no piece.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._arrow import map_columns
from .sents import sentence_ends

MIN_LIMIT, DEFAULT_LIMIT = 200, 3000

_JOINED = regex.compile(r"[\p{M}\p{Cf}\u1100-\u11ff\ua960-\ua97f\ud7b0-\ud7ff\U0001F1E6-\U0001F1FF\U0001F3FB-\U0001F3FF\u0e33\u0eb3]|\r\n")
_CLUSTER = regex.compile(r"\X")
_LINE = regex.compile(r"\r?\n[\s]*|[  ]\s*")
_CLAUSE = regex.compile(r"[,;:，、；：—–)）」』”»]+\s*")
_WORD = regex.compile(r"\s+|(?<=[぀-ヿ㐀-鿿])(?=[぀-あいうえお-ぢつ-もやゆよ-ろわ-・㐀-鿿])|(?<=-)(?=\w)")


def boundaries(text: str) -> dict[int, int]:
    """Places where a text may be cut well, and how well: 4 line, 3 sentence, 2 clause, 1 word."""
    out: dict[int, int] = {}
    for m in _WORD.finditer(text):
        out[m.end()] = 1
    for m in _CLAUSE.finditer(text):
        out[m.end()] = 2
    for end in sentence_ends(text):
        while end < len(text) and text[end].isspace():
            end += 1
        out[end] = 3
    for m in _LINE.finditer(text):
        out[m.end()] = 4
    out.pop(0, None)
    out.pop(len(text), None)
    return out


def starts_of_characters(text: str) -> list[int] | None:
    """For each place the start of the visible character it is in; None where every code point is one."""
    if not _JOINED.search(text):
        return None
    out = []
    for m in _CLUSTER.finditer(text):
        out += [m.start()] * (m.end() - m.start())
    return [*out, len(text)]


def _place(size: int, limit: int, overlap: int, count: int, good: list[int], strength: dict[int, int], starts: list[int] | None, least: int) -> list[int] | None:
    """Cuts for a number of pieces, each at a boundary of least strength; None where one finds no place."""
    length = (size + (count - 1) * overlap) / count
    step = length - overlap
    cuts: list[int] = []
    for i in range(1, count):
        target = round(i * step + overlap)
        begin = 0 if not cuts else cuts[-1] - overlap
        if cuts and starts is not None:
            begin = starts[begin]
        high = begin + limit
        low = max(begin + overlap + 1, size - limit - (count - i - 1) * (limit - overlap) + overlap)
        high = min(high, size - 1)
        if low > high:
            return None
        reach = max(8, int(0.15 * length))
        best = None
        for near in (reach, size):
            for place in _within(good, max(low, target - near), min(high, target + near)):
                if strength[place] >= least and (starts is None or starts[place] == place):
                    key = (-strength[place] if near == reach else 0, abs(place - target), place)
                    if best is None or key < best[0]:
                        best = (key, place)
            if best:
                break
        if best is None and least == 0:
            place = min(max(target, low), high)
            while starts is not None and place > low and starts[place] != place:
                place -= 1
            if starts is not None and starts[place] != place:
                return None
            best = (None, place)
        if best is None:
            return None
        cuts.append(best[1])
    return cuts


def _within(ordered: list[int], low: int, high: int) -> list[int]:
    from bisect import bisect_left, bisect_right

    return ordered[bisect_left(ordered, low) : bisect_right(ordered, high)]


def cut(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, shared): shared is how many code points it has in common with the piece before.

    A text within the limit is one piece. A visible character longer than the limit is the one thing that can exceed it.
    """
    if not text:
        return []
    limit = DEFAULT_LIMIT if limit is None or limit < MIN_LIMIT else limit
    overlap = 0 if overlap is None or overlap < 0 else min(overlap, (limit - 1) // 2)
    size = len(text)
    if size <= limit:
        return [(0, size, 0)]
    strength = boundaries(text)
    good = sorted(strength)
    starts = starts_of_characters(text)
    least_count = 1 + -(-(size - limit) // (limit - overlap))
    for least in (1, 0):
        for count in range(least_count, 2 * least_count + 3):
            cuts = _place(size, limit, overlap, count, good, strength, starts, least)
            if cuts is None:
                continue
            out = [(0, cuts[0], 0)] if cuts else [(0, size, 0)]
            for a, b in zip(cuts, [*cuts[1:], size], strict=True):
                begin = a - overlap if starts is None else starts[a - overlap]
                out.append((begin, b, a - begin))
            if all(b - a <= limit for a, b, _ in out):
                return out
    # characters longer than what is left of the limit: from left to right, whatever fits
    out, at = [], 0
    while at < size:
        begin = at if not out else starts[max(out[-1][0] + 1, at - overlap)]
        if begin <= (out[-1][0] if out else -1):
            begin = at
        end = min(size, begin + limit)
        while end < size and end > at and starts[end] != end:
            end -= 1
        if end <= at:  # one visible character beyond the limit stays whole
            begin = at
            end = next((i for i in range(at + 1, size) if starts[i] == i), size)
        out.append((begin, end, at - begin))
        at = end
    return out


def pieces(blocks: DataFrame, options: DataFrame) -> DataFrame:
    """(block_no, piece_no, start_pos, end_pos, shared, piece): ordered pieces of the blocks that exceed their limit.

    blocks has block_no, text and profile_id, options profile_id, max_chars_per_request and overlap_chars; blocks without
    a profile get the default limit. Each block once, whatever copies there are.
    """
    limits = options.groupBy("profile_id").agg(F.max("max_chars_per_request").alias("limit"), F.max("overlap_chars").alias("overlap"))
    rows = spread(blocks.select("block_no", "text", "profile_id")).join(limits, "profile_id", "left")
    rows = rows.where(F.length("text") > F.when(F.col("limit") >= MIN_LIMIT, F.col("limit")).otherwise(DEFAULT_LIMIT))

    def batch(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("block_no", "piece_no", "start_pos", "end_pos", "shared", "piece")}
        for key, text, limit, overlap in zip(*(columns[k] for k in ("block_no", "text", "limit", "overlap")), strict=True):
            for k, (a, b, shared) in enumerate(cut(text, limit, overlap)):
                for name, value in zip(out, (key, k, a, b, shared, text[a:b]), strict=True):
                    out[name].append(value)
        return out

    return map_columns(rows.select("block_no", "text", "limit", "overlap"), batch, "block_no bigint, piece_no int, start_pos int, end_pos int, shared int, piece string").dropDuplicates(["block_no", "piece_no"])
