"""Problem 4: one form for text that looks the same.

A text is first normalised (width forms, joined letters, radicals, blanks, hyphens; invisible characters are deleted;
accents are composed). Each token is then a lattice: at every position stand all characters of the look-alike class of
the character found there. Viterbi takes the path with the best score under character bigrams of the scripts, where
leaving a script costs much. The lattice depends on the classes only, so strings that look the same come out equal, and
as classes do not overlap, strings that look different stay different.

Null stays null, the empty string stays empty. Blanks keep their number, line breaks stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

# Characters that are drawn alike; the first of each row is the usual one.
LOOK_ALIKES = (
    "aа", "cсϲ", "eе", "hһ", "iі", "jјϳ", "oоο", "pр", "qԛ", "sѕ", "vν", "wԝ", "xх", "yу", "dԁ",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "QԚ", "SЅ", "TТΤ", "WԜ", "XХΧ", "YҮΥУ", "ZΖ",
    "二ニ", "八ハ", "力カ", "工エ", "口ロ", "夕タ", "卜ト", "一ー", "へヘ", "べベ", "ぺペ", "りリ",
)
# Radicals without a decomposition of their own, and the ideographs they are drawn as.
RADICALS = {"⺁": "厂", "⺄": "乙", "⺋": "㔾", "⺌": "小", "⺒": "巳", "⺝": "月", "⺠": "民", "⺩": "王", "⺫": "目", "⺬": "示", "⺮": "竹", "⺳": "罓", "⺸": "羊", "⺹": "耂", "⺼": "月", "⺾": "艹", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阝", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻭": "齒", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龟", "⻲": "亀"}
# Kinds of hyphen, besides those that a width form stands for.
HYPHENS = "‐‑⁃﹣"
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _table() -> dict[int, str | None]:
    """Characters to rewrite before anything else; built from the Unicode data of Python."""
    table: dict[int, str | None] = {}
    for code in [*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0200)]:
        char = chr(code)
        category = unicodedata.category(char)
        kind, _, parts = unicodedata.decomposition(char).partition("> ")
        if category == "Cf" or code in _INVISIBLE:
            table[code] = None
        elif category == "Zs":
            table[code] = " "
        elif kind in ("<wide", "<narrow") or (kind == "<compat" and (0xFB00 <= code <= 0xFB4F or 0x2E80 <= code <= 0x2FDF or code in (0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4)))):
            text = "".join(chr(int(x, 16)) for x in parts.split())
            table[code] = text if unicodedata.category(text[0]) != "Zs" else " "
    for char in HYPHENS:
        table[ord(char)] = "-"
    for radical, char in RADICALS.items():
        table[ord(radical)] = char
    return table


_REWRITE = _table()
# characters of the first plane stand in a class of their own, which is searched faster
_REWRITTEN = re.compile("[" + "".join(re.escape(chr(c)) for c in _REWRITE if c < 0x10000) + "]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_CLASS = {char: row for row in LOOK_ALIKES for char in row}
_EAST = "".join(row for row in LOOK_ALIKES if ord(row[0]) > 0x2FFF)
#: A token of the alphabets that have look-alikes, or a stretch of ambiguous kana and ideographs with its neighbours.
_TOKEN = re.compile(f"[A-Za-zªµºÀ-ʯ̀-ͯͰ-ԯḀ-῿]+|[{_EAST}]+")
#: A letter of another alphabet, or an ambiguous character of the east.
_FOREIGN = re.compile(f"[Ͱ-ԯἀ-\u1fff{_EAST}]")
_EASTERN = ("han", "hiragana", "katakana")
_TOGETHER = ({"hiragana", "han"},)
#: A letter of the alphabets that looks like no other; for accented letters their base counts.
_CLEAR = re.compile("[" + "".join(chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x386, 0x530), *range(0x1E00, 0x2000)] if chr(c).isalpha() and unicodedata.normalize("NFD", chr(c))[0] not in _CLASS) + "]")
_MEMO_LIMIT = 200_000
#: Characters whose bigrams are counted at once, and what a longer text is parted before: no letters, and joined to none.
PIECE = 1 << 18
_APART = re.compile(r"[\t\n\r ,;!?()0-9、。，]")
#: A kana and its mark, in two characters.
_VOICED = re.compile("[\u3041-\u30ff][\u3099\u309a]")
_SCRIPTS = {"latin": 1, "greek": 2, "cyrillic": 4, "hiragana": 8, "katakana": 16, "han": 32, "": 64}
#: By the scripts of a token, whether its bigrams count: one script, or those of the east together.
_ONE_SCRIPT = np.array([(scripts & 63).bit_count() == 1 or not scripts & 7 for scripts in range(128)])
#: In place of a code: the start or the end of a token, and any character after which no score is asked for.
EDGE, OTHER = 0, -1


def normalised(text: str) -> str:
    """Width forms, joined letters, radicals, blanks, hyphens and accents in one spelling; no invisible characters."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_REWRITE) if _REWRITTEN.search(text) or _BEYOND.search(text) else text)


_FIRST = {ord(char): row[0] for row in LOOK_ALIKES for char in row[1:]}


def skeleton(text: str) -> str:
    """Lower case of a word with every look-alike replaced by the first of its class: a key, not a spelling."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", normalised(text)).translate(_FIRST).lower().translate(_FIRST))


def script(char: str) -> str:
    code = ord(char)
    if code < 0x370:
        return "latin" if char.isalpha() else ""
    if code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if code < 0x530:
        return "cyrillic"
    if 0x1E00 <= code < 0x1F00:
        return "latin"
    if 0x3041 <= code <= 0x309F:
        return "hiragana"
    if 0x30A0 <= code <= 0x30FF:
        return "katakana"
    return "han" if code > 0x2FFF else ""


@cache
def _kind(code: int) -> int:
    """The script of a letter as a bit, 0 for what is no letter; 128 more for a character that tokens can hold."""
    char = chr(code)
    if not char.isalnum() or char.isdecimal():
        return 0
    return _SCRIPTS[script(char)] | (128 if code < 0x530 or 0x1E00 <= code < 0x2000 or char in _EAST else 0)


def _pieces(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about PIECE characters."""
    held, size = [], 0
    for text in texts:
        start = 0
        while len(text) - start > PIECE and (m := _APART.search(text, start + PIECE)):
            yield [text[start : m.start()]]
            start = m.start()
        held.append(text[start:])
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    yield held


def bigrams(texts: Iterable[str]) -> Counter[tuple[int, int]]:
    """How often a character follows another in tokens that keep to one script, by their codes.

    Kana are one with their marks, as they are in the lattice; the marks of other letters part tokens.
    No score is asked for a pair of which tokens can hold neither character; such a pair counts for its first one only.
    """
    counts: Counter[tuple[int, int]] = Counter()
    for held in _pieces(texts):
        plain, rest = [t for t in held if t.isascii()], [normalised(t) for t in held if not t.isascii()]
        apart = _VOICED.sub(lambda m: unicodedata.normalize("NFC", m[0]), unicodedata.normalize("NFD", "\n".join(rest)))
        text = f"{'\n'.join(plain)}\n{apart}".lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.flatnonzero(np.bincount(codes))
        kinds = np.array([_kind(c) for c in chars.tolist()], np.uint8)
        number = np.zeros(chars[-1] + 1, np.int32)
        number[chars] = np.arange(len(chars))
        numbers = number[codes]
        scripts = (kinds & 127)[numbers]
        letters = scripts > 0
        starts = np.flatnonzero(letters & ~np.concatenate([[False], letters[:-1]]))
        if not len(starts):
            continue
        tokens = _ONE_SCRIPT[np.bitwise_or.reduceat(scripts, starts)]
        letters[starts[0] :] &= np.repeat(tokens, np.diff(starts, append=len(codes)))
        # 0 is the edge of a token, then the characters, then all others
        row = np.pad((numbers + 1) * letters, 1)
        pairs = row[:-1] + row[1:] > 0
        first, second = row[:-1][pairs], row[1:][pairs]
        asked, width = np.concatenate([[False], kinds > 127]), len(chars) + 2
        keys = first.astype(np.int64) * width + np.where(asked[first] | asked[second], second, width - 1)
        if width * width <= 4 * PIECE:
            number_of = np.bincount(keys)
            keys = np.flatnonzero(number_of)
            number_of = number_of[keys]
        else:
            keys, number_of = np.unique(keys, return_counts=True)
        names = [EDGE, *chars.tolist(), OTHER]
        for key, n in zip(keys.tolist(), number_of.tolist(), strict=True):
            counts[names[key // width], names[key % width]] += n
    return counts


class Spelling:
    """Character bigram scores within scripts, and the search for the best spelling of a token."""

    def __init__(self, switch: float = 12.0, enter: float = 9.0):
        self.switch, self.enter = switch, enter
        self.pairs: dict[str, Counter] = defaultdict(Counter)
        self.totals: Counter = Counter()
        self.memo: dict[tuple[str, str, str, str], str] = {}
        self.same: set[str] = set()

    def fit(self, texts: Iterable[str]) -> Spelling:
        """Count the bigrams of tokens that keep to one script."""
        return self.add((a, b, n) for (a, b), n in bigrams(texts).items())

    def add(self, counts: Iterable[tuple[int, int, int]]) -> Spelling:
        """Add bigrams that are counted, by their codes."""
        for a, b, n in counts:
            first = "^" if a == EDGE else chr(a)
            self.totals[first] += n
            pairs = self.pairs[first]
            if b != OTHER:
                pairs["$" if b == EDGE else chr(b)] += n
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "same": set()}

    def _score(self, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        return math.log((self.pairs[a][b] + 0.05) / (self.totals[a] + 5.0)) if a in self.pairs else math.log(0.05 / 5.0)

    def best(self, token: str, before: str = "", after: str = "", context: str = "latin") -> str:
        """The spelling of a token; all tokens that look like it get the same between like neighbours."""
        key = (token, before, after, context)
        found = self.memo.get(key)
        if found is None:
            found = self._search(*key)
            if len(self.memo) >= _MEMO_LIMIT:
                self.memo.clear()
            self.memo[key] = found
        return found

    def _search(self, token: str, before: str, after: str, context: str) -> str:
        letters = unicodedata.normalize("NFD", token) if not token.isascii() and token[0] not in _EAST else token
        # a state is a candidate character and the script it is in; accents keep the script of the letter before them
        states: dict[tuple[str, str], tuple[float, str]] = {(before or "^", context): (0.0, "")}
        for place, letter in enumerate(letters):
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for char in _CLASS.get(letter, letter):
                own = script(char)
                best = None
                for (last, held), (score, path) in states.items():
                    leaves = bool(own and held) and own != held and {own, held} not in _TOGETHER
                    value = score + self._score(last, char) - (leaves and (self.switch if place else self.enter))
                    if best is None or (value, path) > best[:2]:
                        best = (value, path, held)
                following[char, own or best[2]] = (best[0], best[1] + char)
            states = following
        last = max((score + self._score(char, after or "$") - (self.switch if after and (own := script(after)) and own != held and {own, held} not in _TOGETHER else 0), path) for (char, held), (score, path) in states.items())
        return unicodedata.normalize("NFC", last[1])

    def canonical(self, text: str | None) -> str | None:
        """The one form of a text."""
        if not text:
            return text
        best = self.best
        if not text.isascii():
            text = normalised(text)
        if not _FOREIGN.search(text):
            # one script: most tokens are known to stay as they are, and then the text does
            tokens = _TOKEN.findall(text)
            if self.same.issuperset(tokens):
                return text
            if len(self.same) > _MEMO_LIMIT:
                self.same.clear()
            self.same.update(t for t in tokens if best(t) == t)
            return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: best(m[0]), text))
        # a token of look-alikes only is read in the script of the last token that is clear, else of the next one
        context = script(m[0]) if (m := _CLEAR.search(text)) else "latin"

        def spell(m: re.Match) -> str:
            nonlocal context
            token = m[0]
            if token[0] in _EAST:
                i, j = m.span()
                before, after = text[i - 1 : i], text[j : j + 1]
                before, after = before if script(before or " ") in _EASTERN else "", after if script(after or " ") in _EASTERN else ""
                return best(token, before, after, script(before) if before else "")
            if clear := _CLEAR.search(token):
                context = script(clear[0])
            return best(token, context=context)

        return unicodedata.normalize("NFC", _TOKEN.sub(spell, text))


def spelling_of(texts: DataFrame) -> Spelling:
    """A speller with the bigrams of all texts, whole, each as often as it stands there.

    Each task counts its own; what the driver gets are the sums, whose number follows the characters in use and not the
    texts. The counts cannot change which strings come out equal, only the letters they are written with.
    """
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = bigrams(text for batch in batches for text in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array(found.values(), pa.int64())], ["a", "b", "n"])

    counts = texts.toDF("text").where("text <> ''").mapInArrow(count, "a int, b int, n bigint")
    return Spelling().add(counts.groupBy("a", "b").agg(F.sum("n")).collect())


def with_canonical(df: DataFrame, column: str, speller: Spelling, to: str = "canonical") -> DataFrame:
    """df with the one form of a column added; null stays null, all other columns stay as they are."""
    spark = df.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(speller)

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        canonical = model.value.canonical
        return texts.map(lambda t: None if t is None else canonical(t))

    return df.withColumn(to, form(F.col(column)))


def same_look(rows: DataFrame, salt_above: int = 2000) -> DataFrame:
    """(tbl, id_a, id_b): pairs of rows(tbl, scope, id, text, canonical) of one scope whose texts look the same and differ.

    Null scopes, null and blank texts make no pair; rows repeated make none with themselves. A form with one spelling in a
    scope, however often it stands there, goes no further than a count. The rows of the others are joined by scope, form
    and a salt that grows with the group, so that a hot group is spread over many tasks; no pair is dropped.
    """
    keyed = rows.where("id is not null and scope is not null and trim(canonical) <> ''").select("tbl", "scope", "id", F.md5("canonical").alias("form"), F.md5("text").alias("spelling"))
    keyed = cut(keyed)
    spellings = keyed.groupBy("tbl", "scope", "form", "spelling").agg(F.count("*").alias("n"))
    groups = spellings.groupBy("tbl", "scope", "form").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    groups = groups.select("tbl", "scope", "form", F.ceil(F.col("n") / salt_above).cast("int").alias("parts"))
    members = keyed.join(groups, ["tbl", "scope", "form"]).select("tbl", "scope", "form", "id", "spelling", "parts").distinct()
    left = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("tbl", "scope", "form", "part", F.col("id").alias("id_a"), F.col("spelling").alias("spelling_a"))
    right = members.select("tbl", "scope", "form", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_b"), F.col("spelling").alias("spelling_b"))
    pairs = left.join(right, ["tbl", "scope", "form", "part"]).where("id_a < id_b and spelling_a <> spelling_b")
    return pairs.select("tbl", "id_a", "id_b").distinct()
