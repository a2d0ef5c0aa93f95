"""Problem 3: the language of each text and of each stretch of a mixed one, with a confidence.

A text is cut into units (sentences of an item, lines of a document). A linear model on script shares and word scores
predicts the family of a unit (Germanic, Romance, Slavic, Chinese, Japanese, Korean); one-versus-one linear support
vector machines then separate the languages of the family: words and character n-grams of words for the Germanic and
Romance ones, characters for the two forms of Chinese. Units are joined along a path in which a change of language has a
cost, so that a short unit without evidence goes with its neighbours.

The models are fitted on a bounded sample of labelled rows (SAMPLE_ROWS of each table, by hash); labels are noisy,
so rows that the first fit contradicts are left out of the second. Null, empty and blank texts and texts without words
have no language and no segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain, combinations
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from ._arrow import map_columns
from ._sample import bounded
from .forms import _REWRITE
from .sents import sentences

#: Bound of the labelled sample, rows of each table.
SAMPLE_ROWS = 4000
#: Of each text of the sample the first characters, so that it has a bound in bytes too (some 20 MB).
SAMPLE_CHARS = 5000
#: Bound of the units that the linear model of the families is fitted on; six features need no more.
FAMILY_UNITS = 4000
#: Bound of the units of a language that one support vector machine is fitted on.
UNITS_A_CLASS = 400

# The eleven languages by family.
FAMILIES = {"germanic": ("en", "de"), "romance": ("fr", "es", "pt", "it"), "slavic": ("ru",), "chinese": ("zh-CN", "zh-TW"), "japanese": ("ja",), "korean": ("ko",)}
LANGUAGES = [x for family in FAMILIES.values() for x in family]
# Names of the languages in English and in themselves.
NAMES = {
    "en": "english", "de": "german deutsch", "fr": "french français francais", "es": "spanish español espanol castellano castilian",
    "pt": "portuguese português portugues", "it": "italian italiano", "ru": "russian русский", "ja": "japanese 日本語",
    "ko": "korean 한국어", "zh-CN": "chinese 中文 简体中文 汉语 zh-hans zh-sg zh-my zh simplified-chinese chinese-simplified mandarin cmn", "zh-TW": "繁體中文 zh-hant zh-hk zh-mo traditional-chinese chinese-traditional",
}
_THREE = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "rus": "ru", "jpn": "ja", "kor": "ko", "zho": "zh-CN", "chi": "zh-CN"}
_LABELS = {name: code for code, names in NAMES.items() for name in [code.lower(), *names.split()]} | _THREE


def label_code(label: str | None) -> str | None:
    """The code of the language that a label names in any spelling; None where it names none of the eleven."""
    if not label:
        return None
    text = re.sub(r"[\s_]+", "-", unicodedata.normalize("NFKC", label).strip().lower())
    text = re.sub(r"[()]", "", text)
    if text in _LABELS:
        return _LABELS[text]
    parts = text.split("-")
    if parts[0] in ("zh", "chinese", "zho", "cmn"):
        return "zh-TW" if {"hant", "tw", "hk", "mo", "traditional"} & set(parts[1:]) else "zh-CN"
    return _LABELS.get(parts[0]) if len(parts[0]) == 2 or parts[0] in _LABELS else None


# scripts of code points: 1 Latin small, 2 Latin capital, 3 Cyrillic, 4 Han, 5 kana, 6 hangul
_SCRIPT = np.zeros(0x110000, np.uint8)
for _code in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
    if chr(_code).isalpha():
        _SCRIPT[_code] = 1 if chr(_code).islower() else 2
_SCRIPT[0x400:0x530] = 3
_SCRIPT[0x3400:0x9FFF] = _SCRIPT[0xF900:0xFB00] = _SCRIPT[0x20000:0x32000] = _SCRIPT[0x2E80:0x2FE0] = 4
_SCRIPT[0x3041:0x3100] = _SCRIPT[0xFF66:0xFFA0] = 5
_SCRIPT[0xAC00:0xD7B0] = _SCRIPT[0x1100:0x1200] = _SCRIPT[0x3131:0x318F] = 6
_SCRIPT[0x30FB] = 0
_WORD = re.compile(r"\b[a-zß-öø-ÿœšž]+\b")
_ANY_WORD = re.compile(r"\b[A-Za-zÀ-ÖØ-öø-ÿœŒ]{3,}\b")
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _REWRITE if c < 0x10000 and not 0xFF01 <= c <= 0xFF20) + "]")
_BUCKETS = 1 << 14


def _only_in(codec: str, other: str) -> np.ndarray:
    """Which ideographs the one coded character set has and the other has not."""
    out = np.zeros(0x10000, bool)
    for code in range(0x4E00, 0xA000):
        char = chr(code)
        try:
            char.encode(codec)
        except UnicodeEncodeError:
            continue
        try:
            char.encode(other)
        except UnicodeEncodeError:
            out[code] = True
    return out


def _grams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [_BUCKETS + crc32(word.encode()) % _BUCKETS, *(crc32(padded[i : i + n].encode()) % _BUCKETS for n in (2, 3) for i in range(len(padded) - n + 1))]


def _svm(rows: list[np.ndarray], signs: np.ndarray, size: int, reg: float = 1e-3, rounds: int = 80) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient steps; rows hold feature indices."""
    lengths = np.array([len(r) for r in rows])
    used, index = np.unique(np.concatenate(rows) if len(rows) else np.zeros(0, int), return_inverse=True)
    value = np.repeat(1 / np.sqrt(np.maximum(lengths, 1)), lengths)
    row = np.repeat(np.arange(len(rows)), lengths)
    weight = 1 / np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum())) / 2
    w, ahead, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - signs * np.bincount(row, value * ahead[index], len(rows)))
        step = ahead - 0.5 * (reg * ahead - np.bincount(index, value * (2 * weight * slack * signs)[row], len(used)))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = step + (before - 1) / t * (step - w)
        w = step
    out = np.zeros(size)
    out[used] = w
    return out


class LanguageModel:
    """Family and language of units of text."""

    def fit(self, samples: list[tuple[str, str]]) -> LanguageModel:
        """samples: units and their (noisy) language codes."""
        samples = [(text, code) for text, code in samples if text and code]
        self.single, self.traditional = _only_in("gb2312", "big5"), _only_in("big5", "gb2312")
        units = [text for text, _ in samples]
        counts = script_counts(units)
        codes = np.array([code for _, code in samples], dtype=object)
        # family from scripts
        family = {code: k for k, (_, members) in enumerate(FAMILIES.items()) for code in members}
        group = {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4}  # the two Latin families share a script
        target = np.array([group[family[c]] for c in codes], int) if len(codes) else np.zeros(0, int)
        shares = self._shares(counts)
        self.scripts = np.zeros((5, shares.shape[1]))
        good = shares.sum(1) > 1
        for _ in range(2):
            some = np.flatnonzero(good)[:FAMILY_UNITS]
            for k in range(5):
                self.scripts[k] = self._dense(shares[some], np.where(target[some] == k, 1.0, -1.0)) if len(some) else 0
            good &= (shares @ self.scripts.T).argmax(1) == target
        kept = np.flatnonzero(good)
        # words of the Latin families
        self.columns = [("germanic", "romance"), *(pair for name in ("germanic", "romance") for pair in combinations(FAMILIES[name], 2))]
        latin = [(i, _WORD.findall(units[i])) for i in kept if target[i] == 0]
        latin = [(i, words) for i, words in latin if len(words) >= 3]
        # units with the same words count once, in the language that most of them are labelled with: the bounded number of
        # units holds many different ones, and mistaken labels are outvoted
        votes: dict[frozenset, Counter] = {}
        for i, words in latin:
            votes.setdefault(frozenset(words), Counter())[codes[i]] += 1
        first = {(codes[i], frozenset(words)): (i, words) for i, words in reversed(latin)}
        agreed = [(votes[words][code], *row) for (code, words), row in first.items() if code == max(votes[words], key=lambda c: (votes[words][c], c))]  # noqa: B023
        agreed.sort(key=lambda row: (-row[0], row[1]))  # those that stand most often are fitted on first
        several = np.array([n > 1 for n, _, _ in agreed], bool)
        latin = [row[1:] for row in agreed]
        self.known = {w for w, n in Counter(chain.from_iterable(words for _, words in latin)).items() if n >= 3}
        grams = {w: _grams(w) for w in {w for _, words in latin for w in words}}
        features = [np.fromiter(chain.from_iterable(grams[w] for w in dict.fromkeys(words)), int) for _, words in latin]
        own = np.array([codes[i] for i, _ in latin], dtype=object)
        self.weights = np.zeros((2 * _BUCKETS, len(self.columns)))
        use = np.ones(len(own), bool)
        for again in range(2):
            for k, (a, b) in enumerate(self.columns):
                first, second = (FAMILIES[a], FAMILIES[b]) if a in FAMILIES else ((a,), (b,))
                mask = use & np.isin(own, list(first + second))
                # as many of each language, so that the rare ones of a family count
                picked = np.concatenate([np.flatnonzero(mask & (own == code))[:UNITS_A_CLASS] for code in first + second])
                if len(picked):
                    self.weights[:, k] = _svm([features[i] for i in picked], np.where(np.isin(own[picked], list(first)), 1.0, -1.0), 2 * _BUCKETS)
            if not again:
                self._start()
                guesses = self._latin_scores(self.table_sum([words for _, words in latin])) if len(own) else []
                # a label that several copies bear is not taken for mistaken because the first fit contradicts it
                use = several | np.array([max(g, key=g.get) == code for g, code in zip(guesses, own, strict=True)], bool) if len(own) else use
        # characters of the two forms of Chinese
        han = [i for i in kept if target[i] == 2]
        rows = [self._characters(units[i]) for i in han]
        signs = np.array([1.0 if codes[i] == "zh-CN" else -1.0 for i in han])
        self.han = np.zeros(0x10002)
        self.han[0x10000], self.han[0x10001] = 1.0, -1.0
        use = np.array([self.han[r].sum() for r in rows]) * signs > 0  # the character sets clean the labels of the first fit
        for _ in range(2):
            picked = np.concatenate([np.flatnonzero(use & (signs == side))[:UNITS_A_CLASS] for side in (1.0, -1.0)])
            if len(set(signs[picked])) == 2:
                self.han = _svm([rows[i] for i in picked], signs[picked], 0x10002)
                use = np.array([self.han[r].sum() for r in rows]) * signs > 0
        own = np.arange(0x10000)
        self.forms = np.where((own >= 0x3400) & (own < 0xA000), self.han[:0x10000] + self.single * self.han[0x10000] + self.traditional * self.han[0x10001], 0.0)
        self._start()
        return self

    def _start(self) -> None:
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.columns)), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _characters(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        codes = codes[(codes >= 0x3400) & (codes < 0xA000)].astype(int)
        return np.concatenate([codes, np.full(int(self.single[codes].sum()), 0x10000), np.full(int(self.traditional[codes].sum()), 0x10001)])

    @staticmethod
    def _dense(x: np.ndarray, signs: np.ndarray, rounds: int = 300) -> np.ndarray:
        w = np.zeros(x.shape[1])
        weight = 1 / np.where(signs > 0, max(1, (signs > 0).sum()), max(1, (signs < 0).sum())) / 2
        for _ in range(rounds):
            slack = np.maximum(0, 1 - signs * (x @ w))
            w -= 0.3 * (1e-3 * w - x.T @ (2 * weight * slack * signs))
        return w

    @staticmethod
    def _shares(counts: np.ndarray) -> np.ndarray:
        """Latin (a fifth a letter, capitals less), Cyrillic, Han, kana, hangul, as shares; and one for the bias."""
        parts = np.stack([counts[:, 1] / 5 + counts[:, 2] / 50, counts[:, 3] / 5, counts[:, 4] / 2, counts[:, 5] * 1.0, counts[:, 6] / 2], 1)
        total = parts.sum(1, keepdims=True)
        return np.concatenate([parts / np.maximum(total, 1e-9), np.ones((len(parts), 1)) * (total > 0)], 1)

    def _index(self, words: list[str]) -> list[int]:
        """Rows of the words in the table of word scores; words not met before get theirs from their n-grams."""
        get = self.words.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for i, k in enumerate(out):
                if k < 0:
                    word = words[i]
                    if (k := self.words.get(word, -1)) < 0:
                        k = len(self.words)
                        if k >= len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        self.words[word] = k
                        self.table[k] = self.weights[_grams(word)].sum(0)
                    out[i] = k
        return out

    def table_sum(self, lists: list[list[str]]) -> np.ndarray:
        """Sums of the word scores of each list, over the root of its length."""
        lengths = np.array([len(x) for x in lists])
        index = np.array(self._index(list(chain.from_iterable(lists))), int)
        if len(self.words) > 400_000:  # the table is a cache
            sums = np.zeros((len(lists), len(self.columns)))
            np.add.at(sums, np.repeat(np.arange(len(lists)), lengths), self.table[index])
            self._start()
        else:
            sums = np.zeros((len(lists), len(self.columns)))
            filled = np.flatnonzero(lengths)
            if len(filled):
                sums[filled] = np.add.reduceat(self.table[index], np.concatenate([[0], np.cumsum(lengths[filled])[:-1]]), 0)
        return sums / np.sqrt(np.maximum(lengths, 1))[:, None]

    def _latin_scores(self, sums: np.ndarray) -> list[dict[str, float]]:
        """For each language its least margin against the others of its family, and the family's against the other."""
        out = np.full((len(sums), 6), np.inf)
        order = [*FAMILIES["germanic"], *FAMILIES["romance"]]
        for k, (a, b) in enumerate(self.columns):
            if a in FAMILIES:
                out[:, :2] = np.minimum(out[:, :2], sums[:, k : k + 1])
                out[:, 2:] = np.minimum(out[:, 2:], -sums[:, k : k + 1])
            else:
                i, j = order.index(a), order.index(b)
                out[:, i] = np.minimum(out[:, i], sums[:, k])
                out[:, j] = np.minimum(out[:, j], -sums[:, k])
        return [dict(zip(order, row, strict=True)) for row in out.tolist()]

    def scores(self, units: list[str]) -> list[dict[str, float] | None]:
        """Scores of the languages that are possible for each unit; None for a unit without words."""
        return self.scores_and_counts(units)[0]

    def scores_and_counts(self, units: list[str]) -> tuple[list[dict[str, float] | None], np.ndarray]:
        """The scores of each unit, and its letters of each script."""
        out: list[dict[str, float] | None] = [None] * len(units)
        if not units:
            return out, np.zeros((0, 7))
        codes, ends = encoded(units)
        counts = script_counts(units, (codes, ends))
        # margins between the forms of Chinese, of all units at once
        sums = np.concatenate([[0.0], np.cumsum(self.forms[np.where(codes < 0x10000, codes, 0)], dtype=np.float64)])
        margins = np.round(sums[ends[1:]] - sums[ends[:-1]], 6).tolist()
        shares = self._shares(counts)
        group = (shares @ self.scripts.T).argmax(1)
        words: list[list[str]] = []
        places: list[int] = []
        letters = counts[:, 1:7].sum(1)
        for i, g in enumerate(group.tolist()):
            if not letters[i]:
                continue
            if g == 0:
                found = _WORD.findall(units[i])
                if sum(map(len, found)) < 4:
                    found += [w.lower() for w in _ANY_WORD.findall(units[i]) if w.lower() in self.known]
                if any(len(w) > 1 for w in found) and (sum(map(len, found)) >= 4 or any(len(w) > 1 and w in self.known for w in found)):
                    words.append(found)
                    places.append(i)
            elif g == 1 and counts[i, 3] >= 3:
                out[i] = {"ru": 2.0}
            elif g == 2 and counts[i, 4] >= 2:
                out[i] = {"zh-CN": margins[i], "zh-TW": -margins[i]}
            elif g == 3 and counts[i, 5]:
                out[i] = {"ja": 2.0}
            elif g == 4 and counts[i, 6] >= 2:
                out[i] = {"ko": 2.0}
        if places:
            for i, scores in zip(places, self._latin_scores(self.table_sum(words)), strict=True):
                out[i] = scores
        return out, counts


def encoded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all units, and where each begins and the last ends."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])


def script_counts(units: list[str], coded: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Letters of each script in each unit, by one pass over all of them."""
    codes, ends = coded or encoded(units)
    kinds = _SCRIPT[codes]
    out = np.zeros((len(units), 7))
    for k in range(1, 7):
        if (hit := np.flatnonzero(kinds == k)).size:
            out[:, k] = np.diff(np.searchsorted(hit, ends))
    return out


def label_units(scores: list[dict[str, float] | None], prior: str | None, change: float = 1.0, missing: float = 1.5) -> list[tuple[str, float] | None]:
    """Language and confidence of the units of one text, in order; a change of language has a cost.

    The language of the label breaks ties only.
    """
    some = [s for s in scores if s]
    if not some:
        return [None] * len(scores)
    if len(some) == 1 or all(len(s) == 1 and s.keys() == some[0].keys() for s in some):
        path = [max(s, key=lambda x: (s[x] + 0.05 * (x == prior), x)) for s in some]
    else:
        names = sorted({x for s in some for x in s})
        value, back = {x: 0.02 * (x == prior) for x in names}, []
        for s in some:
            top = max(value, key=lambda x: (value[x], x))
            step, following = {}, {}
            for x in names:
                came = x if value[x] >= value[top] - change else top
                step[x] = came
                following[x] = value[came] - change * (came != x) + (min(2.0, max(-2.0, s[x])) if x in s else -2.0 - missing)
            back.append(step)
            value = following
        last = max(value, key=lambda x: (value[x], x))
        path = []
        for step in back[::-1]:
            path.append(last)
            last = step[last]
        path.reverse()
    out: list[tuple[str, float] | None] = []
    found = iter(path)
    for s in scores:
        if s is None:
            out.append(None)
            continue
        x = next(found)
        out.append((x, 1 / (1 + float(np.exp(-2.5 * max(-8.0, min(8.0, s.get(x, -1.0))) - 0.2)))))
    return out


def segments(units: list[tuple[int, int]], found: list[tuple[str, float] | None]) -> list[tuple[int, int, str, float]]:
    """Longest stretches of units in one language: start, end, language, mean confidence weighted by length. Units without
    words belong to the stretch they stand in, at its edges to none."""
    out: list[list] = []
    for (begin, end), at in zip(units, found, strict=True):
        if at is None:
            continue
        if out and out[-1][2] == at[0]:
            out[-1][1] = end
            out[-1][3] += at[1] * (end - begin)
            out[-1][4] += end - begin
        else:
            out.append([begin, end, at[0], at[1] * (end - begin), end - begin])
    return [(a, b, code, total / max(1, n)) for a, b, code, total, n in out]


def lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def sample_of(df: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of df(text, label): rows with a label, their texts to the first SAMPLE_CHARS characters."""
    labelled = df.toDF("text", "label").where("label <> ''")
    kept = labelled.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), "label").where("text <> ''")
    return [(r.text, r.label) for r in bounded(kept, rows, "text", "label", total=labelled.count())]


def model_of(items: list[tuple[str, str]], documents: list[tuple[str, str]]) -> LanguageModel:
    """Fit on samples of items and of documents, whose lines count one by one."""
    samples = []
    for rows, cut in ((items, lambda t: [t]), (documents, lambda t: t.split("\n"))):
        for text, label in rows:
            code = label_code(label)
            if code:
                samples += [(unit, code) for unit in cut(text)]
    return LanguageModel().fit(samples)


def languages(df: DataFrame, model: LanguageModel, by_line: bool, cases_only: bool = False) -> DataFrame:
    """(rec_id, seg_no, start_pos, end_pos, lang, confidence) of the segments of df(rec_id, text, label), each once.

    cases_only: of records only whose label is missing, names no language or another one, or that hold more than one.
    """
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def batch(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("rec_id", "seg_no", "start_pos", "end_pos", "lang", "confidence")}
        cuts = []
        units: list[str] = []
        for text in columns["text"]:
            places = (lines(text) if by_line else sentences(text)) if text else []
            cuts.append(places)
            units += [text[a:b] for a, b in places]
        units = [u if u.isascii() or not _ODD.search(u) else u.translate(_REWRITE) for u in units]
        scores = shared.value.scores(units)
        at = 0
        for key, label, places in zip(columns["rec_id"], columns["label"], cuts, strict=True):
            code = label_code(label)
            found = segments(places, label_units(scores[at : at + len(places)], code))
            at += len(places)
            if not found or (cases_only and len(found) == 1 and found[0][2] == code):
                continue
            for k, (a, b, lang, confidence) in enumerate(found):
                for name, value in zip(out, (key, k, a, b, lang, round(confidence, 4)), strict=True):
                    out[name].append(value)
        return out

    rows = spread(df.select("rec_id", "text", "label").where("text is not null"))
    return map_columns(rows, batch, "rec_id bigint, seg_no int, start_pos int, end_pos int, lang string, confidence double").distinct()
