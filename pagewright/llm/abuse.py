"""Problem 8: abusive, hateful and sexual language by nearest labelled examples.

A document is undisguised (invisible and look-alike characters, letters set apart, digits and signs for letters, drawn-out
letters, masked letters) and cut into sentences. A sentence is a TF-IDF vector over the terms of the labelled examples:
words, their stems, character pairs of spaceless scripts, and marks for kinds of words. Document frequencies are counted
over all documents, by column expressions, of words as they are written. The nearest examples by exact cosine come from a
block-max inverted index: examples stand in blocks, each term has its greatest weight in each block, and a block is opened
only if the sum of these for the sentence can beat what is already found. Sentences without a term that a harmful example
within reach must share are passed, which is exact too. Votes weighted by similarity give the scores, the examples the
evidence.

Examples are the sentences of a bounded sample of labelled documents (LABELLED_DOCUMENTS, by hash), of each the first
LABELLED_CHARS characters. Marks of a document by several annotators are settled by majority; ties and nulls are left out.
The labels say which documents are harmful, not by which sentence nor in which way: labelled_examples says how sentences
are chosen; the kinds of words in it give the category of an example, else its nearest examples do. One that nothing is
near to is of harmful language in general, which counts for the score of a document but for no category. Scores are
chances that a reviewer marks such a document: a logistic curve through the scores of the labelled documents, each judged
by the examples of the others. Null and empty texts score 0; without labelled documents all do.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from heapq import nlargest
from itertools import chain
from math import exp, lgamma, log, sqrt
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread
from ._arrow import map_columns
from ._sample import bounded
from .forms import normalised, skeleton
from .lexicon import COMMON, WORDS

#: Bound of the sample of labelled documents, and of the characters of each that examples are taken from.
LABELLED_DOCUMENTS = 4000
LABELLED_CHARS = 50_000
CATEGORIES = ("abusive", "hateful", "sexual")
#: The category of examples that are harmful in a way that nothing says.
GENERAL = "harmful"
#: Chance that any sentence of the labelled documents is taken for harmful without being so.
LEVEL = 0.05
#: Examples that vote on a sentence, and the cosine that they must reach.
NEIGHBOURS, LEAST = 9, 0.4
#: Slope and offset of the logistic curve of scores where there are too few labels to fit one.
PLATT = (8.0, -4.0)
_MEMO_LIMIT = 300_000
KINDS = ("you", "insult", "threat", "group", "hate", "sex", "coarse", "about")

#: Squared weight of a term that no example has.
_UNKNOWN = 3.0

_SPACELESS = ("zh", "ja", "ko")
_CJK = "぀-ヿ㐀-鿿가-힣"
_STOP = re.compile(r"[.!?…]+[\"”“’»)\]]*(?=\s|\Z|[" + _CJK + r"“「（A-ZА-Я])|[。！？]+[”’」』）]*|[\n\r]+")
_SET_APART = re.compile(r"(?<![\w])[^\W_](?:([ .\-_·*])[^\W_])(?:\1[^\W_])+(?![\w])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_CJK_GAP = re.compile(f"(?<=[{_CJK}])[ .*·_-]+(?=[㐀-鿿぀-ヿ])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$€!]*[\w*])?|[@$][\w*@$]+")
_LEET = str.maketrans("013457@$€8", "oieastasеb".replace("е", "e"))
_DIGIT = re.compile(r"[\d@$€*]")
_QUOTED = re.compile(r"[“„«‘「『\"]\s?([^\s“”„«»‘’「」『』\"]+(?:\s[^\s“”„«»‘’「」『』\"]+)?)\s?[”“»’」』\"]")
_HAS_CJK = re.compile(f"[{_CJK}]")
_CJK_RUN = re.compile(f"[{_CJK}]+")


def tokens_of(text: str) -> list[str]:
    """Words outside the runs of spaceless scripts, whose terms are character pairs."""
    return _TOKEN.findall(_CJK_RUN.sub(" ", text) if _HAS_CJK.search(text) else text)


def undisguised(text: str) -> str:
    """A text with letters set apart joined, blanks between ideographs removed, and one form of each character."""
    text = normalised(text)
    if _SET_APART.search(text):
        text = _SET_APART.sub(lambda m: re.sub(r"[ .\-_·*]", "", m[0]), text)
    return _CJK_GAP.sub("", text) if _HAS_CJK.search(text) else text


def sentences(text: str) -> list[str]:
    out, at = [], 0
    for m in _STOP.finditer(text):
        if (piece := text[at : m.end()].strip()) and len(piece) > 1:
            out.append(piece)
        at = m.end()
    if (piece := text[at:].strip()) and len(piece) > 1:
        out.append(piece)
    return out


class Lexicon:
    """Marks of words and phrases."""

    def __init__(self):
        self.stems: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.exact: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self.phrases: dict[str, list[tuple[tuple[str, ...], tuple[str, str]]]] = defaultdict(list)
        self.common: dict[str, set[str]] = defaultdict(set)
        for language, words in COMMON.items():
            for word in words.split():
                self.common[skeleton(word)].add(language)
        east: dict[str, set[str]] = defaultdict(set)
        for language, kinds in WORDS.items():
            for kind, words in kinds.items():
                for word in words.split():
                    if language in _SPACELESS:
                        east[word].add(kind)
                        continue
                    parts = tuple(skeleton(p) for p in word.rstrip("*").split("_"))
                    if len(parts) > 1:
                        self.phrases[parts[0]].append((parts, (language, kind)))
                    elif word.endswith("*"):
                        self.stems[parts[0]].add((language, kind))
                    else:
                        self.exact[parts[0]].add((language, kind))
        self.lengths = sorted({len(s) for s in self.stems})
        self.east = dict(east)
        self.find_east = re.compile("|".join(sorted(map(re.escape, east), key=len, reverse=True)))
        self.known = frozenset(self.exact) | frozenset(self.stems) | frozenset(p for v in self.phrases.values() for parts, _ in v for p in parts)
        self.by_shape: dict[tuple[int, str], list[str]] = defaultdict(list)
        for word in self.known:
            self.by_shape[len(word), word[0]].append(word)
        self.memo: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def has(self, word: str) -> bool:
        return word in self.known or any(word[:n] in self.stems for n in self.lengths if n <= len(word))

    def plain(self, token: str) -> str:
        """A token without its disguise; tokens that are none, like names and numbers, come back as they are."""
        if _DRAWN.search(token):
            short = _DRAWN.sub(r"\1", token)
            token = short if self.has(short) else double if self.has(double := _DRAWN.sub(r"\1\1", token)) else short
        if _DIGIT.search(token) and re.search(r"[^\W\d_]", token):
            swapped = token.translate(_LEET)
            if "*" in swapped:
                shape = re.compile(re.escape(swapped).replace(r"\*", "[^\\W\\d_]") + "\\Z")
                best = [w for w in sorted(self.known) if shape.match(w)] or [w for w in sorted(self.stems) if len(w) >= 4 and re.match(re.escape(swapped[: len(w)]).replace(r"\*", "[^\\W\\d_]") + "\\Z", w)]
                if best:
                    return best[0]
                return swapped.replace("*", "")
            if self.has(swapped) or not token[-1].isdigit():
                return swapped
        return token

    def terms(self, token: str) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...], tuple[str, ...], str, bool]:
        """Of one token: word and stem; marks by language; languages that it is a frequent word of; its plain form; whether
        it has a mark or may begin a phrase."""
        found = self.memo.get(token)
        if found is None:
            word = self.plain(skeleton(token))
            if not word or word.isdigit() or len(word) > 40:
                found = ((), (), (), word, word in self.phrases)
            else:
                marks = set(self.exact.get(word, ()))
                for n in self.lengths:
                    if n <= len(word):
                        marks |= self.stems.get(word[:n], set())
                name = any(c.isdigit() for c in word) or re.search(r"[a-z][A-Z]", token)
                found = (() if name else (word,) if len(word) <= 6 else (word, word[:6] + "~"), tuple(sorted(marks)), tuple(self.common.get(word, ())), word, bool(marks) or word in self.phrases)
            if len(self.memo) > _MEMO_LIMIT:
                self.memo.clear()
            self.memo[token] = found
        return found

    def bag(self, sentence: str) -> Counter:
        """Terms of a sentence and how often they stand in it; marks count in the language of the sentence only."""
        held, phrases = self.memo.get, self.phrases
        rows = [held(token) or self.terms(token) for token in tokens_of(sentence)]
        bag = Counter(chain.from_iterable([r[0] for r in rows]))
        marked = [r[1] for r in rows if r[1]]
        for k, row in enumerate(rows):
            if row[4] and row[3] in phrases:
                for parts, mark in phrases[row[3]]:
                    if all(k + i < len(rows) and rows[k + i][3] == part for i, part in enumerate(parts)):
                        marked.append((mark,))
                        bag["_".join(parts)] += 1
        if marked:
            languages = Counter(chain.from_iterable([r[2] for r in rows]))
            most = max(languages.values(), default=0)
            spoken = {x for x, n in languages.items() if n >= most - (most < 6)} if most else None
            for marks in marked:
                bag.update({f"§{kind}" for language, kind in marks if spoken is None or language in spoken})
        if _HAS_CJK.search(sentence):
            for m in self.find_east.finditer(sentence.lower()):
                for kind in self.east[m[0]]:
                    bag[f"§{kind}"] += 1
            for run in _CJK_RUN.findall(sentence):
                bag.update(run[i : i + 2] for i in range(len(run) - 1))
        if ("§insult" in bag or "§sex" in bag) and any(self.mentions(m[1]) for m in _QUOTED.finditer(sentence)):
            bag["§mention"] += 1
        return bag

    def row(self, token: str) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...], tuple[str, ...], str, bool]:
        return self.memo.get(token) or self.terms(token)

    def mentions(self, quoted: str) -> bool:
        """Whether a quotation of a word or two is one of the words above."""
        return bool(self.find_east.search(quoted)) or any(kind in ("insult", "sex", "threat") for token in tokens_of(quoted) for _, kind in self.terms(token)[1])

    def kind(self, bag: Counter) -> str | None:
        """The category that the marks of a harmful sentence speak for."""
        n = {k: bag.get(f"§{k}", 0) for k in KINDS}
        # groups that no list has are degraded in the same words
        hateful = 2 * n["hate"] + 0.5 * (n["insult"] > 0) if n["group"] else 1.3 * (n["hate"] > 0) * (n["you"] == 0)
        sexual = 2.0 * n["sex"] - 1.0 * (n["insult"] + n["threat"] > 0)
        abusive = 1.2 * n["insult"] + 1.5 * n["threat"] + 0.5 * n["coarse"] + 0.5 * (n["you"] > 0) * (n["insult"] + n["threat"] + n["coarse"] > 0) - 0.8 * (n["group"] > 0) * (n["hate"] > 0) * (n["you"] == 0)
        if n["about"] >= 2 and not n["you"] and not n["threat"] or bag.get("§mention"):
            return None
        score, name = max((abusive, "abusive"), (hateful, "hateful"), (sexual, "sexual"))
        return name if score >= 1.2 else None


class Index:
    """Exact nearest neighbours by cosine, with a block-max inverted index."""

    def __init__(self, examples: list[tuple[Counter, str, str]], idf: dict[str, float], block: int = 64):
        self.idf = idf
        # examples of one category stand together, so that whole blocks of harmless ones can be passed, and in it those that
        # begin alike, so that the bounds of a block are close
        order = sorted(range(len(examples)), key=lambda i: (examples[i][1], examples[i][2], i))
        self.order = order
        self.category = [examples[i][1] for i in order]
        self.name = [examples[i][2] for i in order]
        self.bags = [examples[i][0] for i in order]
        #: Where the examples that are not harmless begin.
        self.harmful_from = sum(not c for c in self.category)
        self.postings: dict[str, dict[int, list[tuple[int, float]]]] = {}
        self.top: dict[str, dict[int, float]] = {}
        self.harm: dict[str, float] = {}
        self.block = block
        for place, i in enumerate(order):
            vector = self.vector(examples[i][0])
            for term, weight in vector.items():
                self.postings.setdefault(term, {}).setdefault(place // block, []).append((place, weight))
                tops = self.top.setdefault(term, {})
                tops[place // block] = max(tops.get(place // block, 0.0), weight)
                if examples[i][1]:
                    self.harm[term] = max(self.harm.get(term, 0.0), weight)

    def vector(self, bag: Counter) -> dict[str, float]:
        idf = self.idf
        raw = {t: (1 + log(n)) * idf[t] for t, n in bag.items() if t in idf}
        # terms that no example has are part of the length, not of the sum
        norm = sqrt(sum(w * w for w in raw.values()) + _UNKNOWN * sum(t not in idf and t[-1] != "~" for t in bag))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def reached(self, vector: dict[str, float], least: float) -> bool:
        """Whether an example that is not harmless has a cosine of at least least."""
        harm = self.harm
        if sum([w * harm[t] for t, w in vector.items() if t in harm]) < least:
            return False
        sums: dict[int, float] = defaultdict(float)
        for term, w in vector.items():
            if term in harm:
                for b, rows in self.postings[term].items():
                    if (b + 1) * self.block > self.harmful_from:
                        for place, weight in rows:
                            sums[place] += w * weight
        return any(s >= least for place, s in sums.items() if place >= self.harmful_from)

    def nearest(self, vector: dict[str, float], k: int, least: float, harmless: bool = False) -> list[tuple[float, int]]:
        """The k nearest examples with a cosine of at least least, if one that is not harmless can reach it; exact."""
        if not harmless and not self.reached(vector, least):
            return []
        bounds: dict[int, float] = defaultdict(float)
        for term, w in vector.items():
            for b, top in self.top.get(term, {}).items():
                bounds[b] += w * top
        found: list[tuple[float, int]] = []
        bar = least
        for b, bound in sorted(bounds.items(), key=lambda x: (-x[1], x[0])):
            if bound < bar:
                break
            sums: dict[int, float] = defaultdict(float)
            for term, w in vector.items():
                for place, weight in self.postings.get(term, {}).get(b, ()):
                    sums[place] += w * weight
            found += [(s, -p) for p, s in sums.items() if s >= bar]
            if len(found) > k:
                found = nlargest(k, found)
                bar = max(bar, found[-1][0])
        return [(s, -p) for s, p in nlargest(k, found)]

    def triggers(self, least: float) -> set[str]:
        """Terms of which a vector has one at least if its cosine with an example that is not harmless reaches least.

        Of each such example the most frequent terms are left out as long as their length together is below least: by the
        inequality of Cauchy and Schwarz no vector of length one reaches least by them alone.
        """
        out: set[str] = set()
        for category, bag in zip(self.category, self.bags, strict=True):
            if category:
                vector, held = self.vector(bag), 0.0
                for term in sorted(vector, key=lambda t: (self.idf[t], t)):
                    held += vector[term] ** 2
                    if sqrt(held) >= least - 1e-9:
                        out.add(term)
        return out


class Judge:
    """Scores of sentences and documents."""

    def __init__(self, lexicon: Lexicon, examples: list[tuple[Counter, str, str]], idf: dict[str, float], k: int = NEIGHBOURS, least: float = LEAST):
        self.lexicon, self.k, self.least = lexicon, k, least
        self.index = Index(examples, idf)
        self.order = self.index.order
        triggers = self.index.triggers(least)
        self.words = triggers
        self.pairs = {t for t in triggers if _HAS_CJK.match(t)}
        self.east = {word for word, kinds in lexicon.east.items() if any(f"§{kind}" in triggers for kind in kinds)}
        self.find_east = re.compile("|".join(sorted(map(re.escape, self.east), key=len, reverse=True))) if self.east else None
        self.phrases: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for first, rows in lexicon.phrases.items():
            for parts, (_, kind) in rows:
                if "_".join(parts) in triggers or f"§{kind}" in triggers:
                    self.phrases[first].append(parts)
        self.slope, self.offset = PLATT
        self.pure: set[str] = set()
        self.starts: set[str] = set()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pure": set(), "starts": set()}

    def slim(self) -> Judge:
        """Without what only the fit needs, to be sent to the executors."""
        self.index.bags, self.index.order, self.order = [], [], []
        return self

    def _speaks(self, token: str) -> bool:
        terms, marks, _, _, _ = self.lexicon.row(token)
        words = self.words
        return any([t in words for t in terms]) or any([f"§{kind}" in words for _, kind in marks])

    def may_hold(self, text: str) -> bool:
        """False only where no example that is not harmless can be near to any sentence of an undisguised text; exact."""
        east = _HAS_CJK.search(text) is not None
        tokens = set(_TOKEN.findall(_CJK_RUN.sub(" ", text) if east else text))
        fresh = tokens - self.pure
        for token in fresh:
            if self._speaks(token):
                return True
        if len(self.pure) > _MEMO_LIMIT:
            self.pure, self.starts, fresh = set(), set(), tokens
        self.pure |= fresh
        self.starts.update(token for token in fresh if self.lexicon.row(token)[3] in self.phrases)
        if begun := tokens & self.starts:
            plain = {self.lexicon.row(token)[3] for token in tokens}
            if any(plain.issuperset(parts) for token in begun for parts in self.phrases[self.lexicon.row(token)[3]]):
                return True
        if east:
            if not self.pairs.isdisjoint(map(add, text, text[1:])):
                return True
            if self.find_east is not None and self.find_east.search(text.lower()):
                return True
        return "§mention" in self.words and _QUOTED.search(text) is not None

    def votes(self, sentence: str, other: Callable[[int], bool] | None = None) -> tuple[dict[str, float], str]:
        """Raw score of each category and the name of the nearest harmful example; of the examples that other lets pass."""
        near = self.index.nearest(self.index.vector(self.lexicon.bag(sentence)), self.k if other is None else 4 * self.k, self.least)
        if other is not None:
            near = [x for x in near if other(self.order[x[1]])][: self.k]
        votes: dict[str, float] = defaultdict(float)
        evidence = ""
        for similarity, place in near:
            category = self.index.category[place]
            votes[category] += similarity**4
            if category and not evidence:
                evidence = self.index.name[place]
        if not evidence:
            return {}, ""
        total = sum(votes.values()) + self.least**4
        general = votes.pop(GENERAL, 0.0)  # speaks neither for nor against a category
        scores = {c: votes[c] / (total - general) for c in CATEGORIES if c in votes}
        return scores | ({GENERAL: (general + sum(votes[c] for c in scores)) / total} if general else {}), evidence

    def chance_of(self, score: float) -> float:
        """The chance that a reviewer marks a document with such a score."""
        return 1 / (1 + exp(-max(-40.0, min(40.0, self.slope * score + self.offset))))

    def raw(self, text: str | None, other: Callable[[int], bool] | None = None) -> dict[str, tuple[float, str, str]]:
        """For each category the share of votes of the best sentence, the sentence and its nearest example."""
        out: dict[str, tuple[float, str, str]] = {}
        if not text or not self.may_hold(text := undisguised(text)):
            return out
        for sentence in sentences(text):
            if self.may_hold(sentence):
                scores, evidence = self.votes(sentence, other)
                for category, score in scores.items():
                    if score > out.get(category, (0.0,))[0]:
                        out[category] = (score, sentence, evidence)
        return out

    def document(self, text: str | None) -> dict[str, tuple[float, str, str]]:
        """For each category the score, its sentence and its nearest example; nothing where no example is near."""
        return {c: (self.chance_of(share), sentence, evidence) for c, (share, sentence, evidence) in self.raw(text).items()}


def chance(harmful: int, harmless: int, share: float) -> float:
    """How likely it is that of so many documents this many or more are harmful, where a share of all is."""
    n = harmful + harmless
    if not 0 < share < 1:
        return 1.0
    ways = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    return sum(exp(ways(i) + i * log(share) + (n - i) * log(1 - share)) for i in range(harmful, n + 1))


@dataclass(slots=True)
class Labelled:
    """Sentences of labelled documents with the same terms."""

    bag: Counter
    text: str
    documents: tuple[set[int], set[int]]  # harmless and harmful ones, by place in the sample


def gathered(lexicon: Lexicon, rows: list[tuple[str, int]]) -> tuple[list[Labelled], dict[str, set[str]]]:
    """The sentences of documents (text, label), equal ones together; and the words met that each mark stands for."""
    seen: dict[frozenset, Labelled] = {}
    words: dict[str, set[str]] = defaultdict(set)
    for n, (text, label) in enumerate(rows):
        text = undisguised(text)  # noqa: PLW2901
        for sentence in sentences(text):
            bag = lexicon.bag(sentence)
            key = frozenset(t for t in bag if t[0] != "§")
            if key:
                seen.setdefault(key, Labelled(bag, sentence[:80], (set(), set()))).documents[bool(label)].add(n)
        for token in set(tokens_of(text)):
            for _, kind in lexicon.row(token)[1]:
                words[f"§{kind}"].add(lexicon.row(token)[3])
        for m in lexicon.find_east.finditer(text.lower()) if _HAS_CJK.search(text) else ():
            for kind in lexicon.east[m[0]]:
                words[f"§{kind}"].add(m[0])
    return list(seen.values()), words


def _parts(term: str) -> list[str]:
    """The counted terms that a term is made of: words of a phrase, character pairs of a word of a spaceless script."""
    if "_" in term:
        return term.split("_")
    return [term[i : i + 2] for i in range(len(term) - 1)] if len(term) > 1 and _HAS_CJK.match(term) else [term]


def idf_of(found: list[Labelled], words: dict[str, set[str]], frequency: dict[str, int]) -> dict[str, float]:
    """Weights of the terms of the labelled sentences. What is made of several counted terms is as frequent as the rarest
    of them at most; a mark stands for all words of its kind, which are counted together."""
    documents = frequency.get("", 0)
    count = lambda term: min((frequency.get(p, 0) for p in _parts(term)), default=0)
    counts = {t: count(t) for x in found for t in x.bag if t[0] != "§"}
    for mark in {t for x in found for t in x.bag if t[0] == "§"}:
        counts[mark] = sum(map(count, words[mark])) if mark in words else sum(mark in x.bag for x in found)
    return {t: log((documents + 1) / (min(documents, n) + 1)) + 0.1 for t, n in counts.items()}


def labelled_examples(lexicon: Lexicon, found: list[Labelled], labels: list[int], idf: dict[str, float], k: int = 25, alike: float = 0.6) -> tuple[list[tuple[Counter, str, str]], list[int]]:
    """Examples, and of each the place of its sentence in found.

    The documents that hold a sentence, or one like it, are counted by label. A sentence of a harmful document is harmful
    if it holds words of a kind and not more of these documents are harmless than harmful, or if significantly more are
    harmful than chance has it. A harmful document without such a sentence must have one: those of its sentences that no
    harmless document has anything near to. Sentences of harmless documents are harmless examples, unless they hold words of a
    kind and most of those like them are in harmful documents: marks are mistaken now and then.
    """
    index = Index([(x.bag, "", x.text) for x in found], idf)
    share = sum(labels) / max(1, len(labels))
    kinds = [lexicon.kind(x.bag) for x in found]
    counts: list[tuple[int, int]] = []
    for x, kind in zip(found, kinds, strict=True):
        if kind is None and len(x.documents[0]) >= len(x.documents[1]):
            counts.append((len(x.documents[0]), len(x.documents[1])))
            continue
        near: tuple[set[int], set[int]] = (set(), set())
        for _, place in index.nearest(index.vector(x.bag), k, alike, harmless=True):
            other = found[index.order[place]]
            near[0].update(other.documents[0])
            near[1].update(other.documents[1])
        near[0].update(x.documents[0])
        near[1].update(x.documents[1])
        counts.append((len(near[0]), len(near[1])))
    level = LEVEL / max(1, sum(bool(x.documents[1]) and kind is None for x, kind in zip(found, kinds, strict=True)))
    category: list[str | None] = []
    for x, kind, n in zip(found, kinds, counts, strict=True):
        if x.documents[1] and kind is not None and n[1] >= n[0]:
            category.append(kind)
        elif x.documents[1] and kind is None and chance(n[1], n[0], share) < level:
            category.append(GENERAL)
        elif x.documents[0] and not (kind is not None and n[1] > n[0]):
            category.append("")
        else:
            category.append(None)
    explained = {d for x, c in zip(found, category, strict=True) if c for d in x.documents[1]}
    for i, (x, n) in enumerate(zip(found, counts, strict=True)):
        if category[i] is None and x.documents[1] - explained and n[0] == 0:
            near_by = index.nearest(index.vector(x.bag), k, LEAST, harmless=True)
            if not any(found[index.order[place]].documents[0] for _, place in near_by):
                category[i] = GENERAL
    kept = [i for i, c in enumerate(category) if c is not None]
    return [(found[i].bag, category[i], found[i].text) for i in kept], kept


def placed(examples: list[tuple[Counter, str, str]], idf: dict[str, float], k: int = NEIGHBOURS, least: float = LEAST) -> list[tuple[Counter, str, str]]:
    """The examples of the general category in that of the nearest ones that have another, where there are such."""
    if not any(category == GENERAL for _, category, _ in examples):
        return examples
    index = Index([x for x in examples if x[1] in CATEGORIES], idf)
    out = []
    for bag, category, name in examples:
        if category == GENERAL:
            votes: Counter = Counter()
            for similarity, place in index.nearest(index.vector(bag), k, least):
                votes[index.category[place]] += similarity**4
            category = min(votes, key=lambda c: (-votes[c], c), default=GENERAL)  # noqa: PLW2901
        out.append((bag, category, name))
    return out


def platt(scores: list[float], labels: list[int], rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through scores and labels, by Newton steps on targets that are never 0 or 1;
    PLATT where there are fewer than ten of a label."""
    harmful = sum(labels)
    if min(harmful, len(labels) - harmful) < 10 or len(set(scores)) < 2:
        return PLATT
    high, low = (harmful + 1) / (harmful + 2), 1 / (len(labels) - harmful + 2)
    a, b = PLATT
    for _ in range(rounds):
        ga = gb = 0.0
        haa = hbb = 1e-3
        hab = 0.0
        for s, y in zip(scores, labels, strict=True):
            p = 1 / (1 + exp(-max(-40.0, min(40.0, a * s + b))))
            d, w = p - (high if y else low), p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d * s, gb + d, haa + w * s * s, hab + w * s, hbb + w
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (a, b) if a > 0 else PLATT


def fitted(lexicon: Lexicon, rows: list[tuple[str, int]], count: Callable[[set[str]], dict[str, int]]) -> Judge:
    """A judge from labelled documents (text, label); count gives the number of documents that hold each term, and of all
    under the empty string. Scores are fitted to the labels with each document judged by the examples of the others."""
    (found, words), labels = gathered(lexicon, rows), [label for _, label in rows]
    terms = {p for x in found for t in x.bag if t[0] != "§" for p in _parts(t)} | {p for held in words.values() for t in held for p in _parts(t)}
    idf = idf_of(found, words, count(terms))
    examples, kept = labelled_examples(lexicon, found, labels, idf)
    judge = Judge(lexicon, placed(examples, idf), idf)
    scores = []
    for n, (text, _) in enumerate(rows):
        own = lambda i, n=n: (docs := found[kept[i]].documents)[0] | docs[1] != {n}
        scores.append(max((share for share, _, _ in judge.raw(text, own).values()), default=0.0))
    judge.slope, judge.offset = platt(scores, labels)
    return judge.slim()


#: Letters whose form in terms is another, by the rule of forms.skeleton; Greek and Cyrillic ones.
_LETTERS = {chr(c): key for c in range(0x370, 0x530) if chr(c).islower() and len(key := skeleton(chr(c))) == 1 and key != chr(c)}


def document_frequency(documents: DataFrame, terms: set[str]) -> dict[str, int]:
    """In how many documents each term stands as a word, a stem or a character pair, in plain spelling; and under the empty
    string the number of documents with text. Column expressions; what is joined and collected has no more rows than terms."""
    wanted = F.broadcast(documents.sparkSession.createDataFrame([(t,) for t in sorted({*terms, ""})], "term string"))
    low = F.lower("text")
    low = F.when(low.rlike("[\u0370-\u052f]"), F.translate(low, "".join(_LETTERS), "".join(_LETTERS.values()))).otherwise(low)
    pairs = F.when(F.col("text").rlike(f"[{_CJK}]"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?=([{_CJK}]{{2}}))"), 1)))
    rows = spread(documents.select("text").where("text <> ''")).select(low.alias("low"), pairs.alias("pairs"))
    rows = rows.select(F.array_distinct(F.split("low", f"[^\\p{{L}}\\p{{N}}\\p{{M}}_]+|[{_CJK}]+")).alias("words"), "pairs")
    stems = F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) > 6), lambda w: F.concat(F.left(w, F.lit(6)), F.lit("~"))))
    every = F.concat(F.array_remove("words", ""), stems, F.coalesce("pairs", F.array().cast("array<string>")), F.array(F.lit("")))
    rows = rows.select(F.explode(every).alias("term"))
    return {r["term"]: r["count"] for r in rows.join(wanted, "term", "left_semi").groupBy("term").count().collect()}


def judge_of(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_DOCUMENTS) -> Judge:
    """Fit on documents(doc_id, text) and labels(doc_id, label); frequencies are counted over all documents."""
    ship(documents.sparkSession)
    marks = labels.where("label is not null and doc_id is not null").distinct().groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("share")).where("share <> 0.5")
    marks = documents.sparkSession.createDataFrame([(r.doc_id, r.share) for r in bounded(marks, limit, "doc_id")], "doc_id bigint, share double")
    texts = documents.select("doc_id", F.left("text", F.lit(LABELLED_CHARS)).alias("text")).where("text <> ''")
    rows = texts.join(F.broadcast(marks), "doc_id").distinct().orderBy("doc_id", "text").toLocalIterator()
    return fitted(Lexicon(), [(r.text, int(r.share > 0.5)) for r in rows], lambda terms: document_frequency(documents, terms))


def judged(documents: DataFrame, judge: Judge) -> DataFrame:
    """(doc_id, category, score, evidence, example) of every document and category that an example is near to."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(judge)

    def batch(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "category", "score", "evidence", "example")}
        for key, text in zip(columns["doc_id"], columns["text"], strict=True):
            for category, (score, sentence, example) in shared.value.document(text).items():
                for name, value in zip(out, (key, category, round(score, 4), sentence, example), strict=True):
                    out[name].append(value)
        return out

    return map_columns(spread(documents.select("doc_id", "text").where("text <> ''")), batch, "doc_id bigint, category string, score double, evidence string, example string")
