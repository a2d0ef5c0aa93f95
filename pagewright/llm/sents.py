"""Problem 5: sentence ends with exact positions, in scripts with and without spaces.

Every place where a sentence may end is a gap: a cluster of terminators with its closing marks, or a blank between
ideographs or kana. A gap in spaceless script is classified by the last word before it and the first word after it;
both come from a lattice over a dictionary (unknown characters are words of one character), whose best path ends at the
gap. A gap in spaced script gets scores for ending and for going on, from the terminator, the abbreviation, number or
initial before it and the word after it; the scores are weighed along the lattice of all gaps of a text, whose states
are the open quotation or bracket, so a quotation inside a longer sentence is passed and one that is the sentence ends it.

Positions are code points of the given string, invisible characters included. Null, empty and blank texts have no
sentence; any other text ends with the end of its last sentence. A line break ends a sentence.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._arrow import map_columns
from .forms import _REWRITE, skeleton

# Abbreviations after which a sentence goes on, whatever follows.
_GO_ON = """prof dr mr mrs ms mx st hr fr herr frl dipl ing rer nat sen rev hon gen col capt lt sgt gov pres
fig figs eq eqs sec secs sect no nos nr vol vols ch chap pp p pg ref refs tab tabs thm lem cor app ed eds cf vs viz approx ca env incl esp
e.g i.e z.b d.h u.a s.o s.u o.ä v.a bzw vgl abb abschn bd bde kap gl s sog ggf zz insb evtl bspw usf
m mm mme mmes mlle mgr éq pl chap t c.-à-d p.ex n.b cf
sr sra srta dra d da dª núm págs pág cap ej p.ej ud uds aprox lic ing ee av
sig sigg sig.ra sig.na dott prof.ssa pag pagg sez es p.es cfr n tav
exmo exma eng p.ex séc
проф д-р акад рис табл разд стр с гл см ср напр прибл ок сл т.е т.н ул г-н г-жа тов доц св илл п пп""".split()  # noqa: SIM905
# Abbreviations that may stand at the end of a sentence; a capital after them starts a new one.
_MAY_END = """etc al co inc ltd corp jr sr usw u.s.w u.a.m ecc etc ss seg segg sqq sq ff f u.s u.k a.m p.m a.d b.c d.c st ave
др т.д т.п г гг в вв н.э руб коп тыс млн млрд y.s n.a sra""".split()  # noqa: SIM905
_GO_ON = frozenset(map(skeleton, _GO_ON))
_MAY_END = frozenset(map(skeleton, _MAY_END)) - _GO_ON
# Words that often open a sentence after an initial or a number.
_OPENERS = frozenset("the a an in on at it this that these those we he she they according although however each most for if when die der das wir ein eine es le la les nous il elle el los las un una se o os as un il lo gli i e в на мы он она они это".split()) - {"a", "e", "o", "i"}
# German words before an ordinal number.
_BEFORE_ORDINAL = frozenset("am im der den dem des zum zur vom beim bis ab seit jeder jede jedes die das".split())
# Words of the spaceless scripts, by what they say about a gap before or after them.
_FINAL = "了 吗 嗎 吧 呢 啊 呀 的 着 過 过 嘛 啦 罢了 而已 た だ です ます でした ました ない る い ません だった である よ ね か う す く ぬ であろう だろう".split()  # noqa: SIM905
_OPENING = "我们 我們 我 你 他 她 它 这 這 那 这个 這個 那个 那個 这些 這些 但是 但 不过 不過 因此 所以 因为 因為 如果 即使 尽管 儘管 盡管 虽然 雖然 只要 只有 除去 除了 按照 根据 根據 比如 例如 每个 每個 现在 現在 第 在 有人 然后 然後 同时 同時 另外 此外 最后 最後 これ この それ その あの ここ 私 彼 我々 しかし また さらに そして だから したがって 例えば たとえば まず 次に 最後に 最初の 誰か どの 一方 なお ただし 捨て 単なる 同時に".split()  # noqa: SIM905
_LINKING = "的 地 得 之 两 兩 这 這 那 等 说 說 問 问 與 与 和 是 と って という との を が に は も の へ で など や".split()  # noqa: SIM905

_CLOSERS = "\"'”’“»›」』）)］\\]】〉》〕｣}"
_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ々〆〇"
_GAP = re.compile(f"(?:(?P<wide>[。！？｡]+(?:[。！？｡.!?]|…)*)|(?P<dots>[.．!?…！？]+(?:\\s[!?](?=\\s))?|(?<=\\S)\\s[!?]+(?=\\s|[{_CLOSERS}]|$)))(?P<close>(?:\\s?[»]|[{_CLOSERS}])*)(?P<again>[。！？｡]*)|(?P<line>[ \\t]*[\\n\\r\\u2028\\u2029\\x85\\v\\f]+)|(?<=[{_CJK}])(?P<blank>[ ]+)(?=[{_CJK}])")
_SPACE = re.compile(r"\s*")
_PAIRS = {"”": "“„", "“": "„«", "’": "‘‚", "»": "«", "«": "»", "›": "‹", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "］": "［", "】": "【", "》": "《", "〉": "〈", "〕": "〔", '"': '"', "'": "'", "}": "{", "｣": "｢"}
_OPEN = "“„‘‚«‹「『（(［[【《〈〔{｢\"'¿¡»"
# The marks that open something; how much it costs to end a sentence in a quotation or bracket that it has
# opened after its first word, and to close in one sentence what another has opened; a score that decides by itself.
_OPENING_MARKS = "“„‘‚«‹»「『(（[［【《〈〔{｢\""
_BRACKETS = "(（[［【〔{"
_LINES = "\n\r\u2028\u2029\x85\v\f"
_MARK = re.compile("[" + re.escape("".join(sorted({*_OPENING_MARKS, *_PAIRS} - {"'"}))) + _LINES + "]")
_BROKEN = (1.5, 8.0)
_TORN = 3.0
_SURE = 20.0
_BEFORE = re.compile(r"[\w\u0300-\u036f.\-‐‑’'ª]*\Z")
_LIST_NUMBER = re.compile(r"\(?(?:\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,6})\Z")
_INVISIBLE = {code: None for code, to in _REWRITE.items() if to is None}
_BLANKS = {code: " " for code, to in _REWRITE.items() if to == " "}
_FLAT = _INVISIBLE | _BLANKS | {code: to for code, to in _REWRITE.items() if to is not None and len(to) == 1 and 0xFF10 <= code <= 0xFF5A and chr(code).isalnum()}
_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in _FLAT if c < 0x10000) + "]")  # a class within the first plane is one table look-up
_FAR = re.compile("[\U00010000-\U0010ffff]")  # beyond it, where there are some of them


class _Words:
    """The dictionary lattice: the cheapest path of words over a short stretch."""

    def __init__(self, words: list[str]):
        self.cost = {w: 1.0 + 1.2 * (len(w) == 1) for w in words}
        self.longest = max(map(len, words))

    def path(self, text: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[end - 1][0] + 3.0, end - 1)]
            for start in range(max(0, end - self.longest), end):
                if (cost := self.cost.get(text[start:end])) is not None:
                    options.append((best[start][0] + cost, start))
            best.append(min(options))
        out, end = [], len(text)
        while end:
            start = best[end][1]
            out.append(text[start:end])
            end = start
        return out[::-1]


_FINALS, _OPENINGS, _LINKINGS = frozenset(_FINAL), frozenset(_OPENING), frozenset(_LINKING)
_LATTICE = _Words([*_FINALS | _OPENINGS | _LINKINGS])


@lru_cache(maxsize=50_000)
def _last_word(text: str) -> str:
    return _LATTICE.path(text)[-1] if text else ""


@lru_cache(maxsize=50_000)
def _first_word(text: str) -> str:
    return _LATTICE.path(text)[0] if text else ""


def _is_cjk(char: str) -> bool:
    return "぀" <= char <= "ヿ" or "㐀" <= char <= "鿿" or char in "々〆〇" or "豈" <= char <= "﫿" or "ｦ" <= char <= "ﾟ"


def _opened_at(text: str, closer: str, begin: int, end: int) -> int:
    """Where the mark that closer closes was opened, or -1; nested pairs are passed."""
    openers = _PAIRS.get(closer, "")
    depth = 0
    for i in range(end - 1, begin - 1, -1):
        char = text[i]
        if char == closer and char not in openers:
            depth += 1
        elif char in openers:
            if not depth:
                return i
            depth -= 1
    return -1


def _starts_sentence(text: str, begin: int, at: int) -> bool:
    """Whether only blanks, list marks and opening marks stand before the mark at a place."""
    return not re.search(r"[^\W\d_]{2}|[^\W\d_]\s|\d\s", re.sub(r"\A\s*(?:[-•–*]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s", "", text[begin:at]))


def _spaced(text: str, begin: int, m: re.Match, at: int) -> float:
    """How much more the gap of a spaced script speaks for the end of the sentence that began at begin than for its going
    on, open quotations and brackets apart; at is where the next one would begin."""
    mark, start = m["dots"] or m["wide"], m.start()
    after = text[at : at + 1]
    if not after:
        return _SURE
    if at == m.end():  # nothing between: file names, decimals, particles that join a quotation
        if after.isupper() and set(mark) <= {".", "!", "?", "…"} and _no_blank(text, begin, start, at):
            return 2.0
        last = m["close"][-1:] or text[start - 1 : start]
        if not (_is_cjk(after) or after in "“「『（《【") or m["close"] and not _is_cjk(after):
            return -_SURE
        return 2.0 if bool(m["close"]) and (m["close"][-1] in ")）") or _is_cjk(last) else -_SURE
    following = re.match(r"[^\W_]+(?:[-’'][^\W_]+)*", text[at : at + 40])
    word = following[0] if following else ""
    if after in ",;:)]}»”%&=/+":
        return -_SURE
    lower = word[:1].islower() and not (any(c.isdigit() for c in word) or re.search(r"[a-zа-я][A-ZА-Я]", word) or re.match(r"[^\W_]+-[A-Z0-9]", word))
    dots = mark.strip().rstrip()
    if set(dots) <= {".", "…", "．"} and (len(dots) > 1 or "…" in dots):
        if text[start - 1 : start].isspace() and not m["close"]:
            return -4.0
        return -4.0 if lower else 1.5
    if m["close"]:
        opened = _opened_at(text, m["close"].strip()[-1], begin, start)
        if opened > begin and not _starts_sentence(text, begin, opened) and not text[start].isspace():
            return -4.0 if lower or after in "—–-" or word.isdigit() else 2.0
        return -4.0 if lower or after in "—–" else 3.0
    if dots[0] in "!?！？":
        if lower or after in "—–":
            return -4.0
        return -_SURE if _inside(text, begin, start) else 3.0
    # a single period
    before = _BEFORE.search(text, max(begin, start - 24), start)
    token = before[0].strip(".’'-") if before else ""
    low = skeleton(token)
    if lower:
        return -4.0
    sentence = text[begin:start].strip()
    if _LIST_NUMBER.match(sentence):
        return -_SURE
    if low in _GO_ON or "." in low and low.rpartition(".")[2] in _GO_ON and low not in _MAY_END:
        return 1.0 if low == "no" and word.lower() in _OPENERS else -4.0
    if low in _MAY_END or "." in low and low.rpartition(".")[2] in _MAY_END:
        return 1.0 if not (after in "([" or after.isdigit() or after == "&") and (after.isupper() or after in _OPEN + "-–•" or _is_cjk(after) or "가" <= after <= "힣") else -3.0
    if len(token) == 1 and token.isalpha() and not _is_cjk(token) and not "가" <= token <= "힣":
        previous = text[max(begin, start - 3) : start - 1]
        if token.isupper():
            return 1.0 if word.lower() in _OPENERS and previous[-1:] not in (".", "&") and not re.search(r"\.\s?\Z", previous) else -3.0
        if re.search(r"\.\s?\Z", previous) or re.match(r"\w\.", text[at : at + 2]):  # z. B., т. е.
            return -3.0
        return 1.0 if len(text[begin:start]) > 3 else -3.0
    if re.match(r"[^\W\d_]\.", text[at : at + 2]) and len(token) <= 2 and token.islower() and token.isalpha():
        return -3.0
    if token.isdigit() and len(token) <= 2:
        words = re.findall(r"[^\W\d_]+", text[max(begin, start - 24) : start])
        if words and words[-1].lower() in _BEFORE_ORDINAL:
            return -2.0
    return 2.0


def _no_blank(text: str, begin: int, start: int, at: int) -> bool:
    """Whether a terminator and a capital that touch are two sentences without the blank between them."""
    before = _BEFORE.search(text, max(begin, start - 24), start)[0]
    if not re.match(r"[^\W\d_](?:[^\W\d_]|\.? |[’'])", text[at : at + 3]):
        return False
    if before[-1:].isdigit():
        return bool(re.fullmatch(r"[^\W\d_]*[-\w]*?\d+(?:[.,]\d+)?", before))
    if not before:
        return text[start - 1 : start] in ")]»”%"
    return len(before) > 1 and (before[-1].islower() or "가" <= before[-1] <= "힣") and "." not in before and skeleton(before) not in _GO_ON


def _inside(text: str, begin: int, end: int) -> bool:
    """Whether a quotation that was opened inside the sentence is still open."""
    piece = text[begin:end]
    for openers, closers in (("„", "”“") if "„" in piece else ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）")):
        if any(c in piece for c in openers):
            at = max(piece.rfind(c) for c in openers)
            rest = piece[at + 1 :]
            if not any(c in rest for c in closers) and not _starts_sentence(text, begin, begin + at):
                return True
    return False


def _spaceless(text: str, begin: int, m: re.Match, at: int) -> bool:
    """Whether the gap of a spaceless script ends the sentence."""
    start = m.start()
    after = text[at : at + 1]
    if not after:
        return True
    last = _last_word(re.search(f"[{_CJK}]*\\Z", text[max(begin, start - 12) : start])[0])
    opening = _first_word(re.match(f"[{_CJK}]*", text[at : at + 8])[0])
    if m["blank"] is not None:
        # no terminator: both sides have to speak for an end
        return (last in _FINALS) + (opening in _OPENINGS) == 2 and not _inside(text, begin, start)
    if after in "，、；：,;:）)」』”’》】〕":
        return False
    score = 2.0 + 0.5 * (last in _FINALS) + 0.5 * (opening in _OPENINGS) + 1.0 * (at > m.end())
    mark = (m["wide"] or m["dots"]) + m["again"]
    if m["close"] and not m["again"]:
        closer = m["close"].strip()[-1]
        opened = _opened_at(text, closer, begin, start)
        if opened > begin and not _starts_sentence(text, begin, opened) and closer not in ")）":
            # a quotation inside: it ends the sentence only with a full stop and nothing that links on
            score -= 2.5 + 1.5 * (opening in _LINKINGS) - 1.5 * (mark[0] in "。｡")
    elif _inside(text, begin, start):
        score -= 2.5
    return score > 1.0


def _enclosed(text: str, size: int) -> list[tuple[int, int]]:
    """Where each quotation or bracket of a text is opened and closed, within one line; marks without a partner are none."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _MARK.finditer(text, 0, size):
        char, at = m[0], m.start()
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if char in _LINES:
            stack.clear()
            continue
        if char in "’‘" and before.isalnum() and after.isalnum():  # an apostrophe
            continue
        openers = _PAIRS.get(char, "")
        if char == '"' and (not before or before.isspace() or before in "([") and after.strip():
            openers = ""  # where it can open, it closes only what has no other end
        place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in openers), None) if openers else None
        if place is not None:
            out.append((stack[place][1], at))
            del stack[place:]
        elif char in _OPENING_MARKS and (char != "»" or after.strip()):
            stack.append((char, at))
    return sorted(out)


def _gap(text: str, begin: int, m: re.Match) -> tuple[int, int, float] | None:
    """Of a gap with a terminator: where a sentence would end, where the next one would begin, and how much speaks for it."""
    end = m.end()
    if end <= begin:
        return None
    if m["close"] and "“" in m["close"] and "„" not in text[begin : m.start()]:
        # it opens the next sentence, which follows without a blank
        m = _GAP.match(text, m.start(), m.start("close") + m["close"].index("“"))
        end = m.end()
    at = _SPACE.match(text, end).end()
    if at < len(text) and "\n" in text[end:at]:
        return end, at, _SURE
    before = text[m.start() - 1 : m.start()]
    wide = m["wide"] is not None or bool(m["again"])
    if not wide and _is_cjk(before) and not (m["dots"][0] == "…" or m["dots"].startswith("..")) and not (m["dots"][0] in ".．" and text[end : end + 1].isalnum() and text[end : end + 1].isascii()):
        wide = True
    if not wide and m["dots"][0] in "…！？" and (_is_cjk(before) or _is_cjk(text[at : at + 1])):
        wide = m["dots"][0] != "…"
        if not wide:
            if m["close"] and not _inside(text, begin, m.start()) and _starts_sentence(text, begin, max(begin, _opened_at(text, m["close"].strip()[-1], begin, m.start()))):
                wide = True
            elif at == m.end():
                return None
    if wide:
        return end, at, _SURE if _spaceless(text, begin, m, at) else -_SURE
    return end, at, _spaced(text, begin, m, at)


def _gaps(text: str) -> list[int]:
    """Ends of the sentences of a text without invisible characters, the last one included: the best path over its gaps.

    A state is the set of open quotations and brackets in which a sentence has already ended; with none open there is one.
    Of each state the best path is kept, with the begin of its last sentence and its ends.
    """
    size = len(text.rstrip())
    marks = _enclosed(text, size) if _MARK.search(text, 0, size) else []
    paths: dict[tuple[int, ...], tuple[float, int, tuple | None]] = {(): (0.0, 0, None)}
    first = 0  # marks before it are closed
    opened: list[int] = []
    for m in _GAP.finditer(text, 0, size):
        start, stop = m.start(), m.end()
        if marks:
            while first < len(marks) and marks[first][0] < start:
                opened.append(first)
                first += 1
            closed = [k for k in opened if marks[k][1] < stop]
            opened = [k for k in opened if marks[k][1] >= stop]
        else:
            closed = []
        following: dict[tuple[int, ...], tuple[float, int, tuple | None]] = {}
        if not opened and len(paths) == 1 and () in paths and m["line"] is None and m["blank"] is None:  # one state before and after
            score, begin, ends = paths[()]
            found = _gap(text, begin, m)
            if found is not None and found[2] > 0:
                end, at, gain = found
                paths[()] = score + gain, at, ends if ends and ends[0] == end else (end, ends)
            continue
        for state, (score, begin, ends) in paths.items():
            # a sentence that closes what another one opened, and goes on
            torn = [k for k in closed if k in state]
            late = sum(marks[k][1] < start for k in torn)
            kept = tuple([k for k in state if k not in closed]) if closed else state
            if m["line"] is not None or m["blank"] is not None:
                end, at = start, stop
                if not text[begin:end].strip():
                    found = None
                else:
                    found = end, at, _SURE if m["line"] is not None or _spaceless(text, begin, m, at) else -_SURE
            else:
                found = _gap(text, begin, m)
            go = score - _TORN * len(torn), begin, ends
            options = [(kept, go)]
            if found is not None:
                end, at, gain = found
                stopped = score + gain - _TORN * late
                for k in opened:
                    if k not in state and not _starts_sentence(text, begin, marks[k][0]):
                        stopped -= _BROKEN[text[marks[k][0]] in _BRACKETS]
                ending = tuple(opened), (stopped, at, ends if ends and ends[0] == end else (end, ends))
                if m["line"] is not None:
                    options = [ending]
                elif opened:
                    options.append(ending)
                elif stopped > go[0]:
                    options = [ending]
            for key, path in options:
                if key not in following or path[0] > following[key][0]:
                    following[key] = path
        paths = following
    # what is torn after the last gap
    _, _, chain = max(((score - _TORN * len(state), begin, ends) for state, (score, begin, ends) in paths.items()), key=lambda x: x[0])
    out: list[int] = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    out.reverse()
    if size and (not out or out[-1] < size):
        out.append(size)
    return out


def sentence_ends(text: str | None) -> list[int]:
    """End positions of the sentences of a text, in its own code points."""
    if not text:
        return []
    if text.isascii() or not _PLAIN.search(text) and not _FAR.search(text):
        return _gaps(text)
    flat = text.translate(_FLAT)
    ends = _gaps(flat)
    if len(flat) != len(text):
        places = [i + 1 for i, c in enumerate(text) if ord(c) not in _INVISIBLE]
        return [places[e - 1] for e in ends]
    return ends


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence; blanks between them belong to none."""
    out, begin = [], 0
    for end in sentence_ends(text):
        while begin < end and text[begin].isspace():
            begin += 1
        out.append((begin, end))
        begin = end
    return out


#: Height of running text.
BODY = 10.0


def paragraphs(items: list[dict] | None, view: list[float] | None, styles: dict | None, height: float = BODY) -> list[list[tuple[int, str]]]:
    """The paragraphs of running text of a page: (run_id, str) of the items of body height, in reading order.

    A paragraph ends where an item of another height comes between, or the next line is more than 1.75 heights lower.
    Items that are null, empty, rotated, out of the view box or monospaced are left out.
    """
    out: list[list[tuple[int, str]]] = []
    previous = None
    for item in items or []:
        if not item or not item["str"]:
            continue
        matrix, size = item["matrix"] or [], item["height"]
        if len(matrix) < 6 or size is None or any(v is None for v in matrix) or matrix[0] <= 0 or abs(matrix[1]) > 1e-3 * matrix[0] or abs(matrix[2]) > 1e-3 * matrix[0]:
            continue
        x, y = matrix[4], matrix[5]
        if view and len(view) == 4 and not (view[0] - 1 <= x <= view[2] + 1 and view[1] - 1 <= y <= view[3] + 1):
            continue
        if abs(size - height) > 0.01 * height or ((styles or {}).get(item["font_name"]) or {}).get("font_family") == "monospace":
            if item["str"].strip():
                previous = None
            continue
        if previous is None or not -0.5 * size <= previous - y <= 1.75 * size:
            out.append([])
        out[-1].append((item["run_id"], item["str"]))
        previous = y
    return out


def run_ends(paragraph: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(run_id, end position in the run) of each sentence of a paragraph."""
    if not paragraph:
        return []
    pieces, starts, at = [], [], 0
    for _, piece in paragraph:
        if pieces and not pieces[-1][-1:].isspace() and not piece[:1].isspace() and not (_is_cjk(pieces[-1][-1:]) or _is_cjk(piece[:1])) and not (pieces[-1][-1:] in "，、。）」』（「『“”…" or piece[:1] in "，、。）」』（「『…"):
            pieces[-1] += " "
            at += 1
        starts.append(at)
        pieces.append(piece)
        at += len(piece)
    text = "".join(pieces).replace("\n", " ").replace("\r", " ")
    out, k = [], 0
    for end in sentence_ends(text):
        while k + 1 < len(starts) and starts[k + 1] < end:
            k += 1
        out.append((paragraph[k][0], min(end - starts[k], len(paragraph[k][1]))))
    return out


def _item_rows(columns: dict[str, list]) -> dict[str, list]:
    ids, ends, begins = [], [], []
    for key, text in zip(columns["item_id"], columns["text"], strict=True):
        for begin, end in sentences(text):
            ids.append(key)
            begins.append(begin)
            ends.append(end)
    return {"rec_id": ids, "start_pos": begins, "end_pos": ends}


def _page_rows(columns: dict[str, list]) -> dict[str, list]:
    ids, ends = [], []
    for runs, texts, lines in zip(columns["runs"], columns["texts"], columns["ys"], strict=True):
        paragraph: list[tuple[int, str]] = []
        previous = None
        for run, text, y in zip(runs, texts, lines, strict=True):
            if text is None:  # something of another height
                previous = None
                continue
            if previous is None or not -0.5 * BODY <= previous - y <= 1.75 * BODY:
                for key, end in run_ends(paragraph):
                    ids.append(key)
                    ends.append(end)
                paragraph = []
            paragraph.append((run, text))
            previous = y
        for key, end in run_ends(paragraph):
            ids.append(key)
            ends.append(end)
    return {"rec_id": ids, "end_pos": ends}


def _body_runs(pages: DataFrame, height: float) -> DataFrame:
    """What paragraphs() keeps of each page, as three flat arrays: the filter runs in the JVM, and Python reads no structs.
    Runs of another height stand as null texts, since they end a paragraph."""
    m = lambda i, k: F.get(i["matrix"], F.lit(k))
    edge = lambda k: F.get("view_box", F.lit(k))

    def kept(i: Column) -> Column:
        upright = (m(i, 0) > 0) & (F.abs(m(i, 1)) <= 1e-3 * m(i, 0)) & (F.abs(m(i, 2)) <= 1e-3 * m(i, 0)) & m(i, 3).isNotNull()
        inside = (F.size("view_box") == 4) & ~(m(i, 4).between(edge(0) - 1, edge(2) + 1) & m(i, 5).between(edge(1) - 1, edge(3) + 1))
        sound = (i["str"] != "") & upright & m(i, 4).isNotNull() & m(i, 5).isNotNull() & i["height"].isNotNull() & ~F.coalesce(inside, F.lit(False))
        return F.coalesce(sound & (body(i) | (F.regexp_replace(i["str"], r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", "") != "")), F.lit(False))

    def body(i: Column) -> Column:
        mono = F.coalesce(F.element_at("styles", i["font_name"])["font_family"] == "monospace", F.lit(False))
        return (F.abs(i["height"] - height) <= 0.01 * height) & ~mono

    runs = pages.select(F.transform(F.filter("text_items", kept), lambda i: F.struct(i["run_id"].alias("r"), F.when(body(i), i["str"]).alias("t"), m(i, 5).alias("y"))).alias("k"))
    return runs.select(F.col("k.r").alias("runs"), F.col("k.t").alias("texts"), F.col("k.y").alias("ys"))


def item_sentences(items: DataFrame) -> DataFrame:
    """(rec_id, start_pos, end_pos) of each sentence of items(item_id, text); each row once, whatever copies there are.

    Rows with a null text have none. Other columns are ignored.
    """
    rows = spread(items.select("item_id", "text").where("text is not null"))
    return map_columns(rows, _item_rows, "rec_id bigint, start_pos int, end_pos int").distinct()


def page_sentences(pages: DataFrame) -> DataFrame:
    """(rec_id, end_pos) of each sentence of the running text of pages(text_items, view_box, styles); each once."""
    rows = spread(pages.select("text_items", "view_box", "styles").where("text_items is not null"))
    return map_columns(_body_runs(rows, BODY), _page_rows, "rec_id bigint, end_pos int").distinct()
