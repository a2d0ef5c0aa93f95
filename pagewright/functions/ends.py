"""The sentence rules of sentences.py for page kernels, which need offsets: ends of sentences in a string."""

from __future__ import annotations

import regex

from . import patterns as P



def python(pattern: str) -> str:
    """A pattern of Java in the spelling of Python's regex module."""
    return regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern.replace(r"\p{Is", r"\p{"))


_CJK_CLASS = r"\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯"
CJK = regex.compile(f"[{_CJK_CLASS}]")
LETTER, LOWER = regex.compile(r"\p{L}"), regex.compile(r"\p{Ll}")
TERMINAL = regex.compile(P.TERMINAL_END[:-1] + r"\Z")
_GAP = regex.compile(rf"(?P<end>[.?!][.{P.CLOSERS}]*)\s+(?=\S)")
_EAST_END = regex.compile(rf"(?:[。！？]|(?<=[{_CJK_CLASS}])[!?]|(?<!\p{{Nd}})．|．(?!\p{{Nd}}))[{P.CJK_TERMINATORS}{P.CJK_CLOSERS}]*")
_TOKEN = regex.compile(r"[\p{L}\p{N}.]+\Z")
_PAIR = regex.compile(r"\s*\p{L}{1,3}\.")
_ENUMERATOR = regex.compile(r"\d+|[A-Za-z]|(?i:[ivxlc]+)")
_LABEL = regex.compile(r"(\p{L}+)\s+[\d.]+")
_ABBREVIATIONS, _LABELS = frozenset(P.ABBREVIATIONS), frozenset(P.CAPTION_LABELS)


def is_east(char: str) -> bool:
    return bool(char) and CJK.match(char) is not None


def _protected(before: str, after: str) -> bool:
    """Whether the period between two texts belongs to what stands before it."""
    m = _TOKEN.search(before)
    if not m:
        return False
    token = m[0]
    parts = token.lower().split(".")
    alone = before.strip() == token
    label = _LABEL.fullmatch(before.strip())
    return (
        token.lower() in _ABBREVIATIONS
        or (len(parts) > 1 and len(parts[-1]) > 1 and parts[-1] in _ABBREVIATIONS)
        or regex.fullmatch(r"\p{Lu}", token) is not None
        or (regex.fullmatch(r"\p{Ll}", token) is not None and _PAIR.match(after) is not None)
        or (alone and _ENUMERATOR.fullmatch(token) is not None)
        or (label is not None and label[1].lower() in _LABELS)
    )


def sentence_ends(text: str) -> list[int]:
    """Exclusive ends of the sentences of a text; the last is its length."""
    east = len(CJK.findall(text))
    if east and east > sum(1 for c in LETTER.findall(text) if not CJK.match(c)):
        return [m.end() for m in _EAST_END.finditer(text) if m.end() < len(text)] + [len(text)]
    ends, begin = [], 0
    for m in _GAP.finditer(text):
        if LOWER.match(text, m.end()):
            continue
        if m["end"][0] == "." and _protected(text[begin : m.start()], text[m.start() + 1 :]):
            continue
        ends.append(m.end("end"))
        begin = m.end()
    return [*ends, len(text)]


def is_garbled(text: str) -> bool:
    return 2 * sum(1 for c in text if LETTER.match(c) or c.isspace()) < len(text)
