"""Text functions as column expressions; none of them needs a Python worker unless it says so.

Null in, null out, for all of them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P

_NEEDS_NFC = r"[\p{M}\x{1161}-\x{11C2}\x{340}\x{341}\x{374}\x{37E}\x{387}\x{958}-\x{95F}\x{1F71}-\x{1FFD}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{F900}-\x{FAFF}]"


@F.pandas_udf(StringType())  # a type, not its name: workers import this without a session
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Composed form. Only texts with a character that composing could change go to Python; the others are nulls there."""
    return F.coalesce(_nfc(F.when(text.rlike(_NEEDS_NFC), text)), text)


def trim_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{P.BLANK}]+|[{P.BLANK}]+$", "")


def collapse_blanks(text: Column) -> Column:
    return trim_blanks(F.regexp_replace(text, f"[{P.BLANK}]+", " "))


def normalize_source(text: Column) -> Column:
    """Composed, runs of blanks as one space, none at the ends: texts that differ in layout only become equal."""
    return collapse_blanks(nfc(text))


def is_cjk_char(char: Column) -> Column:
    return F.coalesce(char.rlike(f"^[{P.CJK}]"), F.lit(False))


def is_cjk_text(text: Column) -> Column:
    """Whether characters written without spaces outnumber other letters."""
    return F.regexp_count(text, F.lit(f"[{P.CJK}]")) > F.regexp_count(text, F.lit(f"(?![{P.CJK}])\\p{{L}}"))


def ends_with_terminal(text: Column) -> Column:
    return F.regexp_replace(text, f"[{P.BLANK}]+$", "").rlike(P.TERMINAL_END)


def continues_sentence(text: Column) -> Column:
    """Whether a line may go on with a sentence begun before: it starts in lower case or without case in Chinese or Japanese."""
    return text.rlike(f"^[\\p{{Ll}}{P.CJK}]")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def is_garbled(text: Column) -> Column:
    """Whether letters and blanks make up less than half of a text."""
    return F.regexp_count(text, F.lit(f"[\\p{{L}}{P.BLANK}]")) < 0.5 * F.length(text)


def is_caption(text: Column) -> Column:
    return text.rlike(P.CAPTION)


def is_list_item(text: Column) -> Column:
    return text.rlike(P.LIST_MARKER)


def has_section_number(text: Column) -> Column:
    return text.rlike(P.SECTION_NUMBER)


def expand_ligatures(text: Column) -> Column:
    for ligature, letters in P.LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return text


def combined_accents() -> dict[str, str]:
    """Spacing accent and letter, as composed letter; made of the Unicode data."""
    out = {}
    for accent, mark in P.SPACING_ACCENTS.items():
        for code in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), 0x131, 0x237]:
            letter = chr(code)
            if letter.isalpha():
                composed = unicodedata.normalize("NFC", {"ı": "i", "ȷ": "j"}.get(letter, letter) + mark)
                if len(composed) == 1:
                    out[accent + letter] = composed
    return out


def line_join(before: Column, after: Column) -> Column:
    """How a line goes on in the next: merge (drop the hyphen), keep (keep it, no space), join (no space) or space."""
    last, previous, first = F.right(before, F.lit(1)), F.substring(before, -2, 1), F.left(after, F.lit(1))
    hyphen = last.rlike(f"[{P.LINE_BREAK_HYPHENS}]") & (F.length(before) >= 2) & previous.rlike(r"^\p{L}") & first.rlike(r"^\p{L}")
    return (
        F.when(is_cjk_char(last) | is_cjk_char(first), "join")
        .when(~F.coalesce(hyphen, F.lit(False)), "space")
        .when(first.rlike(r"^\p{Ll}"), "merge")
        .otherwise("keep")
    )


def join_two(before: Column, after: Column) -> Column:
    """Two lines as one text."""
    before = F.regexp_replace(before, " +$", "")
    how = line_join(before, after)
    return F.when(how == "merge", F.concat(F.left(before, F.length(before) - 1), after)).when(how == "space", F.concat(before, F.lit(" "), after)).otherwise(F.concat(before, after))


def join_lines(lines: Column) -> Column:
    """An array of lines as one text."""
    return F.coalesce(F.reduce(lines, F.lit(None).cast("string"), lambda text, line: F.when(text.isNull(), line).otherwise(join_two(text, line))), F.lit(""))


def with_space(text: Column) -> Column:
    """A text with a space to separate it from the next, unless it ends without spaces between words."""
    return F.when(is_cjk_char(F.right(text, F.lit(1))), text).otherwise(F.concat(text, F.lit(" ")))


def format_message(template: Column, args: Column) -> Column:
    """{0}, {1}, ... by the elements of an array; places without an element stay."""
    places = F.sequence(F.lit(0), F.size(args) - 1)
    filled = F.reduce(places, template, lambda text, i: F.replace(text, F.concat(F.lit("{"), i.cast("string"), F.lit("}")), F.coalesce(F.get(args, i), F.concat(F.lit("{"), i.cast("string"), F.lit("}")))))
    return F.when(F.size(args) > 0, filled).otherwise(template)


def escape_attribute(value: Column) -> Column:
    """A value as JSON in an attribute."""
    return F.replace(F.to_json(value), F.lit('"'), F.lit("&quot;"))
