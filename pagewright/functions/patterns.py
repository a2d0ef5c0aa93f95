"""Character classes and fixed word lists, in the spelling of Java's regular expressions.

Everything here is a fixed value that results depend on.
"""

from __future__ import annotations

# White space as text layers use it: the Unicode blanks, and the zero-width no-break space.
BLANK = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Characters written without spaces between words, with their punctuation and full-width forms.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"

# Scripts in the order in which a character is assigned to the first that fits.
SCRIPTS = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "hangul": r"\p{IsHangul}"}

# Abbreviations, without their last period, after which no sentence ends.
ABBREVIATIONS = (
    "e.g i.e al cf vs viz resp approx w.r.t a.k.a incl fig figs eq eqs sec secs tab ref refs ch app appx alg thm lem def prop cor no nos vol pp dr mr mrs ms prof st jr sr "
    "z.b bzw usw vgl ggf bspw d.h u.a abb nr ca evtl inkl sog "
    "ex éq chap env "
    "ej pág núm aprox ud uds sra "
    "es ecc pag sig dott cap "
    "т.е т.д т.п т.к рис табл см напр гл др стр ср им гг"
).split()
# Labels whose number does not end a sentence.
CAPTION_LABELS = "figure fig table tab algorithm listing exhibit".split()
# Marks that close a sentence with its terminator.
CLOSERS = r""")\]"'”’»"""
CJK_TERMINATORS = "。！？．!?"
CJK_CLOSERS = r"」』”’）)】》〉\"'"
# Sentence-final punctuation at the end of a line, with closing marks.
TERMINAL_END = r"""[.!?:。！？．：]["'”’)\]」』）】》]*$"""

LIST_MARKER = r"^(?:(?:[•◦▪‣∙·∗*–—-]|\(?\d{1,2}[.)]|\(?[a-z][.)]|\(?[ivx]{1,4}[.)])[" + BLANK + r"]|[①-⑳・]|（\d{1,2}）|[一二三四五六七八九十]+、)"
SECTION_NUMBER = r"^(?:(?:\d+(?:\.\d+)*\.?|[A-Z](?:\.\d+)*\.?)(?:[" + BLANK + r"]+\p{Lu}|[" + BLANK + r"]*\p{Lo})|第[\d一二三四五六七八九十]+[章節节])"
CAPTION = r"^(?:Figure|Fig\.|Table|Algorithm|Listing|Abbildung|Abb\.|Tabelle|Tableau|Figura|Tabla|Tabela|Tabella|Рис\.|Рисунок|Таблица|图|表|図|그림|표)[" + BLANK + r"]*\d"
HEADING_END = r"""[.,;!?。，；！？．]["'”’)\]」』）]*$"""
HEADING_START = r"^[\p{Lu}\p{Lo}\d]"

# Spacing accents of type-set text and the combining marks they stand for; ligatures and their letters.
SPACING_ACCENTS = {"¨": "̈", "´": "́", "ˊ": "́", "ˋ": "̀", "ˆ": "̂", "˜": "̃", "¸": "̧", "ˇ": "̌"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
LINE_BREAK_HYPHENS = "-­‐"

# Languages: code, English name, own name, script, whether sentences are separated by spaces, note for a prompt.
LANGUAGES = (
    ("zh-CN", "Simplified Chinese", "简体中文", "han", False, "Use Simplified Chinese characters and full-width Chinese punctuation."),
    ("zh-TW", "Traditional Chinese", "繁體中文", "han", False, "Use Traditional Chinese characters, Taiwan terminology and full-width punctuation."),
    ("en", "English", "English", "latin", True, None),
    ("ja", "Japanese", "日本語", "kana", False, "Use the plain (である) style of Japanese academic papers."),
    ("ko", "Korean", "한국어", "hangul", True, "Use the formal written (-다) style of Korean academic papers."),
    ("fr", "French", "Français", "latin", True, None),
    ("de", "German", "Deutsch", "latin", True, None),
    ("es", "Spanish", "Español", "latin", True, None),
    ("pt", "Portuguese", "Português", "latin", True, None),
    ("ru", "Russian", "Русский", "cyrillic", True, None),
    ("it", "Italian", "Italiano", "latin", True, None),
)
DEFAULT_TARGET, FALLBACK_TARGET, AUTO = "zh-CN", "en", "auto"
# Function words by which the languages of the Latin script are told apart.
STOP_WORDS = {
    "en": "the and of to is in that for with are this we be on by as which from it an not",
    "fr": "le la les des et est une dans que pour pas sur par nous du au avec sont cette qui",
    "de": "der die das und ist nicht mit den von zu ein eine wir auf für dem sich auch werden",
    "es": "el los las y es que con por una para del se como está son más este esta lo",
    "pt": "o os as e é que com não uma para do da dos das em se mais são este esta",
    "it": "il gli che e è di per una con del della delle degli dei sono non questo questa si nel nella alla anche",
}
# Frequent characters that differ between the two forms of Chinese.
TRADITIONAL = "們這個為與說對學實體國會發點經應關時過還從間題數據結當於並產總處論圖"
SIMPLIFIED = "们这个为与说对学实体国会发点经应关时过还从间题数据结当于并产总处论图"

# Part of the key of a stored translation.
PROMPT_VERSION = "1"
