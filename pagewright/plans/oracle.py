"""Pieces of SQL for the side of DuckDB: the same constants, in its spelling."""

from __future__ import annotations

from ..functions import patterns as P


def re2(pattern: str) -> str:
    """A pattern in the spelling of RE2, as an SQL literal; patterns with look-around have none."""
    for name in ("Han", "Hiragana", "Katakana", "Latin", "Cyrillic", "Hangul"):
        pattern = pattern.replace(f"\\p{{Is{name}}}", f"\\p{{{name}}}")
    return "'" + pattern.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {re2(pattern)}))"


def collapse(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {re2(f'[{P.BLANK}]+')}, ' ', 'g'), '^ | $', '', 'g')"


def normalize(text: str) -> str:
    return collapse(f"nfc_normalize({text})")


def trim_blanks(text: str) -> str:
    return f"regexp_replace({text}, {re2(f'^[{P.BLANK}]+|[{P.BLANK}]+$')}, '', 'g')"


def script_count(text: str, name: str) -> str:
    return count(text, P.SCRIPTS[name])


def stop_hits(text: str, code: str) -> str:
    return f"len(list_filter(regexp_extract_all(lower({text}), '\\p{{L}}+'), lambda w: w IN {words(P.STOP_WORDS[code].split())}))"


def detect(table: str, key: str, text: str) -> str:
    """A query (key, lang) over the rows of a table."""
    hits = ", ".join(f"{stop_hits(text, c)} AS h_{c}" for c in P.STOP_WORDS)
    scripts = ", ".join(f"{script_count(text, s)} AS s_{s}" for s in P.SCRIPTS)
    ranked = "list_reverse_sort([" + ", ".join(f"{{'n': h_{c}, 'code': '{c}'}}" for c in P.STOP_WORDS) + "])"
    return f"""
        SELECT {key}, CASE
            WHEN total = 0 THEN NULL
            WHEN s_kana > 0 AND 2 * (s_han + s_kana) > total THEN 'ja'
            WHEN 2 * s_hangul > total THEN 'ko'
            WHEN 2 * s_han > total THEN CASE WHEN trad > simp THEN 'zh-TW' ELSE 'zh-CN' END
            WHEN 2 * s_cyrillic > total THEN 'ru'
            WHEN 2 * s_latin > total AND ranked[1].n > ranked[2].n AND (ranked[1].n >= 2 OR ranked[2].n = 0) THEN ranked[1].code
        END AS lang FROM (
            SELECT *, s_latin + s_cyrillic + s_han + s_kana + s_hangul AS total, {ranked} AS ranked FROM (
                SELECT {key}, {hits}, {scripts}, {count(text, f"[{P.TRADITIONAL}]")} AS trad, {count(text, f"[{P.SIMPLIFIED}]")} AS simp FROM {table}))"""


def is_cjk_text(text: str) -> str:
    cjk = f"[{P.CJK}]"
    # letters that are not of the class: all letters less those of the class that are letters
    return f"{count(text, cjk)} > len(list_filter(regexp_extract_all({text}, '\\p{{L}}'), lambda c: NOT regexp_matches(c, {re2(cjk)})))"


def sentence_period(before: str, cluster: str, following: str) -> str:
    token = f"regexp_extract({before}, '[\\p{{L}}\\p{{N}}.]+$')"
    lower = f"lower({token})"
    part = f"list_last(string_split({lower}, '.'))"
    label = "^(\\p{L}+)[" + P.BLANK + "]+[\\d.]+$"
    return f"""CASE
        WHEN {token} = '' THEN true
        WHEN {lower} IN {words(P.ABBREVIATIONS)} THEN false
        WHEN contains({lower}, '.') AND {part} IN {words(P.ABBREVIATIONS)} AND length({part}) > 1 THEN false
        WHEN regexp_matches({token}, '^\\p{{Lu}}$') THEN false
        WHEN regexp_matches({token}, '^\\p{{Ll}}$') AND {cluster} = '.' AND regexp_matches({following}, '^\\p{{L}}{{1,3}}\\.') THEN false
        WHEN trim({before}) = {token} AND regexp_matches({token}, '^(?:\\d+|[A-Za-z]|(?i:[ivxlc]+))$') THEN false
        WHEN lower(regexp_extract(trim({before}), {re2(label)}, 1)) IN {words(P.CAPTION_LABELS)} THEN false
        ELSE true END"""


def sentences(table: str, key: str, text: str) -> str:
    """Common table expressions that end with sentences(key, idx, sentence), from one row a key."""
    cluster = f"[.?!][.{P.CLOSERS}]*"
    ends = f"NOT regexp_matches(nxt, '^\\p{{Ll}}') AND (regexp_matches(cluster, '^[?!]') OR {sentence_period('before', 'cluster', 'nxt')})"
    closers = f"[{P.CJK_TERMINATORS}{P.CJK_CLOSERS}]*"
    # RE2 has no look-behind: marks that end nothing are taken out of the way first, then put back
    cjk = f"regexp_replace(regexp_replace(regexp_replace(plain, '(\\p{{Nd}})．(\\p{{Nd}})', '\\1' || chr(57344) || '\\2', 'g'), '(\\p{{Nd}})．(\\p{{Nd}})', '\\1' || chr(57344) || '\\2', 'g'), {re2(f'([{P.CJK}])([!?])')}, '\\1' || chr(57345) || '\\2', 'g')"
    marked = f"regexp_replace({cjk}, {re2(f'((?:[。！？．]|{chr(57345)}[!?])(?:{chr(57345)}|{closers[:-1]})*)')}, '\\1' || chr(1), 'g')"
    back = f"replace(replace({marked}, chr(57344), '．'), chr(57345), '')"
    return f"""
        RECURSIVE plain_rows AS (SELECT {key}, {collapse(text)} AS plain, {is_cjk_text(text)} AS cjk FROM {table} WHERE {text} IS NOT NULL),
        cut AS (SELECT {key}, string_split(regexp_replace(plain, {re2(f'({cluster}) ')}, '\\1' || chr(1), 'g'), chr(1)) AS pieces FROM plain_rows WHERE NOT cjk AND plain <> ''),
        fold AS (
            SELECT {key}, 1::BIGINT AS i, 1::BIGINT AS idx, pieces[1] AS cur FROM cut
            UNION ALL
            SELECT {key}, i, CASE WHEN ends THEN idx + 1 ELSE idx END, CASE WHEN ends THEN nxt ELSE cur || ' ' || nxt END FROM (
                SELECT *, {ends} AS ends FROM (
                    SELECT f.{key}, f.i + 1 AS i, f.idx, f.cur, c.pieces[f.i + 1] AS nxt, regexp_extract(f.cur, {re2(cluster + '$')}) AS cluster,
                        left(f.cur, (length(f.cur) - length(regexp_extract(f.cur, {re2(cluster + '$')})))::BIGINT) AS before
                    FROM fold f JOIN cut c ON c.{key} = f.{key} WHERE f.i < len(c.pieces)))),
        cjk_cut AS (SELECT {key}, list_filter(list_transform(string_split({back}, chr(1)), lambda p: {trim_blanks('p')}), lambda p: p <> '') AS pieces FROM plain_rows WHERE cjk),
        sentences AS (
            SELECT {key}, idx, arg_max(cur, i) AS sentence FROM fold GROUP BY {key}, idx
            UNION ALL
            SELECT {key}, unnest(generate_series(1, len(pieces)))::BIGINT AS idx, unnest(pieces) AS sentence FROM cjk_cut)"""


IS_SENTENCE = "regexp_matches(sentence, '\\p{L}') AND NOT " + count("sentence", f"[\\p{{L}}{P.BLANK}]") + " < 0.5 * length(sentence)"
