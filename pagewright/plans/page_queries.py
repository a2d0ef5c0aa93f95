"""Queries on pages, blocks, requests and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language, patterns as P, text as T
from ..operators import batching, enrich, layout, probe, render, reply, settings
from ..sources import pages as page_source
from ..sources.tables import table
from ..streaming import jobs, states
from . import oracle as O
from .text_queries import ITEMS, blocks, items

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def pages(spark, d) -> DataFrame:
    return table(spark, d, "page_texts", "paper_id", "page", "view_box", "styles", "text_items")


# ---- batches of work items: document = paper, order = item_id, group = paragraph

_WORK = "(SELECT DISTINCT item_id, paper_id || '#' || (item_id // 50000) AS doc, grp, length(text)::BIGINT AS n_chars, text FROM work_items WHERE text IS NOT NULL AND paper_id IS NOT NULL)"
_BUDGET, _MOST = 1200, 10
_BATCH_SQL = f"""
    RECURSIVE rows_ AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY item_id) AS i, lag(grp) OVER (PARTITION BY doc ORDER BY item_id) AS before FROM {_WORK}),
    runs AS (SELECT *, sum(CASE WHEN grp IS NOT NULL AND grp = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i) AS run FROM rows_),
    sized AS (SELECT *, sum(n_chars) OVER (PARTITION BY doc, run)::BIGINT AS whole, count(*) OVER (PARTITION BY doc, run) AS many, row_number() OVER (PARTITION BY doc, run ORDER BY i) AS nth FROM runs),
    fold AS (
        SELECT doc, i, item_id, 0::BIGINT AS batch, 1::BIGINT AS seq, n_chars AS chars FROM sized WHERE i = 1
        UNION ALL
        SELECT doc, i, item_id, CASE WHEN fresh THEN batch + 1 ELSE batch END, CASE WHEN fresh THEN 1 ELSE seq + 1 END, CASE WHEN fresh THEN n_chars ELSE chars + n_chars END FROM (
            SELECT s.doc, s.i, s.item_id, s.n_chars, f.batch, f.seq, f.chars,
                (s.nth = 1 AND (f.chars + s.whole > {_BUDGET} OR f.seq + s.many > {_MOST})) OR f.chars + s.n_chars > {_BUDGET} OR f.seq >= {_MOST} AS fresh
            FROM fold f JOIN sized s ON s.doc = f.doc AND s.i = f.i + 1))"""


def _batched(spark, d) -> DataFrame:
    work = items(spark, d, "paper_id", "grp", "text").where("text is not null and paper_id is not null").distinct()
    work = work.select(F.col("paper_id").alias("doc"), F.col("item_id").alias("ord"), "grp", "text", F.length("text").cast("long").alias("n_chars"))
    batched = batching.batches(work, _BUDGET, _MOST)
    return batched.withColumn("doc", F.concat_ws("#", "doc", F.col("section").cast("string")))


@query(f"WITH {_BATCH_SQL} SELECT doc, item_id, batch, seq FROM fold")
def q19_batch_pack(spark, d):
    return _batched(spark, d).select("doc", F.col("ord").alias("item_id"), "batch", F.col("seq").cast("long").alias("seq"))


@query(f"""WITH {_BATCH_SQL}, sums AS (SELECT f.doc, f.batch, sum(w.n_chars)::BIGINT AS chars, count(*) AS n, string_agg(w.text, ' ' ORDER BY f.seq) AS whole FROM fold f JOIN {_WORK} w ON w.item_id = f.item_id AND w.doc = f.doc GROUP BY f.doc, f.batch),
    told AS (SELECT doc || '/' || batch AS k, whole AS text FROM sums), langs AS ({O.detect("told", "k", "text")})
    SELECT s.doc, s.batch, s.chars, s.n AS n_sentences, coalesce(l.lang, 'auto') AS source,
        least(8192, ceil(s.chars * CASE WHEN l.lang IN ('zh-CN', 'zh-TW', 'ja', 'ko') THEN 1.5 ELSE 0.8 END) + 30 * s.n + 256)::BIGINT AS max_tokens
    FROM sums s JOIN langs l ON l.k = s.doc || '/' || s.batch""")
def q20_requests(spark, d):
    return batching.requests_of(_batched(spark, d)).select("doc", "batch", "chars", "n_sentences", "source", F.col("max_tokens").cast("long").alias("max_tokens"))


# ---- replies: made of translated items, fenced, bare, with unknown ids and gaps

_REPLY = """(SELECT item_id AS reply_id, ['s1', 's2', 's3'] AS expected, CASE item_id % 4
    WHEN 0 THEN '```json' || chr(10) || '{"translations":[{"id":"s1","translation":' || t || '},{"id":"x9","translation":"?"}]}' || chr(10) || '```'
    WHEN 1 THEN '[{"id":"s1","zh":' || t || '},{"id":"s2","translation":"  "},{"id":5,"translation":"no"}]'
    WHEN 2 THEN '{"translations":[{"id":"s3","translation":"old"},{"id":"s3","translation":' || t || '}]}'
    ELSE 'no json: ' || t END AS content FROM (SELECT item_id, '"item ' || item_id || '"' AS t FROM (SELECT DISTINCT item_id FROM translated_items)))"""


def _replies(spark, d) -> DataFrame:
    ids = table(spark, d, "translated_items", "item_id").distinct()
    t = F.concat(F.lit('"item '), "item_id", F.lit('"'))
    n = F.col("item_id") % 4
    content = (
        F.when(n == 0, F.concat(F.lit('```json\n{"translations":[{"id":"s1","translation":'), t, F.lit('},{"id":"x9","translation":"?"}]}\n```')))
        .when(n == 1, F.concat(F.lit('[{"id":"s1","zh":'), t, F.lit('},{"id":"s2","translation":"  "},{"id":5,"translation":"no"}]')))
        .when(n == 2, F.concat(F.lit('{"translations":[{"id":"s3","translation":"old"},{"id":"s3","translation":'), t, F.lit("}]}")))
        .otherwise(F.concat(F.lit("no json: "), t))
    )
    return ids.select(F.col("item_id").alias("reply_id"), F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")).alias("expected"), content.alias("content"))


_PARSED = f"""(SELECT reply_id, id, arg_max(coalesce(tr, zh), pos) AS translation FROM (
        SELECT reply_id, pos, json_extract_string(e, '$.id') AS id, json_type(e, '$.id') AS kind, CASE WHEN json_type(e, '$.translation') = 'VARCHAR' THEN trim(json_extract_string(e, '$.translation')) END AS tr, CASE WHEN json_type(e, '$.zh') = 'VARCHAR' THEN trim(json_extract_string(e, '$.zh')) END AS zh
        FROM (SELECT reply_id, unnest(es) AS e, generate_subscripts(es, 1) AS pos FROM (
            SELECT reply_id, CASE WHEN json_type(j) = 'ARRAY' THEN j::JSON[] ELSE json_extract(j, '$.translations')::JSON[] END AS es FROM (
                SELECT reply_id, try_cast(regexp_replace(regexp_replace(content, '^```(?:json)?\\s*', ''), '\\s*```$', '') AS JSON) AS j FROM {_REPLY}))))
    WHERE kind = 'VARCHAR' AND id IN ('s1', 's2', 's3') AND coalesce(tr, zh) <> '' GROUP BY reply_id, id)"""


@query(f"SELECT reply_id, id, translation FROM {_PARSED}")
def q21_parse_reply(spark, d):
    return reply.parse(_replies(spark, d))


@query(f"SELECT r.reply_id, u.id FROM {_REPLY} r, unnest(['s1', 's2', 's3']) AS u(id) LEFT JOIN {_PARSED} p ON p.reply_id = r.reply_id AND p.id = u.id WHERE p.id IS NULL")
def q21_missing_ids(spark, d):
    return reply.missing(_replies(spark, d)).select("reply_id", "id")


# ---- ranges of pages, sections, rendering

_RANGE = "CASE WHEN block_no % 3 = 0 THEN 'page' WHEN block_no % 3 = 1 THEN 'nearby' ELSE 'manual' END"


@query(f"""
    WITH b AS (SELECT DISTINCT block_no, paper_id, page FROM blocks), n AS (SELECT paper_id, max(page) AS n_pages FROM b GROUP BY paper_id)
    SELECT block_no, wanted FROM (
        SELECT b.block_no, n.n_pages, unnest(CASE {_RANGE} WHEN 'page' THEN [page] WHEN 'nearby' THEN [page, page + 1, page - 1] ELSE [] END) AS wanted FROM b JOIN n USING (paper_id))
    WHERE wanted BETWEEN 1 AND n_pages""")
def q22_pages_in_range(spark, d):
    rows = blocks(spark, d, "paper_id", "page").distinct()
    last = rows.groupBy("paper_id").agg(F.max("page").alias("n_pages"))
    kind = F.when(F.col("block_no") % 3 == 0, "page").when(F.col("block_no") % 3 == 1, "nearby").otherwise("manual")
    return probe.pages_in_range(rows.withColumn("rng", kind).join(last, "paper_id")).select("block_no", "wanted")


@query("""
    WITH b AS (SELECT DISTINCT paper_id AS doc, page, block_idx AS idx, block_role AS role, text FROM blocks WHERE paper_id IS NOT NULL),
    r AS (SELECT *, sum(CASE WHEN role = 'figure' THEN 0 ELSE 1 END) OVER w AS run, sum(CASE WHEN role IN ('figure', 'code') THEN 0 ELSE 1 END) OVER w AS listing FROM b WINDOW w AS (PARTITION BY doc, page ORDER BY idx))
    SELECT doc, page, min(idx) AS first_idx, min(role) AS role, count(*) AS n_blocks, CASE WHEN min(role) <> 'figure' THEN string_agg(text, chr(10) ORDER BY idx) END AS text
    FROM r GROUP BY doc, page, CASE role WHEN 'figure' THEN 'f' || run WHEN 'code' THEN 'c' || listing ELSE 'b' || idx END""")
def q24_sections(spark, d):
    rows = blocks(spark, d, "paper_id", "page", "block_idx", "block_role", "text").where("paper_id is not null").distinct()
    return render.sections(rows.select(F.col("paper_id").alias("doc"), "page", F.col("block_idx").alias("idx"), F.col("block_role").alias("role"), "text"))


_FRAGMENTS = """(SELECT paper_id, page, item, i.run_id AS run_id, i.str AS str, m[5] AS x, m[6] AS y, i.width AS w,
        coalesce(nullif(sqrt(m[3] * m[3] + m[4] * m[4]), 0), nullif(i.height, 0), 1) AS size,
        coalesce(styles[i.font_name].font_family = 'monospace', false) AS mono, """ + O.trim_blanks("i.str") + """ = '' AS blank
    FROM (SELECT paper_id, page, view_box AS v, styles, unnest(text_items) AS i, unnest(text_items).matrix AS m, generate_subscripts(text_items, 1) - 1 AS item FROM (SELECT DISTINCT ON (paper_id, page) * FROM page_texts))
    WHERE i.str <> '' AND m[1] > 0 AND abs(m[2]) <= 1e-3 * m[1] AND abs(m[3]) <= 1e-3 * m[1]
        AND m[5] BETWEEN coalesce(v[1], 0) - 1 AND coalesce(v[3], 'Infinity'::DOUBLE) + 1 AND m[6] BETWEEN coalesce(v[2], 0) - 1 AND coalesce(v[4], 'Infinity'::DOUBLE) + 1)"""


def _fragments(spark, d) -> DataFrame:
    return layout.fragments(pages(spark, d).dropDuplicates(["paper_id", "page"]))


@query(f"SELECT paper_id, page, item::BIGINT AS item, run_id, str, x, y, w, size, mono, blank FROM {_FRAGMENTS}")
def q26_fragments(spark, d):
    return _fragments(spark, d).withColumn("item", F.col("item").cast("long"))


# lines of pages; holds for pages without blank runs between lines, as these are
_LINES = f"""
    RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY item) AS i FROM {_FRAGMENTS}),
    fold AS (
        SELECT paper_id, page, i, item, str, mono, blank, 0::BIGINT AS line_idx, x + w AS x1, y, size, x AS x0 FROM f WHERE i = 1 AND NOT blank
        UNION ALL
        SELECT paper_id, page, i, item, str, mono, blank,
            CASE WHEN same THEN line_idx ELSE line_idx + 1 END, CASE WHEN NOT same THEN x + w WHEN blank THEN x1 ELSE greatest(x1, x + w) END,
            CASE WHEN same AND (blank OR size <= lsize * 1.15) THEN ly ELSE y END, CASE WHEN same AND (blank OR size <= lsize * 1.15) THEN lsize ELSE size END, CASE WHEN same THEN x0 ELSE x END
        FROM (SELECT f.*, o.line_idx, o.x1, o.y AS ly, o.size AS lsize, o.x0,
                abs(f.y - o.y) <= 0.5 * greatest(o.size, f.size) AND f.x BETWEEN o.x1 - greatest(o.size, f.size) AND o.x1 + 2.5 * greatest(o.size, f.size) AS same
            FROM fold o JOIN f ON f.paper_id = o.paper_id AND f.page = o.page AND f.i = o.i + 1)),
    lines_ AS (
        SELECT paper_id, page, line_idx, min(x0) AS x0, arg_max(x1, i) AS x1, arg_max(y, i) AS y, arg_max(size, i) AS size, {O.trim_blanks("string_agg(str, '' ORDER BY i)")} AS text,
            coalesce(sum(length(str)) FILTER (mono AND NOT blank), 0) >= 0.8 * sum(length(str)) FILTER (NOT blank) AS mono
        FROM fold GROUP BY paper_id, page, line_idx)"""
# marks that end a sentence, with what may close after them; captions; both as the text layer is read
_ENDS = "regexp_matches(text, {})".format(O.re2(P.TERMINAL_END))
_FOLLOWS = "regexp_matches(text, {})".format(O.re2(f"^[\\p{{Ll}}{P.CJK}]"))
_BLOCKS = f"""{_LINES},
    told AS (SELECT *, {_ENDS} AS ends, {_FOLLOWS} AS follows, regexp_matches(text, {O.re2(P.CAPTION)}) AS caption FROM lines_),
    grow AS (
        SELECT paper_id, page, line_idx, 0::BIGINT AS b, 1::BIGINT AS n, mono AS bmono, size AS bsize, x0 AS bleft, x1 AS bright, NULL::DOUBLE AS pitch, x1, y, ends FROM told WHERE line_idx = 0
        UNION ALL
        SELECT paper_id, page, line_idx, CASE WHEN fits THEN b ELSE b + 1 END, CASE WHEN fits THEN n + 1 ELSE 1 END, CASE WHEN fits THEN bmono ELSE mono END, CASE WHEN fits THEN bsize ELSE size END,
            CASE WHEN fits AND n > 1 THEN bleft ELSE x0 END, CASE WHEN fits THEN greatest(bright, x1) ELSE x1 END, CASE WHEN fits THEN coalesce(pitch, CASE WHEN down > 0 THEN down END) END, x1, y, ends
        FROM (SELECT *, mono = bmono AND abs(size - bsize) <= 0.15 * bsize AND CASE
                WHEN down < -0.5 * bsize OR x0 > px1 + bsize THEN NOT pends AND follows
                ELSE down <= coalesce(pitch + 0.4 * bsize, 1.55 * bsize) AND (n = 1 OR (abs(x0 - bleft) <= 0.6 * bsize AND NOT (pends AND px1 < bright - 2.5 * bsize))) END AS fits
            FROM (SELECT t.*, g.b, g.n, g.bmono, g.bsize, g.bleft, g.bright, g.pitch, g.x1 AS px1, g.ends AS pends, g.y - t.y AS down FROM grow g JOIN told t ON t.paper_id = g.paper_id AND t.page = g.page AND t.line_idx = g.line_idx + 1))),
    facts AS (
        SELECT g.paper_id, g.page, g.b, count(*) >= 2 AND NOT arg_min(t.mono, t.line_idx) AS body, arg_min(t.size, t.line_idx) AS first, arg_max(t.size, t.line_idx) AS last, max(t.x1 - t.x0) AS width,
            NOT arg_max(t.ends, t.line_idx) AS open, arg_min(t.follows, t.line_idx) AS follows, arg_min(t.caption, t.line_idx) AS caption
        FROM grow g JOIN told t ON t.paper_id = g.paper_id AND t.page = g.page AND t.line_idx = g.line_idx GROUP BY ALL),
    listed AS (SELECT paper_id, page, list({{'b': b, 'body': body, 'first': first, 'width': width, 'follows': follows, 'caption': caption}} ORDER BY b) AS all_ FROM facts GROUP BY ALL),
    rejoin AS (
        SELECT paper_id, page, -1::BIGINT AS b, []::BIGINT[] AS heads, []::BIGINT[] AS tails FROM listed
        UNION ALL
        SELECT paper_id, page, b, CASE WHEN apt THEN list_append(heads, b) ELSE heads END, CASE WHEN apt THEN list_append(tails, tail.b) ELSE tails END FROM (
            SELECT *, body AND open AND NOT list_contains(tails, b) AND coalesce(tail.follows, false) AS apt FROM (
                SELECT f.*, r.heads, r.tails, list_filter(list_filter(l.all_, lambda x: x.b > f.b AND NOT list_contains(r.tails, x.b))[1:30],
                    lambda x: x.body AND abs(x.first - f.last) <= 0.15 * f.last AND x.width >= 0.7 * f.width AND NOT x.caption)[1] AS tail
                FROM rejoin r JOIN facts f ON f.paper_id = r.paper_id AND f.page = r.page AND f.b = r.b + 1 JOIN listed l ON l.paper_id = r.paper_id AND l.page = r.page))),
    ended AS (SELECT paper_id, page, arg_max(heads, b) AS heads, arg_max(tails, b) AS tails FROM rejoin GROUP BY ALL),
    placed AS (
        SELECT f.paper_id, f.page, f.b, CASE WHEN list_contains(tails, f.b) THEN heads[list_position(tails, f.b)] ELSE f.b END AS owner FROM facts f JOIN ended e ON e.paper_id = f.paper_id AND e.page = f.page),
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY paper_id, page ORDER BY owner) - 1 AS block_idx FROM placed)"""


@query(f"""
    WITH {_LINES} SELECT paper_id, page, coalesce(nullif(arg_max(half, (n, -first_line)), 0), 10)::DOUBLE AS body_size FROM (
        SELECT paper_id, page, floor(size * 2 + 0.5) / 2 AS half, sum(length(text)) AS n, min(line_idx) AS first_line FROM lines_ WHERE NOT mono GROUP BY ALL) GROUP BY paper_id, page
    UNION ALL SELECT paper_id, page, 10 FROM lines_ GROUP BY ALL HAVING bool_and(mono)""")
def q25_dominant_size(spark, d):
    """The size most characters of a page have, by its lines without code."""
    return layout.body_sizes(pages(spark, d))


@query(f"WITH {_LINES} SELECT paper_id, page, line_idx, x0, x1, y, size, mono, text FROM lines_")
def q27_group_lines(spark, d):
    return layout.lines(pages(spark, d)).select("paper_id", "page", F.col("line_idx").cast("long").alias("line_idx"), "x0", "x1", "y", "size", "mono", "text")


@query(f"""
    WITH {_BLOCKS} SELECT g.paper_id, g.page, g.line_idx, n.block_idx FROM grow g JOIN numbered n ON n.paper_id = g.paper_id AND n.page = g.page AND n.b = g.b""")
def q28_block_of_line(spark, d):
    """The block of each line, with the paragraphs that floats interrupt made whole (q29)."""
    return layout.lines(pages(spark, d)).select("paper_id", "page", F.col("line_idx").cast("long").alias("line_idx"), F.col("block_idx").cast("long").alias("block_idx"))


_PAGE_TOTALS = f"""
    WITH {_BLOCKS}, body AS (SELECT paper_id, page, arg_max(half, (n, -first_line)) AS body FROM (
        SELECT paper_id, page, floor(size * 2 + 0.5) / 2 AS half, sum(length(text)) AS n, min(line_idx) AS first_line FROM lines_ WHERE NOT mono GROUP BY ALL) GROUP BY paper_id, page),
    whole AS (
        SELECT n.paper_id, n.page, n.block_idx, count(*) AS n_lines, arg_min(t.size, (n.b <> n.owner, t.line_idx)) AS size, 2 * count_if(t.mono) > count(*) AS code, arg_min(t.text, (n.b <> n.owner, t.line_idx)) AS head
        FROM grow g JOIN numbered n ON n.paper_id = g.paper_id AND n.page = g.page AND n.b = g.b JOIN told t ON t.paper_id = g.paper_id AND t.page = g.page AND t.line_idx = g.line_idx GROUP BY ALL)
    SELECT w.paper_id, w.page, w.block_idx, w.n_lines, CASE WHEN code THEN 'code' WHEN regexp_matches(head, {O.re2(P.CAPTION)}) THEN 'caption'
        WHEN size < 0.88 * body AND (length(head) <= 60 OR size < 0.7 * body) THEN 'figure'
        WHEN length(head) <= 90 AND NOT regexp_matches(head, {O.re2(P.HEADING_END)}) AND regexp_matches(head, {O.re2(P.HEADING_START)}) THEN 'heading'
        WHEN regexp_matches(head, {O.re2(P.LIST_MARKER)}) THEN 'list' WHEN size < 0.88 * body THEN 'note' ELSE 'paragraph' END AS role,
        CASE WHEN size >= 1.35 * body THEN 1 WHEN size > 1.15 * body THEN 2 ELSE 3 END AS level_if_heading
    FROM whole w JOIN body USING (paper_id, page) WHERE n_lines = 1"""


@query(f"SELECT paper_id, page, block_idx, role, CASE WHEN role = 'heading' THEN level_if_heading END::INTEGER AS level FROM ({_PAGE_TOTALS})")
def q30_roles_of_single_lines(spark, d):
    """Roles and levels of the blocks of one line, whose text SQL has as it stands."""
    rows = layout.blocks(pages(spark, d)).where("n_lines = 1")
    return rows.select("paper_id", "page", F.col("block_idx").cast("long").alias("block_idx"), "role", "level")


@query()
def q28_group_blocks(spark, d):
    """Blocks of pages, with paragraphs joined across floats (q29) and roles (q30)."""
    return layout.blocks(pages(spark, d)).select("paper_id", "page", "block_idx", "block_id", "kind", "role", "level", "n_lines", "text")


@query()
def q33_sentences_with_rects(spark, d):
    rows = layout.sentences(pages(spark, d))
    return rows.select("paper_id", "page", "sent_id", "role", "text", "span.*", F.size("rects").alias("n_rects"), F.array_max(F.transform("rects", lambda r: r["y"] + r["h"])).alias("top"))


# ---- probes: rectangles of blocks, and a grid of points on each page

_RECTS = "(SELECT b.paper_id AS doc, b.page, b.block_no AS id, (b.block_idx * 1000 + i)::BIGINT AS ord, i AS line, r.x0 AS x, r.y0 AS y, r.w AS w, r.h AS h FROM (SELECT block_no, paper_id, page, block_idx, unnest(line_rects) AS r, generate_subscripts(line_rects, 1) AS i FROM (SELECT DISTINCT ON (block_no) * FROM blocks) WHERE paper_id IS NOT NULL) b)"
_POINTS = "(SELECT paper_id || '/' || page || '/' || px || '/' || py AS probe_id, paper_id AS doc, page, px::DOUBLE AS px, py::DOUBLE AS py FROM (SELECT DISTINCT paper_id, page FROM blocks WHERE paper_id IS NOT NULL), unnest([70, 200, 524, 600]) AS a(px), unnest([100, 401, 642, 660, 779]) AS b(py))"
_GAP_X, _GAP_Y = "greatest(x - px, 0, px - (x + w))", "greatest(y - py, 0, py - (y + h))"


def _rects(spark, d) -> DataFrame:
    rows = table(spark, d, "blocks", "block_no", "paper_id", "page", "block_idx", "line_rects").where("paper_id is not null").dropDuplicates(["block_no"])
    rows = rows.select(F.col("paper_id").alias("doc"), "page", F.col("block_no").alias("id"), "block_idx", F.posexplode("line_rects").alias("pos", "r"))
    line = F.col("pos").cast("long") + 1
    return rows.select("doc", "page", "id", (F.col("block_idx").cast("long") * 1000 + line).alias("ord"), line.alias("line"), F.col("r.x0").alias("x"), F.col("r.y0").alias("y"), F.col("r.w").alias("w"), F.col("r.h").alias("h"))


def _points(spark, d) -> DataFrame:
    own = table(spark, d, "blocks", "paper_id", "page").where("paper_id is not null").distinct()
    grid = [(float(x), float(y)) for x in (70, 200, 524, 600) for y in (100, 401, 642, 660, 779)]
    points = own.withColumn("p", F.explode(F.array(*[F.struct(F.lit(x).alias("px"), F.lit(y).alias("py")) for x, y in grid])))
    return points.select(F.concat_ws("/", "paper_id", "page", F.col("p.px").cast("int"), F.col("p.py").cast("int")).alias("probe_id"), F.col("paper_id").alias("doc"), "page", "p.px", "p.py")


@query(f"SELECT probe_id, arg_min(id, (dist, -ord)) AS id FROM (SELECT *, sqrt({_GAP_X} * {_GAP_X} + {_GAP_Y} * {_GAP_Y}) AS dist FROM {_POINTS} p JOIN {_RECTS} r USING (doc, page)) WHERE dist <= 3 GROUP BY probe_id")
def q31_hit_test(spark, d):
    return probe.hit_test(_points(spark, d), _rects(spark, d))


@query(f"""SELECT probe_id, arg_min(id, (score, ord)) AS id, arg_min(line, (score, ord)) AS line, arg_min(within, (score, ord)) AS within FROM (
    SELECT *, 4 * {_GAP_Y} + {_GAP_X} AS score, least(1.0, greatest(0.0, coalesce((y + h - py) / nullif(h, 0), 0)))::DOUBLE AS within FROM {_POINTS} p JOIN {_RECTS} r USING (doc, page)) GROUP BY probe_id""")
def q32_line_at(spark, d):
    return probe.line_at(_points(spark, d), _rects(spark, d))


@query(f"SELECT doc || '/' || page AS view_id, arg_min(id, ord) AS id FROM {_RECTS} WHERE x < 600 AND x + w > 60 AND y < 700 AND y + h > 500 GROUP BY doc, page")
def q32_first_in_view(spark, d):
    own = table(spark, d, "blocks", "paper_id", "page").where("paper_id is not null").distinct()
    views = own.select(F.concat_ws("/", "paper_id", "page").alias("view_id"), F.col("paper_id").alias("doc"), "page", F.lit(60.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(700.0).alias("y1"))
    return probe.first_in_view(views, _rects(spark, d))


@query("""
    WITH p AS (SELECT DISTINCT paper_id AS doc, page, (page - 1) * 850.0::DOUBLE AS top, (page - 1) * 850.0 + 842 AS bottom FROM page_texts),
    q AS (SELECT DISTINCT item_id AS point_id, paper_id AS doc, (item_id % 700 * 50.0)::DOUBLE AS py FROM work_items)
    SELECT point_id, min(page) AS page FROM q JOIN p ON p.doc = q.doc AND py >= top AND py < bottom GROUP BY point_id""")
def q32_page_at(spark, d):
    own = table(spark, d, "page_texts", "paper_id", "page").distinct()
    top = (F.col("page") - 1) * F.lit(850.0)
    places = own.select(F.col("paper_id").alias("doc"), "page", top.alias("top"), (top + 842).alias("bottom"))
    points = items(spark, d, "paper_id").distinct().select(F.col("item_id").alias("point_id"), F.col("paper_id").alias("doc"), (F.col("item_id") % 700 * F.lit(50.0)).alias("py"))
    return probe.page_at(points, places)


# ---- enrichment and rendering


def _fails(text: str) -> bool:
    return "Corpus" in text


_ALREADY = O.detect(ITEMS, "item_id", "text")


@query(f"""
    WITH lang AS ({_ALREADY}), k AS (SELECT i.item_id, i.text, l.lang, sha1({O.normalize('i.text')} || chr(0) || 'm1' || chr(0) || 'en' || chr(0) || '1' || chr(0) || '97d170e1550e') AS key FROM {ITEMS} i JOIN lang l USING (item_id)),
    f AS (SELECT key, arg_min(text, item_id) AS first_text FROM k WHERE lang IS DISTINCT FROM 'en' GROUP BY key)
    SELECT k.item_id, CASE WHEN k.lang = 'en' THEN k.text WHEN contains(f.first_text, 'Corpus') THEN NULL ELSE {O.trim_blanks("'T(' || f.first_text || ')'")} END AS translation,
        CASE WHEN k.lang = 'en' THEN '' ELSE k.key END AS cache_key, CASE WHEN k.lang IS DISTINCT FROM 'en' AND contains(f.first_text, 'Corpus') THEN 'noTranslation' END AS code
    FROM k LEFT JOIN f ON f.key = k.key""")
def q34_translate(spark, d):
    """All items through the pipeline, with a client that answers T(text) and leaves out texts with one word."""
    rows = items(spark, d, "text").where("text is not null").distinct().select(F.lit("all").alias("doc"), F.col("item_id").alias("ord"), F.col("item_id").alias("id"), "text", F.lit(None).cast("string").alias("grp"))
    store = spark.createDataFrame([], "key string, translation string")
    results, _ = enrich.translate(rows, store, enrich.EchoClient(fails=_fails), enrich.Options(target="en"))
    return results.select(F.col("id").alias("item_id"), "translation", "cache_key", "code")


_SHOWN = "(SELECT t.item_id, max(t.translation) AS translation FROM (SELECT DISTINCT request_id, item_id, translation FROM translated_items) t JOIN requests r ON r.request_id = t.request_id WHERE lower(r.target_language) = 'zh-cn' AND " + O.trim_blanks("t.translation") + " <> '' GROUP BY t.item_id)"
_SPACED = "CASE WHEN regexp_matches(right(text, 1), " + O.re2(f"^[{P.CJK}]") + ") THEN text ELSE text || ' ' END"


@query(f"""
    SELECT doc, grp, string_agg(coalesce(translation, {_SPACED}), '' ORDER BY item_id) AS target_text, string_agg({_SPACED}, '' ORDER BY item_id) AS source_text
    FROM (SELECT DISTINCT item_id, paper_id AS doc, page || '/' || grp AS grp, text FROM work_items WHERE grp IS NOT NULL AND paper_id IS NOT NULL AND text IS NOT NULL) LEFT JOIN {_SHOWN} USING (item_id) GROUP BY doc, grp""")
def q35_render_paragraphs(spark, d):
    rows = items(spark, d, "paper_id", "page", "grp", "text").where("grp is not null and paper_id is not null and text is not null").distinct()
    rows = rows.select(F.col("paper_id").alias("doc"), F.concat_ws("/", F.col("page").cast("string"), "grp").alias("grp"), F.col("item_id").alias("ord"), F.col("item_id").alias("id"), "text")
    wanted = table(spark, d, "requests", "request_id", "target_language").where(F.lower("target_language") == "zh-cn").select("request_id")
    replies = table(spark, d, "translated_items", "request_id", "item_id", "translation").where(T.trim_blanks(F.col("translation")) != "")
    best = replies.join(wanted, "request_id").groupBy("item_id").agg(F.max("translation").alias("translation"))
    translations = rows.select("doc", "id").join(best, F.col("id") == F.col("item_id")).select("doc", "id", "translation")
    return render.paragraphs(rows, translations, "zh-CN")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'ask' WHEN 'click' THEN 'reply' WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'retry' ELSE 'reset' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    fold AS (
        SELECT user_id, 0::BIGINT AS i, 'none' AS status, -1::BIGINT AS seq FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT user_id, i, coalesce(nxt, status), CASE WHEN nxt IS NULL THEN seq ELSE event_id END FROM (
            SELECT f.user_id, e.i, e.event_id, f.status, f.seq, CASE
                WHEN kind = 'reset' THEN 'none'
                WHEN kind = 'ask' AND status IN ('none', 'error') THEN 'pending'
                WHEN kind = 'retry' AND status = 'error' THEN 'none'
                WHEN kind = 'reply' AND status = 'pending' THEN 'done'
                WHEN kind = 'failure' AND status = 'pending' THEN 'error' END AS nxt
            FROM fold f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
    SELECT user_id::VARCHAR AS id, arg_max(status, i) AS status, arg_max(seq, i) AS seq FROM fold GROUP BY user_id""")
def q36_states(spark, d):
    """Last states of the users of the event table, its types taken for kinds of events."""
    kind = F.col("event_type")
    kind = F.when(kind == "view", "ask").when(kind == "click", "reply").when(kind == "error", "failure").when(kind == "signup", "retry").otherwise("reset")
    events = table(spark, d, "events", "event_id", "user_id", "event_type").select(F.lit("d").alias("doc"), F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.lit(1).cast("long").alias("request_id"), F.lit(None).cast("string").alias("text"))
    return states.states(events).select("id", "status", "seq")


@query("""
    SELECT lower(target_language) AS target, model, count(*) AS n_requests, sum(len(item_ids))::BIGINT AS n_items, sum(coalesce(prompt_tokens, 0))::BIGINT AS prompt_tokens, sum(coalesce(completion_tokens, 0))::BIGINT AS completion_tokens
    FROM requests GROUP BY 1, 2""")
def q39_usage(spark, d):
    rows = table(spark, d, "requests", "target_language", "model", "item_ids", "prompt_tokens", "completion_tokens")
    add = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return rows.groupBy(F.lower("target_language").alias("target"), "model").agg(F.count("*").alias("n_requests"), F.sum(F.size("item_ids").cast("long")).alias("n_items"), add("prompt_tokens"), add("completion_tokens"))


@query("""
    SELECT request_id, item_id, 'asked' AS side FROM (SELECT request_id, unnest(item_ids) AS item_id FROM requests EXCEPT SELECT request_id, item_id FROM translated_items)
    UNION ALL SELECT request_id, item_id, 'answered' FROM (SELECT request_id, item_id FROM translated_items EXCEPT SELECT request_id, unnest(item_ids) FROM requests)""")
def q40_set_difference(spark, d):
    asked = table(spark, d, "requests", "request_id", "item_ids").select("request_id", F.explode("item_ids").alias("item_id"))
    answered = table(spark, d, "translated_items", "request_id", "item_id")
    return asked.subtract(answered).withColumn("side", F.lit("asked")).unionByName(answered.subtract(asked).withColumn("side", F.lit("answered")))


@query("""
    SELECT profile_id, CASE WHEN max_chars_per_request >= 200 THEN max_chars_per_request ELSE 3000 END AS max_chars, CASE WHEN max_sentences_per_request >= 1 THEN max_sentences_per_request ELSE 40 END AS max_sentences FROM translator_options""")
def q41_sound_limits(spark, d):
    rows = table(spark, d, "translator_options", "profile_id", "max_chars_per_request", "max_sentences_per_request")
    return rows.select("profile_id", settings.sound_limit(F.col("max_chars_per_request"), 3000).cast("int").alias("max_chars"), settings.sound_limit(F.col("max_sentences_per_request"), 40, 1).cast("int").alias("max_sentences"))


@query("""
    SELECT u.base_url, p.id AS provider, coalesce(regexp_extract(u.base_url, '^https?://([^/:]+)', 1) NOT IN ('localhost', '127.0.0.1', ''), true) OR regexp_extract(u.base_url, '^https?://([^/:]+)', 1) = '' AS needs_key
    FROM (SELECT DISTINCT CASE item_id % 4 WHEN 0 THEN 'https://API.openai.com/v1/' WHEN 1 THEN 'http://localhost:11434/v1' WHEN 2 THEN 'https://example.org/x' ELSE 'no address' END AS base_url FROM work_items) u
    LEFT JOIN (SELECT 'openai' AS id, 'https://api.openai.com/v1' AS url UNION ALL SELECT 'ollama', 'http://localhost:11434/v1') p ON p.url = regexp_replace(lower(u.base_url), '/+$', '')""")
def q42_providers(spark, d):
    n = F.col("item_id") % 4
    url = F.when(n == 0, "https://API.openai.com/v1/").when(n == 1, "http://localhost:11434/v1").when(n == 2, "https://example.org/x").otherwise("no address")
    urls = table(spark, d, "work_items", "item_id").select(url.alias("base_url")).distinct()
    return settings.provider_of(urls).select("base_url", "provider", settings.needs_api_key(F.col("base_url")).alias("needs_key"))


@query("""SELECT l.code, l.english_name, count(w.item_id) AS n_items FROM (
        SELECT unnest(['zh-CN', 'zh-TW', 'en', 'ja', 'ko', 'fr', 'de', 'es', 'pt', 'ru', 'it']) AS code, unnest(['Simplified Chinese', 'Traditional Chinese', 'English', 'Japanese', 'Korean', 'French', 'German', 'Spanish', 'Portuguese', 'Russian', 'Italian']) AS english_name) l
    LEFT JOIN (SELECT DISTINCT item_id, source_language FROM work_items) w ON w.source_language = l.code GROUP BY 1, 2""")
def q43_languages(spark, d):
    rows = table(spark, d, "work_items", "item_id", "source_language").distinct()
    counts = rows.groupBy(F.col("source_language").alias("code")).count()
    return language.languages(spark).join(counts, "code", "left").select("code", "english_name", F.coalesce("count", F.lit(0)).alias("n_items"))


@query("""
    SELECT request_id, CASE request_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN len(item_ids) > 0 AND paper_id IS NOT NULL WHEN 3 THEN false ELSE len(item_ids) > 0 AND paper_id IS NOT NULL END AS valid, request_id % 5 = 3 AND model IS NOT NULL AS link FROM requests""")
def q44_valid_messages(spark, d):
    """Messages made of requests: progress with all fields and without one, work with a good and a wrong job, links."""
    rows = table(spark, d, "requests", "request_id", "paper_id", "item_ids", "model")
    sentences = F.transform("item_ids", lambda i: F.struct(i.cast("string").alias("id"), F.lit("t").alias("text"), F.col("paper_id").alias("group")))
    n = F.col("request_id") % 5
    work = [F.lit("translate").alias("type"), F.col("request_id").alias("requestId"), sentences.alias("sentences")]
    message = (
        F.when(n == 0, F.to_json(F.struct(F.lit("translateAllProgress").alias("type"), F.lit(1).alias("jobId"), F.lit(2).alias("done"), F.lit(3).alias("total"))))
        .when(n == 1, F.to_json(F.struct(*work, F.lit("x").alias("jobId"))))
        .when(n == 2, F.to_json(F.struct(*work)))
        .when(n == 3, F.to_json(F.struct(F.col("model").alias("open"))))
        .otherwise(F.to_json(F.struct(*work, F.col("request_id").alias("jobId"))))
    )
    return rows.select("request_id", page_source.is_valid_message(message).alias("valid"), page_source.is_link_message(message).alias("link"))


@query(f"""
    WITH p AS (SELECT *, {_GAP_Y} * 4 + {_GAP_X} AS score, least(1.0, greatest(0.0, coalesce((y + h - py) / nullif(h, 0), 0)))::DOUBLE AS within FROM {_POINTS} JOIN {_RECTS} USING (doc, page)),
    b AS (SELECT probe_id, arg_min(id, (score, ord)) AS id, arg_min(line, (score, ord)) AS line, arg_min(within, (score, ord)) AS within FROM p GROUP BY probe_id)
    SELECT probe_id, b.id, (line + within) / n_lines AS fraction FROM b JOIN (SELECT id, count(*) AS n_lines FROM {_RECTS} GROUP BY id) USING (id)""")
def q45_reading_fraction(spark, d):
    rects = _rects(spark, d)
    return probe.reading_fraction(probe.line_at(_points(spark, d), rects), rects.groupBy("id").agg(F.count("*").alias("n_lines")))


@query("""
    SELECT user_id::VARCHAR AS doc, event_id AS seq, dirty FROM (
        SELECT *, coalesce(lag(dirty) OVER (PARTITION BY user_id ORDER BY event_id), false) AS before FROM (SELECT user_id, event_id, event_type <> 'purchase' AS dirty FROM events WHERE event_type IN ('view', 'purchase', 'click')))
    WHERE dirty <> before""")
def q46_dirty_changes(spark, d):
    kind = F.col("event_type")
    kind = F.when(kind == "view", "edit").when(kind == "purchase", "save").when(kind == "click", "backup")
    rows = table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("string").alias("doc"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return states.dirty_changes(rows)


@query("""
    SELECT paper_id AS job, request_id AS seq, percent, percent - coalesce(lag(percent) OVER (PARTITION BY paper_id ORDER BY request_id), 0) AS increment FROM (
        SELECT r.paper_id, r.request_id, row_number() OVER (PARTITION BY r.paper_id ORDER BY r.request_id) * 100.0::DOUBLE / count(*) OVER (PARTITION BY r.paper_id) AS percent FROM requests r WHERE paper_id IS NOT NULL)""")
def q47_progress(spark, d):
    rows = table(spark, d, "requests", "paper_id", "request_id").where("paper_id is not null")
    done = F.row_number().over(Window.partitionBy("paper_id").orderBy("request_id"))
    rows = rows.select(F.col("paper_id").alias("job"), F.col("request_id").alias("seq"), done.alias("done"), F.count("*").over(Window.partitionBy("paper_id")).alias("total"))
    return states.progress(rows)


@query("""
    SELECT code, row_number() OVER (ORDER BY n DESC NULLS LAST, ord) AS place FROM (
        SELECT unnest(['zh-CN', 'zh-TW', 'en', 'ja', 'ko', 'fr', 'de', 'es', 'pt', 'ru', 'it']) AS code, unnest(range(11)) AS ord)
    LEFT JOIN (SELECT target_language AS code, count(*) AS n FROM requests GROUP BY 1) USING (code)""")
def q48_suggested_first(spark, d):
    """Languages as they would be offered: those asked for most first."""
    asked = table(spark, d, "requests", "target_language").groupBy(F.col("target_language").alias("code")).count()
    ordered = settings.suggested_first(language.languages(spark), asked.select("code", (-F.col("count")).alias("rank")))
    return ordered.select("code", F.col("place").cast("long").alias("place"))


@query("SELECT item_id, item_id % 3 = 0 AS inside FROM (SELECT DISTINCT item_id FROM work_items)")
def q49_links_inside(spark, d):
    n = F.col("item_id") % 3
    url = F.when(n == 0, F.concat(F.lit("https://host.example/docs/a/"), "item_id")).when(n == 1, F.concat(F.lit("https://host.example/other/"), "item_id")).otherwise(F.concat(F.lit("https://host.example.org/docs/a/"), "item_id"))
    return table(spark, d, "work_items", "item_id").distinct().select("item_id", page_source.is_inside(url, F.lit("https://host.example/docs/index.html")).alias("inside"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 50)")
def q50_sample(spark, d):
    """A sample of fifty documents, by hash: the limit is the operator."""
    return probe.sample(table(spark, d, "documents", "doc_id", "source"), "doc_id", 50)


# ---- page events, blocks of sentences, reading positions, sets of strings, late replies

_STATES = "(SELECT item_id AS id, CASE WHEN max(coalesce(" + O.trim_blanks("translation") + ", '')) <> '' THEN 'done' ELSE 'error' END AS status FROM translated_items GROUP BY item_id)"


@query(f"""
    WITH s AS (SELECT DISTINCT paper_id AS doc, page, item_id AS id FROM work_items), e AS (
        SELECT doc, page AS seq, page, n_pages, page % 4 = 0 AS explicit, CASE page % 4 WHEN 1 THEN 'page' WHEN 2 THEN 'nearby' ELSE 'manual' END AS rng
        FROM (SELECT DISTINCT paper_id AS doc, page, max(page) OVER (PARTITION BY paper_id) AS n_pages FROM blocks WHERE paper_id IS NOT NULL)),
    w AS (SELECT doc, seq, explicit, n_pages, unnest(CASE WHEN explicit OR rng = 'page' THEN [page] WHEN rng = 'nearby' THEN [page - 1, page, page + 1] ELSE [] END) AS page FROM e)
    SELECT DISTINCT w.doc, w.seq, s.id FROM w JOIN s ON s.doc = w.doc AND s.page = w.page LEFT JOIN {_STATES} t ON t.id = s.id
    WHERE w.page BETWEEN 1 AND w.n_pages AND (t.status IS NULL OR (w.explicit AND t.status = 'error'))""")
def q52_wanted_by_page_events(spark, d):
    """What turning to each page, or asking for it, would send to the model."""
    own = table(spark, d, "blocks", "paper_id", "page").where("paper_id is not null").distinct()
    last = own.groupBy("paper_id").agg(F.max("page").alias("n_pages"))
    n = F.col("page") % 4
    rng = F.when(n == 1, "page").when(n == 2, "nearby").otherwise("manual")
    events = own.join(last, "paper_id").select(F.col("paper_id").alias("doc"), F.col("page").alias("seq"), "page", rng.alias("rng"), (n == 0).alias("explicit"), "n_pages")
    sentences = items(spark, d, "paper_id", "page").distinct().select(F.col("paper_id").alias("doc"), "page", F.col("item_id").alias("id"))
    replies = table(spark, d, "translated_items", "item_id", "translation").groupBy("item_id").agg(F.max(F.coalesce(T.trim_blanks(F.col("translation")), F.lit(""))).alias("t"))
    status = F.when(F.col("t") != "", "done").otherwise("error")
    states_ = sentences.select("doc", "id").join(replies, F.col("id") == F.col("item_id")).select("doc", "id", status.alias("status"))
    return jobs.wanted(events, sentences, states_)


@query("""
    SELECT DISTINCT w.item_id AS id FROM work_items w JOIN (SELECT DISTINCT w.paper_id, w.page, w.grp FROM work_items w JOIN translated_items t ON t.item_id = w.item_id WHERE t.cache_key = '') p
        ON p.paper_id = w.paper_id AND p.page = w.page AND p.grp = w.grp""")
def q53_block_of_sentence(spark, d):
    """All sentences of the paragraphs that hold one that passed through."""
    rows = items(spark, d, "paper_id", "page", "grp").distinct().where("grp is not null and page is not null")
    sentences = rows.select(F.col("paper_id").alias("doc"), F.concat_ws("/", F.col("page").cast("string"), "grp").alias("block_id"), F.col("item_id").alias("id"))
    passed = table(spark, d, "translated_items", "item_id", "cache_key").where("cache_key = ''").select("item_id").distinct()
    picked = sentences.join(passed, F.col("id") == F.col("item_id"), "left_semi").select("doc", "id")
    return probe.block_of(picked, sentences).select("id").distinct()


@query("SELECT DISTINCT b.block_no, greatest(1, least(b.page + b.block_no % 3, n.n_pages))::INTEGER AS page FROM blocks b JOIN (SELECT paper_id, max(page) AS n_pages FROM page_texts GROUP BY paper_id) n ON n.paper_id = b.paper_id")
def q54_kept_page(spark, d):
    """The page to stay on, some of them beyond the end of the document as it is now."""
    n = table(spark, d, "page_texts", "paper_id", "page").groupBy("paper_id").agg(F.max("page").alias("n_pages"))
    rows = blocks(spark, d, "paper_id", "page").distinct().join(n, "paper_id")
    return rows.select("block_no", probe.kept_page(F.col("page") + F.col("block_no") % 3, F.col("n_pages")).cast("int").alias("page"))


@query("SELECT block_kind AS s FROM blocks UNION SELECT block_role FROM blocks UNION SELECT source FROM documents UNION SELECT suite FROM eval_items")
def q55_set_of_strings(spark, d):
    """Strings of several tables as one set; each table is reduced before they meet."""
    parts = [table(spark, d, name, column).distinct().toDF("s") for name, column in (("blocks", "block_kind"), ("blocks", "block_role"), ("documents", "source"), ("eval_items", "suite"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()


@query(f"""
    WITH v AS (SELECT doc, page, (page - 1) * 850.0::DOUBLE + 100 + 0.3 * 600 AS py FROM (SELECT DISTINCT doc, page FROM {_RECTS})),
    s AS (SELECT v.doc, v.page, r.id, r.line, r.ord, r.h, r.y, (v.page - 1) * 850.0 + 842 - v.py AS up FROM v JOIN {_RECTS} r ON r.doc = v.doc AND r.page = v.page),
    b AS (SELECT doc, page, arg_min(struct_pack(id := id, line := line, inside := least(1.0, greatest(0.0, coalesce((y + h - up) / nullif(h, 0), 0)))::DOUBLE), (4 * greatest(y - up, 0, up - (y + h)), ord)) AS m FROM s GROUP BY ALL)
    SELECT doc || '/' || b.page AS view_id, b.page, m.id AS id, (m.line + m.inside) / n.n_lines AS fraction FROM b JOIN (SELECT id, count(*) AS n_lines FROM {_RECTS} GROUP BY id) n ON n.id = b.m.id""")
def q56_reading_position(spark, d):
    """Where one reads, for a view that begins 100 below the top of each page."""
    rects = _rects(spark, d)
    own = rects.select("doc", "page").distinct()
    top = (F.col("page") - 1) * F.lit(850.0)
    places = own.select("doc", "page", top.alias("top"), (top + 842).alias("bottom"))
    views = own.select(F.concat_ws("/", "doc", "page").alias("view_id"), "doc", (top + 100).alias("top"), F.lit(600.0).alias("height"))
    return probe.reading_position(views, places, rects, rects.groupBy("id").agg(F.count("*").alias("n_lines")))


@query("""
    WITH asked AS (SELECT item_id AS id, max(request_id) AS open_ FROM (SELECT request_id, unnest(item_ids) AS item_id FROM requests) GROUP BY 1),
    came AS (SELECT item_id AS id, request_id FROM (SELECT DISTINCT request_id, item_id FROM translated_items))
    SELECT a.id::VARCHAR AS id, CASE WHEN bool_or(c.request_id = a.open_) THEN 'done' ELSE 'pending' END AS status FROM asked a LEFT JOIN came c ON c.id = a.id GROUP BY a.id""")
def q57_late_replies(spark, d):
    """States where all requests went out before any reply, the last of each item first: only its reply counts."""
    asked = table(spark, d, "requests", "request_id", "item_ids").select("request_id", F.explode("item_ids").alias("id")).where("id is not null").distinct()
    came = table(spark, d, "translated_items", "request_id", "item_id").withColumnRenamed("item_id", "id").distinct()
    late = F.lit(1 << 40)
    events = asked.select("id", "request_id", (late - F.col("request_id")).alias("seq"), F.lit("ask").alias("kind")).unionByName(came.join(asked.select("id").distinct(), "id").select("id", "request_id", (late + F.col("request_id")).alias("seq"), F.lit("reply").alias("kind")))
    events = events.select(F.lit("d").alias("doc"), F.col("id").cast("string").alias("id"), "seq", "kind", "request_id", F.lit(None).cast("string").alias("text"))
    return states.states(events).select("id", "status")
