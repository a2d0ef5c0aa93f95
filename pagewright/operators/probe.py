"""Point queries on pages: what is at a place, which line is read, what is in view, which page is at a height.

Probes and rectangles meet by document and page first, so that only those of one page are compared. Two ties are fixed:
of sentences equally near the last in reading order is hit, of lines equally near the first is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far from a rectangle a hit may be, and the weight of the vertical distance for lines.
SLOP, LINE_WEIGHT = 3.0, 4.0


def _gap(low: Column, size: Column, at: Column) -> Column:
    """Distance of a coordinate from an interval; 0 inside."""
    return F.greatest(low - at, F.lit(0.0), at - (low + size))


def hit_test(probes: DataFrame, rects: DataFrame, slop: float = SLOP) -> DataFrame:
    """(probe_id, id): the nearest of rects(doc, page, id, ord, x, y, w, h) within slop of each of probes(probe_id, doc,
    page, px, py); probes with nothing near have no row."""
    near = (F.col("px") >= F.col("x") - slop) & (F.col("px") <= F.col("x") + F.col("w") + slop) & (F.col("py") >= F.col("y") - slop) & (F.col("py") <= F.col("y") + F.col("h") + slop)
    dx, dy = _gap(F.col("x"), F.col("w"), F.col("px")), _gap(F.col("y"), F.col("h"), F.col("py"))
    rows = probes.join(rects, ["doc", "page"]).where(near).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= slop)
    return rows.groupBy("probe_id").agg(F.min_by("id", F.struct(F.col("distance"), -F.col("ord"))).alias("id"))


def line_at(probes: DataFrame, lines: DataFrame, use_x: bool = True) -> DataFrame:
    """(probe_id, id, line, within): the line read at each probe, of lines(doc, page, id, ord, line, x, y, w, h), and how far
    down in it the probe is, 0 to 1."""
    dy = _gap(F.col("y"), F.col("h"), F.col("py"))
    dx = _gap(F.col("x"), F.col("w"), F.col("px")) if use_x else F.lit(0.0)
    within = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce((F.col("y") + F.col("h") - F.col("py")) / F.nullif(F.col("h"), F.lit(0.0)), F.lit(0.0))))
    rows = probes.join(lines, ["doc", "page"]).withColumn("score", LINE_WEIGHT * dy + dx)
    best = rows.groupBy("probe_id").agg(F.min(F.struct("score", "ord", "id", "line", within.alias("within"))).alias("b"))
    return best.select("probe_id", "b.id", "b.line", "b.within")


def first_in_view(views: DataFrame, rects: DataFrame) -> DataFrame:
    """(view_id, id): the first of rects(doc, page, id, ord, x, y, w, h) that overlaps each of views(view_id, doc, page, x0,
    y0, x1, y1)."""
    overlap = (F.col("x") < F.col("x1")) & (F.col("x") + F.col("w") > F.col("x0")) & (F.col("y") < F.col("y1")) & (F.col("y") + F.col("h") > F.col("y0"))
    return views.join(rects, ["doc", "page"]).where(overlap).groupBy("view_id").agg(F.min_by("id", "ord").alias("id"))


def page_at(points: DataFrame, pages: DataFrame, bucket: float = 4096.0) -> DataFrame:
    """(point_id, page): the page of pages(doc, page, top, bottom) that holds the height py of each of points(point_id, doc,
    py). A range join: pages are listed in the buckets of height they reach into, points look into their own."""
    listed = pages.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("top") / bucket), F.floor(F.col("bottom") / bucket))))
    own = points.withColumn("bucket", F.floor(F.col("py") / bucket))
    rows = own.join(listed, ["doc", "bucket"]).where((F.col("py") >= F.col("top")) & (F.col("py") < F.col("bottom")))
    return rows.groupBy("point_id").agg(F.min("page").alias("page"))


def pages_in_range(rows: DataFrame, last_page: str = "n_pages") -> DataFrame:
    """rows(page, rng, n_pages, ...) with each page that a range asks for: the page, with its neighbours, or none."""
    page = F.col("page")
    wanted = F.when(F.col("rng") == "page", F.array(page)).when(F.col("rng") == "nearby", F.array(page, page + 1, page - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("wanted", F.explode(wanted)).where(F.col("wanted").between(F.lit(1), F.col(last_page)))


def reading_fraction(read: DataFrame, blocks: DataFrame) -> DataFrame:
    """(probe_id, id, fraction): how far down in its block the line of line_at is, of blocks(id, n_lines)."""
    rows = read.join(blocks.select("id", "n_lines"), "id")
    return rows.select("probe_id", "id", ((F.col("line") + F.col("within")) / F.nullif(F.col("n_lines"), F.lit(0))).alias("fraction"))


def sentence_top(rects: Column) -> Column:
    """The upper edge of a sentence: the greatest of its rectangles."""
    return F.array_max(F.transform(rects, lambda r: r["y"] + r["h"]))


def sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same for the same rows wherever they stand: those whose key comes first by hash."""
    return rows.orderBy(F.sha1(F.col(key).cast("string")), key).limit(n)


def block_of(picked: DataFrame, sentences: DataFrame) -> DataFrame:
    """The sentences(doc, block_id, id, ...) of the blocks that picked(doc, id) stand in, each once."""
    blocks = sentences.select("doc", "block_id", "id").join(picked.select("doc", "id").distinct(), ["doc", "id"]).select("doc", "block_id").distinct()
    return sentences.join(blocks, ["doc", "block_id"], "left_semi")


def kept_page(page: Column, n_pages: Column) -> Column:
    """The page to stay on after a document was read anew: the same one, or the last; 1 where there is none."""
    return F.greatest(F.lit(1), F.least(F.coalesce(page, F.lit(1)), n_pages))


# Fixed value: the part of the height of a view at which the reading position is taken.
ANCHOR = 0.3


def reading_position(views: DataFrame, places: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(view_id, page, id, fraction): for views(view_id, doc, top, height) the page at the anchor, the block of the line
    nearest to it there, and how far down in the block that is. places(doc, page, top, bottom) are pages in the height of
    the document, measured downwards; lines(doc, page, id, ord, line, x, y, w, h) are measured upwards in their page."""
    at = F.col("top") + ANCHOR * F.col("height")
    points = views.select(F.col("view_id").alias("point_id"), "doc", at.alias("py"))
    pages = page_at(points, places)
    held = points.join(pages, "point_id").join(places.select("doc", "page", "bottom"), ["doc", "page"])
    probes = held.select(F.col("point_id").alias("probe_id"), "doc", "page", F.lit(0.0).alias("px"), (F.col("bottom") - F.col("py")).alias("py"))
    found = reading_fraction(line_at(probes, lines, use_x=False), blocks)
    return found.join(pages, found["probe_id"] == pages["point_id"]).select(F.col("probe_id").alias("view_id"), "page", "id", "fraction")
