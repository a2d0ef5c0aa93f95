"""Sources of pages: JSON files, one page each, as an extractor writes them; and messages between processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One page as JSON. styles is a map: inferred, it would be a struct with a field for every font.
JSON_PAGE = (
    "source string, page int, view array<double>, styles map<string, struct<fontFamily:string>>, "
    "items array<struct<str:string, transform:array<double>, width:double, height:double, fontName:string, hasEOL:boolean>>"
)


def rounded(value: Column, places: int = 3) -> Column:
    """Rounding half up towards the greater, as files are written."""
    scale = 10**places
    return F.floor(value * scale + 0.5) / scale


def read_json_pages(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Pages first to last of JSON files; files that are none are left out, items without a string (marks) too."""
    raw = spark.read.schema(JSON_PAGE).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where(F.col("page") >= max(1, first))
    return _pages(raw if last is None else raw.where(F.col("page") <= last))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages of files with one line a page, as write_json_pages makes them."""
    return _pages(spark.read.schema(JSON_PAGE).option("mode", "DROPMALFORMED").json(path))


def _pages(raw: DataFrame) -> DataFrame:
    items = F.filter("items", lambda i: i["str"].isNotNull())
    runs = F.transform(items, lambda i, k: F.struct(k.cast("long").alias("run_id"), i["str"].alias("str"), i["transform"].alias("matrix"), i["width"].alias("width"), i["height"].alias("height"), i["fontName"].alias("font_name"), i["hasEOL"].alias("has_eol")))
    styles = F.transform_values("styles", lambda _, v: F.struct(v["fontFamily"].alias("font_family")))
    return raw.select(F.col("source").alias("paper_id"), "page", F.col("view").alias("view_box"), styles.alias("styles"), runs.alias("text_items"))


def write_json_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON, with numbers rounded to three places; one line a page."""
    items = F.transform("text_items", lambda i: F.struct(i["str"].alias("str"), F.transform(i["matrix"], lambda v: rounded(v)).alias("transform"), rounded(i["width"]).alias("width"), rounded(i["height"]).alias("height"), i["font_name"].alias("fontName"), i["has_eol"].alias("hasEOL")))
    styles = F.transform_values("styles", lambda _, v: F.struct(v["font_family"].alias("fontFamily")))
    pages.select(F.col("paper_id").alias("source"), "page", F.col("view_box").alias("view"), styles.alias("styles"), items.alias("items")).write.mode("overwrite").json(path)


def changed_files(spark: SparkSession, path: str, own_writes: DataFrame) -> DataFrame:
    """(path, sha1, content) of files whose content is not one that we wrote ourselves: own_writes(sha1)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha1("content").alias("sha1"), "content")
    return files.join(own_writes.select("sha1"), "sha1", "left_anti")


def watched_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha1, content) of files as they appear or change, as a stream; use with not_own() in foreachBatch."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha1("content").alias("sha1"), "content")


def not_own(files: DataFrame, own_writes: DataFrame) -> DataFrame:
    """Files(path, sha1, ...) that we did not write ourselves: own_writes(path, sha1) as own_write() records them."""
    return files.join(own_writes.select("path", "sha1").distinct(), ["path", "sha1"], "left_anti")


def own_write(files: DataFrame) -> DataFrame:
    """(path, sha1) of what is about to be written: files(path, content)."""
    return files.select("path", F.sha1("content").alias("sha1"))


def string_literals(spark: SparkSession, path: str, function: str = "t") -> DataFrame:
    """(path, literal): first arguments of calls of a function in source files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.regexp_extract_all("value", F.lit(rf"\b{function}\(\s*[\"']((?:[^\"'\\\\]|\\\\.)*)[\"']"), F.lit(1))
    return files.select("path", F.explode(found).alias("literal")).distinct()


# Kinds of messages and the fields each must have.
MESSAGE_FIELDS = {
    "dirty": {}, "requestSave": {}, "chooseTargetLanguage": {}, "data": {"requestId": "number"}, "dataError": {"requestId": "number", "message": "string"},
    "translate": {"requestId": "number", "sentences": "array"}, "translateAllProgress": {"jobId": "number", "done": "number", "total": "number"}, "translateAllDone": {"jobId": "number"},
}
# Fields that may be left out, but not hold anything else.
OPTIONAL_FIELDS = {"translate": {"jobId": "number"}}
# Fixed value: the field of a message that asks for a link to be opened.
LINK_FIELD = "open"


def is_valid_message(message: Column) -> Column:
    """Whether a JSON text is a message of a known kind with the fields of that kind; anything else is false."""
    parsed = F.try_parse_json(message)

    def has(name: str, kind: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        pattern = {"number": "^(BIGINT|DOUBLE|DECIMAL.*|FLOAT|INT)$", "string": "^STRING$", "array": "^ARRAY"}[kind]
        return F.coalesce(found.rlike(pattern), F.lit(False))

    def absent(name: str) -> Column:
        return F.try_variant_get(parsed, f"$.{name}", "variant").isNull()

    kind = F.try_variant_get(parsed, "$.type", "string")
    out = F.lit(False)
    for name, fields in MESSAGE_FIELDS.items():
        ok = F.lit(True)
        for key, type_ in fields.items():
            ok = ok & has(key, type_)
        for key, type_ in OPTIONAL_FIELDS.get(name, {}).items():
            ok = ok & (absent(key) | has(key, type_))
        if name == "translate":
            sentences = F.try_variant_get(parsed, "$.sentences", "array<struct<id:string, text:string, group:string>>")
            ok = ok & F.coalesce(F.forall(sentences, lambda s: s["id"].isNotNull() & s["text"].isNotNull() & s["group"].isNotNull()), F.lit(False))
        out = F.when(kind == name, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def is_link_message(message: Column) -> Column:
    """Whether a JSON text asks for a link to be opened: an object with a string in LINK_FIELD."""
    found = F.schema_of_variant(F.try_variant_get(F.try_parse_json(message), f"$.{LINK_FIELD}", "variant"))
    return F.coalesce(found == "STRING", F.lit(False))


def is_inside(url: Column, base: Column) -> Column:
    """Whether an address is of the same origin as a base and below its path; addresses that cannot be read are not."""
    part = lambda u, what: F.try_parse_url(u, F.lit(what))
    same = part(url, "PROTOCOL").eqNullSafe(part(base, "PROTOCOL")) & part(url, "AUTHORITY").eqNullSafe(part(base, "AUTHORITY")) & part(url, "AUTHORITY").isNotNull()
    folder = F.regexp_replace(F.coalesce(part(base, "PATH"), F.lit("/")), "[^/]*$", "")
    return F.coalesce(same & F.startswith(F.coalesce(part(url, "PATH"), F.lit("")), folder), F.lit(False))
