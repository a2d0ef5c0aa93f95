"""Reading of model replies: tolerant of fences, of bare arrays and of an older field name, strict about ids."""

from __future__ import annotations

import json

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ends, patterns as P, text as T


def unfenced(content: Column) -> Column:
    """A reply without the Markdown fence around it."""
    text = T.trim_blanks(content)
    return F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def read(content: str, expected: list[str]) -> dict[str, str]:
    """What parse() does, for one reply inside a kernel: translations by id."""
    blank = ends.python(P.BLANK)
    text = regex.sub(r"(?i)^```(?:json)?\s*|\s*```$", "", regex.sub(f"^[{blank}]+|[{blank}]+$", "", content))
    try:
        rows = json.loads(text)
    except ValueError:
        return {}
    rows = rows.get("translations") if isinstance(rows, dict) else rows
    out = {}
    for row in rows if isinstance(rows, list) else []:
        if isinstance(row, dict) and isinstance(row.get("id"), str) and row["id"] in expected:
            given = next((v for v in (row.get("translation"), row.get("zh")) if isinstance(v, str)), "")
            if given := regex.sub(f"^[{blank}]+|[{blank}]+$", "", given):
                out[row["id"]] = given
    return out


def entries(content: Column) -> Column:
    """The entries of a reply, as an array of variants: of a bare array, or of its field translations. None for anything else."""
    parsed = F.try_parse_json(unfenced(content))
    whole = F.try_variant_get(parsed, "$", "array<variant>")
    inner = F.try_variant_get(parsed, "$.translations", "array<variant>")
    return F.coalesce(whole, inner)


def _string(entry: Column, name: str) -> Column:
    """A field that is a string; numbers are not taken for strings."""
    value = F.try_variant_get(entry, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(entry, f"$.{name}", "string"))


def parse(replies: DataFrame) -> DataFrame:
    """(reply_id, id, translation) from replies(reply_id, content, expected array<string>).

    Entries with an unknown id, an id that is no string, or a blank text are left out; of entries with one id the last
    counts. The older field is read only where the newer is no string.
    """
    rows = replies.select("reply_id", "expected", F.posexplode(entries(F.col("content"))).alias("pos", "entry"))
    newer, older = _string(F.col("entry"), "translation"), _string(F.col("entry"), "zh")
    rows = rows.select("reply_id", "expected", "pos", _string(F.col("entry"), "id").alias("id"), T.trim_blanks(F.coalesce(newer, older)).alias("translation"))
    rows = rows.where("id is not null and translation <> ''").where(F.array_contains("expected", F.col("id")))
    return rows.groupBy("reply_id", "id").agg(F.max_by("translation", "pos").alias("translation"))


def missing(replies: DataFrame) -> DataFrame:
    """(reply_id, id, ord): expected ids that a reply has no translation for."""
    expected = replies.select("reply_id", F.posexplode("expected").alias("ord", "id"))
    return expected.join(parse(replies).select("reply_id", "id"), ["reply_id", "id"], "left_anti")
