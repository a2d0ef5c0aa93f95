"""Content-addressed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import text as T


def cache_key(text: Column, model: Column, target: Column, glossary_hash: Column, version: str = P.PROMPT_VERSION) -> Column:
    """Key of a translation: the hash of the normalised text and of all that the result depends on."""
    return key_of_normalized(T.normalize_source(text), model, target, glossary_hash, version)


def key_of_normalized(text: Column, model: Column, target: Column, glossary_hash: Column, version: str = P.PROMPT_VERSION) -> Column:
    return F.sha1(F.concat_ws("\u0000", text, model, target, F.lit(version), glossary_hash))


def glossary_hash(glossary: Column) -> Column:
    """The first 12 digits of the hash of a map of terms; the order of its entries does not matter.

    What is hashed is a JSON array of pairs of term and rendering, in the order of a dictionary: by the terms' letters
    without case and accents, then by accents, then lower case first.
    """
    collated = lambda name: F.collate(name, "UNICODE")
    ordered = F.array_sort(F.map_entries(glossary), lambda a, b: F.when(collated(a["key"]) < collated(b["key"]), -1).when(collated(a["key"]) > collated(b["key"]), 1).otherwise(0))
    return F.left(F.sha1(F.to_json(F.transform(ordered, lambda e: F.array(e["key"], e["value"])))), F.lit(12))


def glossary_of(terms: dict[str, str]) -> Column:
    """A glossary as a map column."""
    return F.create_map(*[F.lit(x) for pair in terms.items() for x in pair]).cast("map<string,string>")


def shard(key: Column) -> Column:
    """Shard of a key: its first two digits, 256 in all."""
    return F.left(key, F.lit(2))
