"""Pages laid out once: segmented pages in a table, filled as pages are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, probe


class PageStore:
    """Sentences of pages at a path of shared storage, by generation, document and page.

    A page is laid out when it is first asked for and read from then on. What fails leaves nothing behind, since a write
    that does not end is not committed; so it is tried again next time. reset() begins a generation: the older ones are
    not read any more. Pages without sentences are laid out again each time.
    """

    def __init__(self, spark: SparkSession, path: str, segment: layout.Segmenter = layout.sentences, generation: int = 0):
        self.spark, self.path, self.segment, self.generation = spark, path, segment, generation

    def _folder(self) -> str:
        return f"{self.path}/generation={self.generation}"

    def _exists(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(), "_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def cached(self) -> DataFrame:
        """Sentences of the pages that are ready."""
        if self._exists():
            return self.spark.read.parquet(self._folder())
        schema = ", ".join(part for part in layout.SENTENCE.split(", "))
        return self.spark.createDataFrame([], schema)

    def ready(self) -> DataFrame:
        """(paper_id, page) of the pages that are ready, in order."""
        return self.cached().select("paper_id", "page").distinct().orderBy("paper_id", "page")

    def ensure(self, pages: DataFrame) -> DataFrame:
        """Sentences of pages; those that are not ready are laid out and kept first."""
        new = pages.join(self.ready(), ["paper_id", "page"], "left_anti")
        self.segment(new).write.mode("append").parquet(self._folder())
        return self.cached().join(pages.select("paper_id", "page").distinct(), ["paper_id", "page"], "left_semi")

    def get(self, ids: DataFrame) -> DataFrame:
        """Sentences by ids(paper_id, sent_id); what is not ready has no row."""
        return self.cached().join(ids.select("paper_id", "sent_id").distinct(), ["paper_id", "sent_id"])

    def hits(self, probes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
        """(probe_id, id): what is at probes(probe_id, doc, page, px, py). With pages, those that are probed are made ready
        first; without, only ready pages have hits."""
        if pages is not None:
            asked = probes.select(F.col("doc").alias("paper_id"), "page").distinct()
            rows = self.ensure(pages.join(asked, ["paper_id", "page"], "left_semi"))
        else:
            rows = self.cached()
        rects = rows.select(F.col("paper_id").alias("doc"), "page", F.col("sent_id").alias("id"), (F.col("block_idx") * 100_000 + F.col("sent_idx")).alias("ord"), F.explode("rects").alias("r"))
        return probe.hit_test(probes, rects.select("doc", "page", "id", "ord", "r.*"))

    def reset(self) -> None:
        self.generation += 1
