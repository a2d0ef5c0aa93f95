"""Table functions for SQL: sentences_of(text). Pages are segmented by views, see layout.register_views."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session; use them with LATERAL."""

    @udtf(returnType="idx int, start_pos int, end_pos int, sentence string")
    class SentencesOf:
        def eval(self, text: str):
            from pagewright.functions.ends import sentence_ends

            begin, idx = 0, 0
            for end in sentence_ends(text) if text else ():
                piece = text[begin:end]
                if piece.strip():
                    lead = len(piece) - len(piece.lstrip())
                    idx += 1
                    yield idx, begin + lead, begin + len(piece.rstrip()), piece.strip()
                begin = end

    spark.udtf.register("sentences_of", SentencesOf)
