"""What SQL texts can call: segmentation as a table function, and expressions as functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Registers clause_pieces(text, version), a table function of the pieces that segmentation of version 2 or 3 cuts a text into (piece, start, end, text)."""
    from clausegrain.operators.segment import fold_forward

    @udtf(returnType="piece int, start int, end int, text string", useArrow=True)
    class ClausePieces:
        def eval(self, text: str, version: int) -> Iterator[tuple]:
            for k, start, end in fold_forward(text or "", version):
                yield k, start, end, text[start:end].strip()

    spark.udtf.register("clause_pieces", ClausePieces)
