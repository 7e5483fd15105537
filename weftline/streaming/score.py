"""Linking records as they arrive, against a fixed reference source.  An extension: batch linkage is in plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import canon
from ..plans.config import LinkageConfig
from ..plans.linkage import candidates


def link_stream(arriving: DataFrame, s1: DataFrame, sink: Callable[[DataFrame, int], None], config: LinkageConfig | None = None):
    """A stream writer (start() it) that hands sink each batch's candidate pairs with their scores.

    arriving is a streaming DataFrame of raw records.  The batch number makes writes by sink repeatable after a failure.
    """
    config = config or LinkageConfig()
    index = canon.canonical(canon.basic(s1))

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(candidates(index, canon.canonical(canon.basic(batch)), config), number)

    return arriving.writeStream.foreachBatch(each)
