"""Dropping rows by id without moving the rows that stay where that can be proven cheap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm._common import materialize

#: Up to so many ids (8 bytes each) are broadcast; more meet the rows in a shuffled join.
BROADCAST_IDS = 250_000


def without_ids(df: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``dropped``; rows with a null id stay."""
    ids = materialize(dropped.select(F.col(id_col).alias("_drop")).where("_drop is not null").distinct(), "dropped-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(side, df[id_col] == ids["_drop"], "left_anti")
