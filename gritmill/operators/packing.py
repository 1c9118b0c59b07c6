"""Sequential packing of ordered items into shards: a running sum that starts again when the next item would not fit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def next_fit(df: DataFrame, group: str, order: str, size: str, max_size: int, max_items: int) -> DataFrame:
    """Adds ``shard`` (from 0) within each group; an item above the limit stands alone.

    The state depends on every item before it, so the items of a group come sorted to
    one task; there they stream through, and no group is held in memory.
    """

    narrow = df.select(group, order, size)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard, used, n = object(), 0, 0, 0
        for pdf in batches:
            out = []
            for g, s in zip(pdf[group], pdf[size], strict=True):
                if g != at:
                    at, shard, used, n = g, 0, 0, 0
                if n and (used + s > max_size or n >= max_items):
                    shard, used, n = shard + 1, 0, 0
                used, n = used + s, n + 1
                out.append(shard)
            yield pdf.assign(shard=out)

    return narrow.repartition(group).sortWithinPartitions(group, order).mapInPandas(pack, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", shard bigint")
