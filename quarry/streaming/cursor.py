"""In-order sampling as a stream: the place reached in each dataset is kept in the state store, so a restart goes on there."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(requests: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(dataset, request, place, position, epoch) for each row asked for by a stream of requests (dataset, request, count).

    Requests of a dataset are served in order of their number: each gets the next ``count`` positions, from 0, around and
    around; ``epoch`` counts the rounds. Where a dataset stands, and its size, is state: after a restart from the stream's
    checkpoint the next request goes on at the next row. A dataset that isn't in ``sizes``, or whose size differs from that
    when its state was made, raises, as positions would then mean other rows. Counts that are null or not above 0 give
    none."""
    known = dict(sizes)

    def serve(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        name = key[0]
        if name not in known:
            raise ValueError(f"dataset {name} is not among those sampled in order: {sorted(known)}")
        size = known[name]
        at, held = state.get if state.exists else (0, size)
        if held != size:
            raise ValueError(f"dataset {name} has {size} rows, but {held} when its place was kept")
        asked = pd.concat(list(batches))
        for request, count in asked.sort_values("request")[["request", "count"]].itertuples(index=False):
            n = 0 if pd.isna(count) else max(0, int(count))
            for lo in range(0, n, 10_000):
                places = range(lo, min(n, lo + 10_000))
                yield pd.DataFrame({"dataset": name, "request": request, "place": list(places), "position": [(at + i) % size for i in places], "epoch": [(at + i) // size for i in places]})
            at += n
        state.update((at, size))

    rows = requests.select("dataset", F.col("request").cast("long").alias("request"), F.col("count").cast("long").alias("count")).where("dataset IS NOT NULL AND request IS NOT NULL")
    return rows.groupBy("dataset").applyInPandasWithState(serve, "dataset string, request long, place long, position long, epoch long", "at long, size long", "append", "NoTimeout")
