"""User scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_with(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int = 256) -> DataFrame:
    """df through the user's scorer, batch_rows rows at a time: fn gets and gives a pandas frame. Retries are the scorer's."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch_rows):
                yield fn(b.iloc[at : at + batch_rows])

    return df.mapInPandas(run, schema)
