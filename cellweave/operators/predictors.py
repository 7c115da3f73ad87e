"""The seam for models: a predictor maps prompts to texts inside the tasks, with bounded concurrency and retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def predict(df: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", workers: int = 4, tries: int = 3, pause: float = 0.4) -> DataFrame:
    """df with raw_prediction and error. `make` builds the predictor once per task; a failing prompt is tried again
    after growing pauses, then its error is kept and the rest goes on."""
    schema = T.StructType([*df.schema.fields, T.StructField("raw_prediction", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make()

        def one(p: str | None) -> tuple[str | None, str | None]:
            for n in range(tries):
                try:
                    return predictor(p or ""), None
                except Exception as e:  # noqa: BLE001 - any failure of a plugged-in model is a row's error
                    if n + 1 == tries:
                        return None, repr(e)
                    time.sleep(pause * 2**n)
            return None, "no try"

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                got = list(pool.map(one, batch[prompt]))
                yield batch.assign(raw_prediction=[g[0] for g in got], error=[g[1] for g in got])

    return df.mapInPandas(run, schema)
