"""Remote sources behind a seam: a client maps a request to a response text, live or recorded, with bounded retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEARCH = T.StructType([T.StructField("search", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("id", "label", "description")])))])
TRIES = 3
PAUSE = 0.4  # seconds before the second try; doubles with each further one


def fetch(requests: DataFrame, make_client: Callable[[], Callable[[str], str]], request: str = "request", tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """requests with response and error. Each distinct request goes out once; a failing one is tried again after growing
    pauses, then its error is kept and the rest goes on."""
    schema = T.StructType([requests.schema[request], T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(r: str) -> tuple[str | None, str | None]:
            for n in range(tries):
                try:
                    return client(r), None
                except Exception as e:  # noqa: BLE001 - any failure of a remote side is a row's error
                    if n + 1 == tries:
                        return None, repr(e)
                    time.sleep(pause * 2**n)
            return None, "no try"

        for batch in batches:
            got = [one(r) for r in batch[request]]
            yield pd.DataFrame({request: batch[request], "response": [g[0] for g in got], "error": [g[1] for g in got]})

    answers = requests.select(request).where(F.col(request).isNotNull()).distinct().mapInPandas(run, schema)
    return requests.join(answers, request, "left")


def search_items(responses: DataFrame, request: str = "request", response: str = "response") -> DataFrame:
    """Items (request, ord, qid, label, description) of search answers; answers that don't decode have none."""
    items = F.from_json(F.col(response), SEARCH)["search"]
    rows = responses.select(request, F.posexplode(items).alias("ord", "__i"))
    return rows.select(request, "ord", F.coalesce(F.col("__i.id"), F.lit("")).alias("qid"), F.col("__i.label").alias("label"), F.col("__i.description").alias("description"))


def chunks(ids: DataFrame, column: str, size: int = 40) -> DataFrame:
    """Distinct ids in lists of at most `size`, for requests that take so many at once."""
    one = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__h", F.pmod(F.xxhash64(column), F.lit(64)))
    nth = F.floor((F.row_number().over(Window.partitionBy("__h").orderBy(column)) - 1) / size)
    return one.withColumn("__c", nth).groupBy("__h", "__c").agg(F.array_sort(F.collect_list(column)).alias("ids")).select("ids")
