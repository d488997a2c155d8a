"""Responses of a wiki's API as a batch source: the transport is pluggable, so tests need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Tries, the wait after a failure grows by one of these (seconds), the wait when asked to slow down.
TRIES, WAIT, SLOW_DOWN = 3, 1.0, 5.0

#: The poets whose pages are gathered.
AUTHORS = (
    "Məhəmməd Füzuli",
    "İmadəddin Nəsimi",
    "Şah İsmayıl Xətai",
    "Molla Pənah Vaqif",
    "Qasım bəy Zakir",
    "Seyid Əzim Şirvani",
    "Xurşidbanu Natəvan",
    "Qətran Təbrizi",
    "Xaqani Şirvani",
)


def authors(spark: SparkSession, names: Sequence[str] = AUTHORS) -> DataFrame:
    """(place, author): names in their order."""
    return spark.createDataFrame(list(enumerate(names)), "place int, author string")


def fetch(urls: DataFrame, transport: Callable[[str], tuple[int, str]], url: str = "url", wait: float = WAIT, slow_down: float = SLOW_DOWN) -> DataFrame:
    """urls with body and error. transport gives (status, body) and may raise.

    A failed call is tried again, TRIES times in all; status 429 waits longer; any other status but 200 is an error at
    once. A url that fails has its error in the row, so one bad page costs no other.
    """
    def one(address: str) -> tuple[str | None, str | None]:
        last = "no answer"
        for k in range(TRIES):
            try:
                status, body = transport(address)
            except Exception as e:  # noqa: BLE001  any transport's failure
                last = f"{type(e).__name__}: {e}"
                time.sleep((k + 1) * wait)
                continue
            if status == 200:
                return body, None
            if status != 429:
                return None, f"status {status}"
            last = "status 429"
            time.sleep(slow_down)
        return None, last

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(u) for u in b[url]]
            yield b.assign(body=[x[0] for x in got], error=[x[1] for x in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema if f.name not in ("body", "error"))
    return urls.drop("body", "error").mapInPandas(rows, f"{fields}, body string, error string")
