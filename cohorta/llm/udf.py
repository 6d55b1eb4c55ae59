"""Python functions over columns of texts, in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Characters a function gets at once; one longer text goes alone.
CHUNK_CHARS = 1_000_000


def chunks(values: list[str], limit: int) -> Iterator[list[str]]:
    part, size = [], 0
    for v in values:
        if part and size + len(v) > limit:
            yield part
            part, size = [], 0
        part.append(v)
        size += len(v)
    if part:
        yield part


def on_texts(make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, column: str | Column, limit: int = CHUNK_CHARS) -> Column:
    """A struct column. ``make`` runs once per task and gives the function from texts to
    one list per field. A null text counts as empty. Marked as not deterministic, so
    that Spark does not work it out again for each field or filter."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            values = ["" if v is None else v for v in batch]
            parts = [pd.DataFrame(work(part)) for part in chunks(values, limit)]
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(work([]))

    return pandas_udf(run, schema).asNondeterministic()(column)
