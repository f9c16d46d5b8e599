"""Numeric extrapolation over a stream of rows: the batch fold, carried from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numeric import Stretch, follow

STATE = "n long, hits long, counter long, known array<long>, at long"
OUT = "field string, n_values long, n_hits long, final_hits long"


def extrapolation(stream: DataFrame, field: str, order: str, value: str) -> DataFrame:
    """(field, n_values, n_hits, final_hits) after each micro-batch, for the fields it touched.

    ``order`` is an integer that grows within a field. Rows of a micro-batch are put in order; a row that is
    not above all rows of earlier ones is an error, since the fold depends on order. Null values are skipped.
    """
    rows = stream.filter(F.col(value).isNotNull()).select(F.coalesce(F.col(field).cast("string"), F.lit("")).alias("field"), F.col(order).cast("long").alias("o"), F.col(value).cast("long").alias("v"))

    def run(key, batches: Iterator, state) -> Iterator:
        import numpy as np
        import pandas as pd

        n, hits, counter, known, at = state.get if state.exists else (0, 0, 0, [], None)
        new = pd.concat(list(batches)).sort_values("o")
        orders = new.o.to_numpy()
        if (at is not None and orders[0] <= at) or (np.diff(orders) <= 0).any():
            raise ValueError(f"rows of field {key[0]!r} are not in order")
        stretch = Stretch()
        stretch.add(new.v.to_numpy(np.int64))
        n, hits, counter, last = follow(n, hits, counter, list(known), stretch)
        state.update((n, hits, counter, last, int(orders[-1])))
        yield pd.DataFrame({"field": [key[0]], "n_values": [n], "n_hits": [hits], "final_hits": [counter]})

    return rows.groupBy("field").applyInPandasWithState(run, OUT, STATE, "update", "NoTimeout")
