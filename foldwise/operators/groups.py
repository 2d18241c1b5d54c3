"""Pandas functions on groups of rows, many small groups to a call.

``applyInPandas`` pays several milliseconds for each group, more than the work on a small
matrix.  Here a task reads its groups one after the other from sorted batches; a task still
holds one group and one batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Rows at which another group begins, the first row left out."""
    new = np.zeros(max(len(pdf) - 1, 0), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        differ = np.asarray(v[1:] != v[:-1], bool)
        if differ.any():
            none = pdf[k].isna().to_numpy()
            new |= differ & ~(none[1:] & none[:-1])
    return np.flatnonzero(new) + 1


def per_group(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As ``df.groupBy(*keys).applyInPandas(fn, schema)``, without a call for each group."""
    keys = list(keys)

    def run(batches):
        def result(parts: list[pd.DataFrame]) -> pd.DataFrame:
            pdf = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            return fn(tuple(pdf[k].iloc[0] for k in keys), pdf)

        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            # the open group goes on where the first row has its key
            if held and len(_starts(pd.concat([held[0][keys].iloc[:1], pdf[keys].iloc[:1]]), keys)):
                yield result(held)
                held = []
            at = [0, *_starts(pdf, keys).tolist(), len(pdf)]
            out = []
            for a, b in zip(at, at[1:]):
                held.append(pdf.iloc[a:b].reset_index(drop=True))
                if b < len(pdf):
                    out.append(result(held))
                    held = []
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield result(held)

    # by a hash of the keys: Spark drops a repartition by the columns that a join has dealt its rows by, and as
    # mapInPandas asks for no distribution, it may then read the join's shuffle by mapper or in parts and cut groups
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInPandas(run, schema)
