"""The shape of a transformation: learn a few numbers from a table, then project with them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from tabwright.functions.columns import normalize_non_finite

Fitted = dict[str, Any]


@dataclass(frozen=True)
class Transform:
    """``fit`` returns a small plain dict, ``apply`` is lazy.

    Stateless transforms keep the empty ``fit``. Splitting the two lets a caller fit on the
    training rows only, apply the result to a stream, or replay a recorded version.
    """

    def fit(self, df: DataFrame) -> Fitted:
        return {}

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        raise NotImplementedError

    def prepare(self, df: DataFrame) -> DataFrame:
        """What happens to the table before fit and apply."""
        return normalize_non_finite(df)

    def run(self, df: DataFrame) -> DataFrame:
        ready = self.prepare(df)
        return self.apply(ready, self.fit(ready))
