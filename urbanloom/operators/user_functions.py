"""Functions that users supply: metrics over groups, rewards over completions, and their registries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REWARDS: dict[str, Callable[..., pd.Series]] = {}


class Metric:
    """A metric as a state that is updated row by row and computed at the end; subclasses set ``zero`` and the three methods."""

    zero: dict = {}

    def update(self, state: dict, predicted: pd.Series, true: pd.Series) -> dict:
        raise NotImplementedError

    def compute(self, state: dict) -> float:
        raise NotImplementedError


def metric_by(rows: DataFrame, keys: list[str], metric: Metric, predicted: str, true: str, parts: int = 16) -> DataFrame:
    """(keys, value): a user's metric of each group.

    The rows of a group are split into ``parts`` by a hash, each part's state is made in its own task; states hold numbers
    that add up, so a group of any size is joined from ``parts`` small rows.
    """
    names = list(metric.zero)
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names])

    def part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        state = metric.update(dict(metric.zero), frame[predicted], frame[true])
        return pd.DataFrame([list(key[:-1]) + [float(state[n]) for n in names]], columns=[*keys, *names])

    split = rows.select(*keys, predicted, true, F.pmod(F.xxhash64(predicted, true), F.lit(parts)).alias("_p"))
    states = split.groupBy(*keys, "_p").applyInPandas(part, schema).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])

    @F.pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        return pd.Series([metric.compute(dict(zip(names, row))) for row in zip(*columns)], dtype=float)

    return states.select(*keys, value(*names).alias("value"))


def register_reward(name: str):
    """Register a reward: a function of completions (and further columns) as pandas series that gives a series of numbers."""

    def add(f: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
        if name in REWARDS:
            raise ValueError(f"reward {name} is registered already")
        REWARDS[name] = f
        return f

    return add


def reward(name: str, *columns: str | Column) -> Column:
    """The registered reward of the columns, worked out a batch at a time."""
    f = REWARDS[name]

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return f(*series).astype(float)

    return run(*columns)
