"""Ordered computations as streams with a state for each key: best so far, usage so far, moving averages.

They give for each row what the batch forms in ``operators.ordered`` give, as
long as the rows of a key come in order from one trigger to the next; rows of one
trigger are put in order here. The state of a key is a number or two, or a set
of codes, and is kept in the checkpoint, from which a restarted query goes on.

The session's state store has to be that of RocksDB; ``use_state_store`` sets it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Ordered(StatefulProcessor):
    """Takes a key's rows of one trigger in order and adds columns; ``step`` makes these of the values so far."""

    def __init__(self, column: str, order: list[str], names: list[str]):
        self.column, self.order, self.names = column, order, names

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        added = list(zip(*self.step(held[self.column].tolist()), strict=True))
        yield held.assign(**dict(zip(self.names, map(list, added), strict=True)))

    def step(self, values: list) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class BestSoFar(_Ordered):
    """``is_best``: whether a value is strictly below all before it, and below ``initial``."""

    def __init__(self, column: str, order: list[str], initial: float = 1e9):
        super().__init__(column, order, ["is_best"])
        self.initial = initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.low = handle.getValueState("low", StructType([StructField("low", DoubleType())]))

    def step(self, values):
        low = self.low.get()[0] if self.low.exists() else self.initial
        out = []
        for v in values:
            missing = v is None or v != v
            out.append((None if v is None else bool(not missing and v < low),))
            if not missing:
                low = min(low, v)
        self.low.update((float(low),))
        return out


class CumulativeUsage(_Ordered):
    """``used, usage``: the codes seen up to each row, and their share of ``size``; the state has an entry for each code."""

    def __init__(self, column: str, order: list[str], size: int, kind: str):
        super().__init__(column, order, ["used", "usage"])
        self.size, self.kind = size, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"code {self.kind}", "n long")
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def step(self, values):
        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for v in values:
            if not self.seen.containsKey((v,)):
                n += 1
                self.seen.updateValue((v,), (n,))
            out.append((n, n / self.size))
        self.count.update((n,))
        return out


class MovingAverage(_Ordered):
    """``updates, ema``: the average with a decay that ramps up, started at the first value."""

    def __init__(self, column: str, order: list[str], decay: float = 0.9999, tau: float = 2000.0):
        super().__init__(column, order, ["updates", "ema"])
        self.decay, self.tau = decay, tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", StructType([StructField("k", LongType()), StructField("ema", DoubleType())]))

    def step(self, values):
        k, ema = self.held.get() if self.held.exists() else (0, None)
        out = []
        for v in values:
            k += 1
            d = self.decay * (1 - math.exp(-k / self.tau))
            ema = (v if ema is None else ema) * d + (1 - d) * v
            out.append((k, ema))
        self.held.update((k, float(ema)))
        return out


def _processed(rows: DataFrame, by: str, processor: _Ordered, *added: str) -> DataFrame:
    ship(rows.sparkSession)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.groupBy(by).transformWithStateInPandas(processor, f"{kinds}, {', '.join(added)}", "Append", "None")


def best_so_far(rows: DataFrame, loss: str, by: str, order: list[str], initial: float = 1e9) -> DataFrame:
    """The stream ``rows`` with ``is_best``."""
    return _processed(rows, by, BestSoFar(loss, order, initial), "is_best boolean")


def cumulative_usage(rows: DataFrame, code: str, by: str, order: list[str], size: int) -> DataFrame:
    """The stream ``rows`` with ``used, usage``."""
    return _processed(rows, by, CumulativeUsage(code, order, size, dict(rows.dtypes)[code]), "used long", "usage double")


def moving_average(rows: DataFrame, value: str, by: str, order: list[str], decay: float = 0.9999, tau: float = 2000.0) -> DataFrame:
    """The stream ``rows`` with ``updates, ema`` after each row."""
    return _processed(rows, by, MovingAverage(value, order, decay, tau), "updates long", "ema double")
