"""Incremental fit: the fold's state kept by key over a stream, and scores against a fitted model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from vedette.operators.fold import Fold
from vedette.operators.model import FittedModel
from vedette.session import ship

STATE = "k long, o binary, population binary, radius binary, width int"
OUTPUT = "key string, oid int, o array<double>, population long, radius double"


def _update(radius: float, factor: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["seq"], kind="stable")
        x = np.array(rows["x"].tolist(), float)
        if state.exists:
            k, o, p, r, width = state.get
            fold = Fold(radius, factor, 1.0, np.frombuffer(o, float).reshape(k, width), np.frombuffer(p, np.int64), np.frombuffer(r, float))
        else:
            fold = Fold(radius, factor)
        o, p, r = fold.feed(x).rows()
        state.update((len(p), np.ascontiguousarray(o).tobytes(), p.tobytes(), r.tobytes(), x.shape[1]))
        yield pd.DataFrame({"key": [str(key[0])] * len(p), "oid": np.arange(len(p), dtype=np.int32), "o": [v.tolist() for v in o], "population": p, "radius": r})

    return run


def fit_stream(points: DataFrame, key: str, radius: float, factor: float = 0.1) -> DataFrame:
    """A stream of (key, seq, x) -> for every key with new points, all its observers after this trigger.

    Use output mode `update`; points of one trigger are folded in order of seq, triggers in the order they come. The
    state of a key is its observers: it grows with them, not with the points."""
    ship(points.sparkSession)
    return points.select(key, "seq", "x").groupBy(key).applyInPandasWithState(_update(radius, factor), OUTPUT, STATE, "update", "NoTimeout")


def score_stream(points: DataFrame, model: FittedModel) -> DataFrame:
    """A stream of points scored against a fitted model, without state."""
    return model.outlierness(points)


def latest(updates: DataFrame) -> DataFrame:
    """The last state of each observer in a table of fit_stream() updates with a `trigger` number."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    last = updates.withColumn("_t", F.max("trigger").over(Window.partitionBy("key")))
    return last.where("trigger = _t").drop("_t", "trigger")


__all__ = ["STATE", "OUTPUT", "fit_stream", "score_stream", "latest"]
