"""Backends that make rows between two frames, by name, behind one interface.

A backend is asked for batches: the values at both ends of many gaps and, for each gap, where between
them rows are wanted. One that takes all steps of a gap at once and one that takes a step at a time
look the same from outside. Models that make pictures are not part of this library; the two here
work on numbers.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BACKENDS: dict[str, Callable[[], Backend]] = {}


class Backend(ABC):
    """Values between left and right (gaps, columns) at parts (steps,) in (0, 1): (gaps, steps, columns)."""

    @abstractmethod
    def between(self, left: np.ndarray, right: np.ndarray, parts: np.ndarray) -> np.ndarray: ...


class OneStep(Backend):
    """For models that take one step at a time: give `at`."""

    @abstractmethod
    def at(self, left: np.ndarray, right: np.ndarray, part: float) -> np.ndarray: ...

    def between(self, left: np.ndarray, right: np.ndarray, parts: np.ndarray) -> np.ndarray:
        steps = [self.at(left, right, float(p)) for p in parts]
        return np.stack(steps, 1) if steps else np.zeros((len(left), 0, left.shape[1]))


def backend(name: str) -> Callable[[type[Backend]], type[Backend]]:
    """Registers a class of backends. It is made in each task, so what it loads stays there."""

    def add(cls: type[Backend]) -> type[Backend]:
        if name in _BACKENDS:
            raise ValueError(f"{name} is registered twice")
        _BACKENDS[name] = cls
        return cls

    return add


def named(name: str) -> Callable[[], Backend]:
    if name not in _BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {', '.join(sorted(_BACKENDS))}")
    return _BACKENDS[name]


@backend("linear")
class Linear(Backend):
    def between(self, left: np.ndarray, right: np.ndarray, parts: np.ndarray) -> np.ndarray:
        return left[:, None] + (right - left)[:, None] * parts[None, :, None]


@backend("ease")
class Ease(OneStep):
    """Leaves and arrives at rest."""

    def at(self, left: np.ndarray, right: np.ndarray, part: float) -> np.ndarray:
        return left + (right - left) * (part * part * (3 - 2 * part))


def interpolated(path: DataFrame, columns: list[str], factor: int, name: str = "linear") -> DataFrame:
    """match_id, frame, k and columns: each frame (k = 0) and the factor - 1 rows to the next one; the last frame has none after it.

    A null at either end makes the rows between null. Gaps go to the backend by Arrow batches.
    """
    make = named(name)
    if factor < 1:
        raise ValueError("factor is 1 or more")
    w = Window.partitionBy("match_id").orderBy("frame")
    ends = path.select("match_id", "frame", *columns, *[F.lead(c).over(w).alias(f"_{c}") for c in columns], F.lead("frame").over(w).isNotNull().alias("_more"))
    schema = "match_id long, frame long, k int, " + ", ".join(f"{c} double" for c in columns)
    parts = np.arange(1, factor) / factor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            side = lambda pre: np.column_stack([b.column(pre + c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in columns])  # noqa: E731, B023
            left, right, more = side(""), side("_"), b.column("_more").to_numpy(zero_copy_only=False).astype(bool)
            made = model.between(left[more], right[more], parts)
            ids, frames = (b.column(c).to_numpy(zero_copy_only=False) for c in ("match_id", "frame"))
            n = factor - 1
            rows = np.concatenate([left, made.reshape(-1, len(columns))])
            k = np.concatenate([np.zeros(len(left)), np.tile(np.arange(1, factor), int(more.sum()))]).astype(np.int32)
            own = [np.concatenate([v, np.repeat(v[more], n)]) for v in (ids, frames)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(k), *[pa.array(v, from_pandas=True) for v in rows.T]], ["match_id", "frame", "k", *columns])

    return ends.mapInArrow(run, schema)
