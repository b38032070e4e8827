"""Session helpers of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources.shared import SMALL_BATCHES, discard, settings, shared_folder, ship, written  # noqa: F401

def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_KEPT: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What ``module`` keeps in this process between its tasks, such as an encoder.

    It goes when a task of another module begins: workers live on from stage to
    stage, and an encoder with all that it has learnt would stand beside the
    work of the stages that follow.
    """
    return _KEPT.setdefault(module, {})


def _make_room(run: Callable) -> None:
    for module, values in _KEPT.items():
        if module != run.__module__:
            values.clear()


def lean(run: Callable) -> Callable:
    """A mapInArrow function before which its Python worker drops what other modules keep, and after which it gives the memory back that it no longer needs: workers wait for further tasks, and several wait beside the ones at work."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _make_room(run)
        yield from run(batches)
        _give_back()

    return wrapped


def lean_table(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same of an applyInArrow function, after each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        _make_room(run)
        out = run(table)
        _give_back()
        return out

    return wrapped


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts into which the first round of ``summed`` deals the arrays of one block.
PARTS = 64
_SUMS = "block int, part int, vector binary"


def sums(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows for ``summed``: one partition's array of each block, all of one type."""
    part = TaskContext.get().partitionId() % PARTS
    for block, array in arrays.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([array.tobytes()], pa.binary())], ["block", "part", "vector"])


def summed(rows: DataFrame, run, dtype: str, how: str = "sum") -> dict[int, np.ndarray]:
    """The sum (or the bits set anywhere: "or") of each block's arrays over all partitions, gathered in two rounds; blocks are of a fixed number and size.

    ``run`` is the mapInArrow function that yields ``sums`` of one partition.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(raw, dtype)
                if (block, part) in total:
                    x = total[block, part] | x if how == "or" else total[block, part] + x
                total[block, part] = x
        for (block, part), x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "part", "vector"])

    first = rows.mapInArrow(lean(run), _SUMS).repartition("block", "part").mapInArrow(lean(add), _SUMS)
    last = first.withColumn("part", F.lit(0)).repartition("block").mapInArrow(lean(add), _SUMS)
    with settings(rows.sparkSession, SMALL_BATCHES):
        return {r["block"]: np.frombuffer(bytes(r["vector"]), dtype) for r in last.select("block", "vector").collect()}
