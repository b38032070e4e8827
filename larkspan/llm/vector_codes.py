"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

All arithmetic that decides is on integers: a component x counts as
floor(256 x).  The entries of a part position stand in a vantage-point tree; a
branch is left out only if the triangle inequality, with every distance rounded
away from its use, puts it strictly farther than the best entry so far.
Entries that are visited are compared by integer distances, ties by number, so
that the result is the one of a full comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import lean, ship, summed, sums, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components beyond this are taken as not finite: squares of up to 8,192 of them still fit in a long.
LARGEST = 65_536
#: Entries below which a node is a leaf.
LEAF = 6
#: Relative width by which distances are rounded outwards, far above the error of a square root.
SLACK = 1e-12
_FAR = np.iinfo(np.int64).max


@dataclass
class Node:
    """``entries``: numbers held here (one vantage point, or a leaf's); ``within``: no inner entry is farther; ``beyond``: no outer entry is nearer."""

    entries: np.ndarray
    inner: Node | None = None
    outer: Node | None = None
    within: float = 0.0
    beyond: float = 0.0


def tree(book: np.ndarray, members: np.ndarray | None = None) -> Node | None:
    """Vantage-point tree over the rows of ``book``."""
    members = np.arange(len(book)) if members is None else members
    if not len(members):
        return None
    if len(members) <= LEAF:
        return Node(members)
    spread = ((book[members] - book[members].mean(0)) ** 2).sum(1)
    at = int(spread.argmax())  # a point at the edge parts the others best
    vantage, rest = members[at], np.delete(members, at)
    square = ((book[rest] - book[vantage]) ** 2).sum(1)
    order = np.argsort(square, kind="stable")
    rest, square = rest[order], square[order]
    half = len(rest) // 2
    return Node(members[at : at + 1], tree(book, rest[:half]), tree(book, rest[half:]), _up(square[half - 1]), _down(square[half]))


def _up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(square, np.float64)) * (1 + SLACK)


def _down(square: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(square, np.float64)) * (1 - SLACK)


def nearest(root: Node, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the entry of ``book`` nearest to each of ``points``; the smallest number where several are."""
    best, number = np.full(len(points), _FAR), np.full(len(points), len(book))

    def visit(node: Node | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        for entry in node.entries:
            square = ((points[rows] - book[entry]) ** 2).sum(1)
            better = (square < best[rows]) | (square == best[rows]) & (entry < number[rows])
            best[rows[better]], number[rows[better]] = square[better], entry
        if node.inner is None:
            return
        low, high = _down(square), _up(square)
        inside = low <= node.within
        for part, inner_first in ((inside, True), (~inside, False)):
            some, some_low, some_high = rows[part], low[part], high[part]
            for inner in (inner_first, not inner_first):
                reach = _up(best[some])
                near = some_low - node.within <= reach if inner else node.beyond - some_high <= reach
                visit(node.inner if inner else node.outer, some[near])

    visit(root, np.arange(len(points)))
    return number, best


class Codebooks:
    """(parts, entries, width) integers and a tree for each part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [tree(book) for book in entries]

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) numbers and squared distances for (rows, parts, width) integers."""
        found = [nearest(t, book, np.ascontiguousarray(points[:, p])) for p, (t, book) in enumerate(zip(self.trees, self.entries, strict=True))]
        return np.stack([n for n, _ in found], 1), np.stack([d for _, d in found], 1)

    def gathered(self, points: np.ndarray) -> np.ndarray:
        """Sums of the points of each entry, with their count behind them: (parts, entries, width + 1)."""
        number, _ = self.assign(points)
        total = np.zeros((*self.entries.shape[:2], self.entries.shape[2] + 1), np.int64)
        for p in range(len(total)):
            np.add.at(total[p, :, :-1], number[:, p], points[:, p])
            total[p, :, -1] = np.bincount(number[:, p], minlength=total.shape[1])
        return total

    def moved(self, total: np.ndarray) -> Codebooks:
        """Entries at the floor of their points' mean; entries without points stay."""
        count = total[..., -1:]
        return Codebooks(np.where(count > 0, total[..., :-1] // np.maximum(count, 1), self.entries))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _points(vectors: pa.Array, parts: int, dimension: int) -> np.ndarray:
    """(rows, parts, width) integers; every vector has ``dimension`` finite components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(vectors), parts, dimension // parts)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Dropped: null and empty vectors, those with null or non-finite components or
    one beyond ``LARGEST``, and those whose length is no multiple of ``parts`` or
    not that of the kept vector with the smallest id.  Codebooks start from the
    ``entries`` smallest ids (all vectors if there are fewer; null ids last;
    rows that repeat an id in order of their components).  Rows that repeat an
    id or a vector are coded each; a null id stays null; null labels count as
    one label.  An empty table gives an empty one.  Other columns are ignored.

    What leaves a task or goes to all of them has a fixed size: sums and
    entries of ``parts`` times ``entries``.  Rows move only to meet their
    label's sum, which is added up before it moves.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.expr(f"size(v) > 0 AND size(v) % {parts} = 0 AND coalesce(forall(v, x -> abs(x) <= {LARGEST}D), false)"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").first()
    kind = dict(rows.dtypes)["label"]
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dimension = len(first["v"])
    rows = rows.where(F.size("v") == dimension)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # a parameter bounds it
    start = np.floor(np.array([r["v"] for r in seeds]) * SCALE).astype(np.int64).reshape(len(seeds), parts, dimension // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))

    for _ in range(rounds):

        def gather(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), np.int64)
            for batch in batches:
                total += books.gathered(_points(batch.column("v"), parts, dimension))
            yield from sums({0: total})

        total = summed(rows.select("v"), gather, "int64")[0]
        books = books.moved(total.reshape(*books.entries.shape[:2], -1))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, square = books.assign(_points(batch.column("v"), parts, dimension))
            text = pa.array([x.tobytes().hex() for x in number.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(square.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = written(rows.mapInArrow(lean(code), f"vec_id long, label {kind}, code string, error long"), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
