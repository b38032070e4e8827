"""Exact dedup by a log-structured merge index.

Texts are equal when identical after deleting white space.  Every input
partition keeps a memtable (digest -> best row, rows); a full memtable is
flushed as a run sorted by digest with a Bloom filter.  A run already holds one
entry a digest, so a group of any size costs one row a flush.  Runs are dealt
by digest; there compaction merges runs level by level and keeps, for each
digest, the row that stays (most code points, then smallest id) and the count.
Filters tell a probe which runs cannot hold a digest.  Documents that hit an
entry of several rows are compared byte by byte with the text that stays; a
digest that several texts share is then regrouped by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import lean, ship, unused, written

MEMTABLE = 50_000
FANOUT = 4
#: Members of one group that meet one copy of its text in the byte verification.
SALT = 500
#: Digests that hold this share of all rows or more are looked up by broadcast: as many entries at most.
HOT = 1000
SPACES = " \t\n\x0b\x0c\r"

_DIGEST = 32


class Run:
    """Entries sorted by digest, one a digest, and the Bloom filter over them."""

    def __init__(self, digest: np.ndarray, length: np.ndarray, keep: np.ndarray, rows: np.ndarray):
        order = np.lexsort((keep, -length, digest))
        digest, length, keep, rows = digest[order], length[order], keep[order], rows[order]
        first = np.ones(len(digest), bool)
        first[1:] = digest[1:] != digest[:-1]
        at = np.flatnonzero(first)
        self.digest, self.length, self.keep = digest[at], length[at], keep[at]
        self.rows = np.add.reduceat(rows, at) if len(at) else rows
        self.bits = 1 << max(6, int(np.ceil(np.log2(10 * max(1, len(at))))))
        self.filter = np.zeros(self.bits, bool)
        for i in self._places(self.digest):
            self.filter[i] = True

    def _places(self, digest: np.ndarray) -> list[np.ndarray]:
        words = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, _DIGEST // 8)
        return [(words[:, k] % np.uint64(self.bits)).astype(np.int64) for k in range(3)]

    def may_hold(self, digest: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.filter[i] for i in self._places(digest)])

    def find(self, digest: np.ndarray) -> np.ndarray:
        """Index of each digest, or -1; only digests that pass the filter are searched."""
        found = np.full(len(digest), -1)
        maybe = np.flatnonzero(self.may_hold(digest))
        if len(maybe) and len(self.digest):
            at = np.minimum(np.searchsorted(self.digest, digest[maybe]), len(self.digest) - 1)
            hit = self.digest[at] == digest[maybe]
            found[maybe[hit]] = at[hit]
        return found


class LsmIndex:
    """Memtable and levels of runs; ``FANOUT`` runs of a level are compacted into one of the next."""

    def __init__(self, memtable: int = MEMTABLE):
        self.memtable, self.held, self.pending = memtable, 0, []
        self.levels: list[list[Run]] = []

    def put(self, digest: np.ndarray, length: np.ndarray, keep: np.ndarray, rows: np.ndarray) -> None:
        if len(digest):
            self.pending.append((digest, length, keep, rows))
            self.held += len(digest)
        if self.held >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            self._add(0, Run(*map(np.concatenate, zip(*self.pending, strict=True))))
            self.pending, self.held = [], 0

    def _add(self, level: int, run: Run) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FANOUT:
            runs, self.levels[level] = self.levels[level], []
            self._add(level + 1, merged(runs))

    def compacted(self) -> Run | None:
        self.flush()
        runs = [r for level in self.levels for r in level]
        return merged(runs) if runs else None


def merged(runs: list[Run]) -> Run:
    """One run of several: digests that no later filter knows pass unchanged, the others take the better row."""
    base = max(runs, key=lambda r: len(r.digest))
    digest, length, keep, rows = ([getattr(base, k)] for k in ("digest", "length", "keep", "rows"))
    length[0], keep[0], rows[0] = length[0].copy(), keep[0].copy(), rows[0].copy()
    fresh: list[tuple] = []
    for run in runs:
        if run is base:
            continue
        at = base.find(run.digest)
        hit = at >= 0
        i = at[hit]
        better = (run.length[hit] > length[0][i]) | ((run.length[hit] == length[0][i]) & (run.keep[hit] < keep[0][i]))
        rows[0][i] += run.rows[hit]
        keep[0][i[better]] = run.keep[hit][better]
        length[0][i[better]] = run.length[hit][better]
        fresh.append((run.digest[~hit], run.length[~hit], run.keep[~hit], run.rows[~hit]))
    return Run(*(np.concatenate([a[0], *b]) for a, b in zip((digest, length, keep, rows), zip(*fresh, strict=True) if fresh else ((), (), (), ()), strict=True)))


_RUN = "digest binary, length long, keep long, n long"


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    digest = np.frombuffer(b"".join(batch.column(0).to_pylist()), f"S{_DIGEST}")
    return digest, *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))


def _out(run: Run) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(run.digest), 10_000):
        b = a + 10_000
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_DIGEST), len(run.digest[a:b]), [None, pa.py_buffer(run.digest[a:b].tobytes())])
        yield pa.RecordBatch.from_arrays([digest.cast(pa.binary()), pa.array(run.length[a:b]), pa.array(run.keep[a:b]), pa.array(run.rows[a:b])], ["digest", "length", "keep", "n"])


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of one partition, each as soon as its memtable is full."""
    pending, held = [], 0
    for batch in batches:
        pending.append(_columns(batch))
        held += batch.num_rows
        if held >= MEMTABLE:
            yield from _out(Run(*map(np.concatenate, zip(*pending, strict=True))))
            pending, held = [], 0
    if held:
        yield from _out(Run(*map(np.concatenate, zip(*pending, strict=True))))


def _compaction(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = LsmIndex()
    for batch in batches:
        index.put(*_columns(batch))
    run = index.compacted()
    if run is not None:
        yield from _out(run)


def stripped(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _hot_safe(members: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """members JOIN groups on ``key``; the members of a large group are dealt over copies of its row."""
    salts = F.expr(f"CAST(ceil(n / {SALT}) AS INT)")
    return members.withColumn("salt", F.pmod(F.xxhash64("id"), F.expr(f"ceil(n / {SALT})")).cast("int")).join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n"), [key, "salt"]).drop("salt")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, length) of every row of ``docs``.

    A null text counts as empty; all texts without a visible character are
    equal.  Of equal texts the row with the most code points, then the smallest
    id stays; rows that repeat id and text give that many rows, all kept or all
    dropped, and count in group_size.  A row with a null id stays and is a group
    of its own.  Other columns are ignored.
    ``digest_bits`` shortens the index key (tests force collisions with it).
    """
    ship(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def digest(bare: Column) -> Column:
        return F.unhex(F.sha2(bare, 256) if digest_bits >= 256 else F.rpad(F.substring(F.sha2(bare, 256), 1, max(1, digest_bits // 4)), 64, "0"))

    def length(text: Column) -> Column:
        return F.length(F.coalesce(text, F.lit(""))).cast("long")

    bare = stripped(F.col("text"))
    keyed = written(raw.select("id", digest(bare).alias("digest"), length(F.col("text")).alias("length"), F.sha2(bare, 256).alias("sha")), "keyed")
    runs = keyed.where("id IS NOT NULL").select("digest", "length", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n")).mapInArrow(lean(_flushes), _RUN)
    groups = written(runs.repartition("digest").mapInArrow(lean(_compaction), _RUN), "groups")
    entries = groups.selectExpr("digest", "keep", "n", "length AS most")
    hot = F.broadcast(entries.where(F.col("n") * HOT >= max(1, keyed.count())).where("n > 1"))  # at most HOT rows
    marked = keyed.join(hot, "digest", "left")
    cool = marked.where("n IS NULL").drop("keep", "n", "most").join(entries, "digest", "left")
    marked = written(marked.where("n IS NOT NULL").unionByName(cool), "marked")

    hits = marked.where("n > 1 AND id IS NOT NULL").select("id", "digest", "keep", "n").distinct()
    members = hits.join(raw.select("id", bare.alias("bare")), "id").where(digest(F.col("bare")) == F.col("digest"))
    stays = members.where("id = keep").select("digest", "n", F.col("bare").alias("base")).dropDuplicates(["digest"])
    clash = written(_hot_safe(members, stays, "digest").where("bare <> base").select("digest").distinct(), "clashes")
    kept = "CASE WHEN id IS NULL THEN true ELSE id = keep AND length = most END AS kept"
    plain = marked.selectExpr("id AS doc_id", "CASE WHEN id IS NULL THEN id ELSE keep END AS keep_id", "CASE WHEN id IS NULL THEN 1L ELSE n END AS group_size", kept, "sha AS text_sha256", "length", "digest")
    if clash.isEmpty():
        return plain.drop("digest")
    again = raw.select("id", length(F.col("text")).alias("length"), bare.alias("bare")).withColumn("digest", digest(F.col("bare"))).where("id IS NOT NULL").join(clash, "digest", "left_semi")
    best = again.groupBy("digest", "bare").agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("id").alias("keep"))).alias("best"), F.count("*").alias("group_size"))
    regrouped = again.join(best, ["digest", "bare"]).selectExpr("id AS doc_id", "best.keep AS keep_id", "group_size", "id = best.keep AND length = -best.l AS kept", "sha2(bare, 256) AS text_sha256", "length")
    rest = plain.where("doc_id IS NOT NULL").join(clash, "digest", "left_anti").unionByName(plain.where("doc_id IS NULL")).drop("digest")
    return rest.unionByName(regrouped)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each set of equal texts, and rows with a null id.

    A null text counts as empty.  Of rows that repeat id and text, the one
    smallest in its other columns stays (compared as JSON, nulls first), so the
    result is the same in every run.  Columns of any name are allowed; an empty
    table gives an empty one.
    """
    key, sha, size, row = (unused(docs, c) for c in ("stays_id", "stays_sha", "stays_length", "stays_row"))
    stays = exact_dedup(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), F.col("length").alias(size)).distinct()
    same = (F.sha2(stripped(F.col(text_col)), 256) == F.col(sha)) & (F.length(F.coalesce(F.col(text_col), F.lit(""))) == F.col(size))
    found = docs.join(stays, F.col(id_col).cast("long") == F.col(key)).where(same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = found.groupBy(key, sha).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))).alias(row))
    return once.select(f"{row}.*").unionByName(docs.where(F.col(id_col).isNull()))
