"""Documents scored by masked pseudo-likelihood.

A masked word is predicted from the two words to its left and the two to its
right.  Counts of (left, right) -> word and of (two left, two right) -> word,
keyed by hashes of the words themselves, are gathered over the whole corpus and
grow with it; each is interpolated with the next narrower by absolute
discounting, and a word's own occurrence is taken out of the counts that
predict it, so that only the rest of the corpus speaks for it.

Below both lies a window network for what was not seen elsewhere: words are
hashed into a fixed vocabulary and grouped into classes (the commonest alone,
the others by frequency); the network reads the classes to the left and to the
right, predicts the masked word's class, and within it a word has the corpus
share of its vocabulary entry.  Its loss depends only on the counts of all
(left, masked, right) windows, so training in numpy on the driver is exact
full-batch training on every window of the corpus.  This part alone has a fixed
size.

The windows are dealt to buckets by (left, right) in packed arrays; a bucket
counts and predicts its windows and sends each chunk of documents its sums.
The score of a document is the sum of the conditional log-probabilities of its
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import textvec
from larkspan.llm.common import lean, lean_table, ship, summed, sums

VOCABULARY = 1 << 16
CLASSES = 64
#: Classes of one word each; class 0 is the edge of a document.
SINGLE = 31
EMBEDDING = 16
HIDDEN = 64
STEPS = 200
RATE = 0.02
#: What is taken off each count for words not seen in a context.
DISCOUNT = 0.75
#: Words of the corpus a bucket on average; the number of buckets grows with the corpus.
BUCKET_WORDS = 1 << 21
#: Bits of a word and steps of the network's log-probability in a packed window.
WORD_BITS = 24
LOG_STEPS = 1024
#: Windows of a bucket that are counted at a time, whole contexts each.
SLICE = 1 << 18

_BLOCK = 4096


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _blocks(x: np.ndarray) -> dict[int, np.ndarray]:
    return {i: x[i * _BLOCK : (i + 1) * _BLOCK] for i in range(len(x) // _BLOCK)}


def _gathered(texts: DataFrame, run, size: int) -> np.ndarray:
    found = summed(texts, run, "<i8")
    return np.concatenate([found.get(i, np.zeros(_BLOCK, np.int64)) for i in range(size // _BLOCK)])


def word_counts(texts: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(0))
            for _, _, piece, at in textvec.chunks(data, offsets):
                total += np.bincount(_slots(textvec.words(piece, at)[0]), minlength=VOCABULARY)
        yield from sums(_blocks(total))

    return _gathered(texts, run, VOCABULARY)


def word_classes(counts: np.ndarray) -> np.ndarray:
    """The class of each vocabulary entry: 1 to SINGLE alone, the rest by frequency in bands of equal mass."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    classes = np.empty(len(counts), np.uint8)
    classes[order[:SINGLE]] = np.arange(1, SINGLE + 1)
    rest = order[SINGLE:]
    mass = np.cumsum(counts[rest] + 1)
    bands = CLASSES - SINGLE - 1
    classes[rest] = SINGLE + 1 + np.minimum((mass - 1) * bands // mass[-1], bands - 1)
    return classes


def _windows(classes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """left * CLASSES**2 + right * CLASSES + masked for each word."""
    n = len(classes)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left[1:], right[:-1] = classes[:-1], classes[1:]
    first, last = before[:-1], before[1:]
    some = last > first
    left[first[some]] = 0
    right[last[some] - 1] = 0
    return (left * CLASSES + right) * CLASSES + classes


def window_counts(texts: DataFrame, classes: np.ndarray) -> np.ndarray:
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(0))
            for _, _, piece, at in textvec.chunks(data, offsets):
                h, _, _, before = textvec.words(piece, at)
                total += np.bincount(_windows(shared.value[_slots(h)], before), minlength=CLASSES**3)
        yield from sums(_blocks(total))

    return _gathered(texts, run, CLASSES**3).reshape(CLASSES * CLASSES, CLASSES)


class WindowNetwork:
    """Embeddings of the left and right class, one hidden layer, softmax over the masked class."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.w = {"left": normal(CLASSES, EMBEDDING), "right": normal(CLASSES, EMBEDDING), "in": normal(2 * EMBEDDING, HIDDEN), "in0": np.zeros(HIDDEN), "out": normal(HIDDEN, CLASSES), "out0": np.zeros(CLASSES)}
        self.sides = np.repeat(np.arange(CLASSES), CLASSES), np.tile(np.arange(CLASSES), CLASSES)

    def _forward(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([self.w["left"][self.sides[0]], self.w["right"][self.sides[1]]], axis=1)
        hidden = np.tanh(x @ self.w["in"] + self.w["in0"])
        logits = hidden @ self.w["out"] + self.w["out0"]
        logits[:, 0] = -1e9  # the edge is never masked
        logits -= logits.max(axis=1, keepdims=True)
        return x, hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, counts: np.ndarray, steps: int = STEPS) -> float:
        """Full-batch Adam on the mean loss of all windows; gives the loss."""
        share = counts / max(1, counts.sum())
        each = share.sum(axis=1, keepdims=True)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            x, hidden, logp = self._forward()
            loss = float(-(share * logp).sum())
            d = np.exp(logp) * each - share
            back = (d @ self.w["out"].T) * (1 - hidden**2)
            dx = back @ self.w["in"].T
            grad = {"out": hidden.T @ d, "out0": d.sum(axis=0), "in": x.T @ back, "in0": back.sum(axis=0), "left": dx[:, :EMBEDDING].reshape(CLASSES, CLASSES, -1).sum(axis=1), "right": dx[:, EMBEDDING:].reshape(CLASSES, CLASSES, -1).sum(axis=0)}
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-10)
        return loss

    def table(self) -> np.ndarray:
        """log P(masked | left, right), flat in the order of the windows."""
        return self._forward()[2].astype(np.float32).reshape(-1)


def _beside(h: np.ndarray, before: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    """The word ``by`` places on in the same document; 0 beyond its edge."""
    at = np.arange(len(h)) + by
    inside = (at >= before[doc]) & (at < before[doc + 1])
    return np.where(inside, h[np.clip(at, 0, max(0, len(h) - 1))], np.uint64(0)) if len(h) else h


def _sides(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textvec.mix64(left * np.uint64(0x2545F4914F6CDD1D) + right)


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number, byte by byte, which compresses where numbers are small."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _numbers(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((raw.size // size, 8), np.uint8)
    out[:, :size] = raw.reshape(size, -1).T
    return out.view("<u8").reshape(-1)


#: Bytes of a packed window: context, word, outer words, log-probability, document from the one before.
_FIELDS = (5, WORD_BITS // 8, 2, 2, 4)


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(_planes(x, size) for x, size in zip(columns, _FIELDS, strict=True))


#: What holds each field once it is unpacked.
_TYPES = ("<u8", "<u4", "<u2", "<u2", "<u4")


def _field(raw: bytes, k: int) -> np.ndarray:
    """Field ``k`` of packed windows."""
    n = len(raw) // sum(_FIELDS)
    return _numbers(np.frombuffer(raw, np.uint8, n * _FIELDS[k], n * sum(_FIELDS[:k])), _FIELDS[k]).astype(_TYPES[k])


def _others(context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(word | context) from all other windows; ``lower`` is the distribution to fall back on."""
    key = context << np.uint64(WORD_BITS) | word
    order = np.argsort(key)
    key = key[order]
    pair = np.cumsum(np.append(0, key[1:] != key[:-1]))
    top = key >> np.uint64(WORD_BITS)
    group = np.cumsum(np.append(0, top[1:] != top[:-1]))
    first = np.append(True, pair[1:] != pair[:-1])
    same = np.bincount(pair)[pair]
    total = np.bincount(group)[group] - 1
    distinct = np.bincount(group, first)[group] - (same == 1)
    low = lower[order]
    out = np.empty(len(key))
    out[order] = np.where(total > 0, (np.maximum(same - 1 - DISCOUNT, 0) + DISCOUNT * distinct * low) / np.maximum(total, 1), low)
    return out


def _logs(context: np.ndarray, word: np.ndarray, outer: np.ndarray, log: np.ndarray) -> np.ndarray:
    """log P(word | its windows' contexts); whole contexts are counted at a time, so that what is held beside the windows does not grow with a bucket."""
    slices = -(-len(context) // SLICE)
    at = (context >> np.uint64(24)) * np.uint64(slices) >> np.uint64(16)  # contexts have 40 bits
    at = at.astype(np.uint16)
    out = np.empty(len(context), np.float32)
    for s in range(slices):
        mine = np.flatnonzero(at == s)
        near, words = context[mine], word[mine].astype(np.uint64)
        p = _others(near, words, np.exp(-(log[mine] / LOG_STEPS)))
        wide = textvec.mix64(near << np.uint64(16) | outer[mine]) >> np.uint64(WORD_BITS)
        out[mine] = np.log(_others(wide, words, p))
    return out


def _scored(table: pa.Table) -> pa.Table:
    """The windows of one bucket -> for each chunk the sums of its documents; heads of chunks go through."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["chunk"], r["head"]))
    blobs = [r for r in rows if not r["head"]]
    if blobs:
        logp, at = _logs(*(np.concatenate([_field(r["data"], k) for r in blobs]) for k in range(4))), 0
        for r in blobs:
            doc = np.cumsum(_field(r["data"], 4), dtype=np.int64)
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            sums_ = np.add.reduceat(logp[at : at + len(doc)].astype(np.float64), starts)
            r["data"] = np.diff(doc[starts], prepend=0).astype("<u4").tobytes() + sums_.astype("<f4").tobytes()
            at += len(doc)
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("head", pa.bool_()), ("data", pa.binary())]))


def _documents(table: pa.Table) -> pa.Table:
    """One chunk's head and sums -> its documents."""
    rows = sorted(table.to_pylist(), key=lambda r: (not r["head"], r["bucket"]))
    head = np.frombuffer(rows[0]["data"], "<i8").reshape(3, -1)
    ids, null, tokens = head[0], head[1].astype(bool), head[2]
    score = np.zeros(len(ids))
    for r in rows[1:]:
        n = len(r["data"]) // 8
        score[np.cumsum(np.frombuffer(r["data"], "<u4", n).astype(np.int64))] += np.frombuffer(r["data"], "<f4", n, 4 * n)
    mean = pa.array(score / np.maximum(tokens, 1), mask=tokens == 0)
    return pa.table([pa.array(ids, mask=null), pa.array(tokens), pa.array(score), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"])


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) of every row of ``docs``.

    A null or wordless text has no tokens, the sum 0 and a null mean; repeated
    rows are counted and scored each.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = rows.select("text")
    counts = word_counts(texts)
    classes = word_classes(counts)
    network = WindowNetwork()
    network.fit(window_counts(texts, classes))
    inside = np.log((counts + 1) / np.bincount(classes, counts + 1, CLASSES)[classes]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((classes, network.table(), inside))
    bits = min(16, max(3, int(counts.sum() // BUCKET_WORDS).bit_length()))
    part_of = "bucket int, chunk long, head boolean, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table, inside = shared.value
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = textvec.utf8(batch.column(1))
            ids = batch.column(0)
            for a, b, piece, at in textvec.chunks(data, offsets):
                h, _, _, before = textvec.words(piece, at)
                n, slots = np.diff(before), _slots(h)
                doc = np.repeat(np.arange(len(n)), n)
                log = -(table[_windows(classes[slots], before)] + inside[slots])
                log = np.minimum(np.round(log * LOG_STEPS), 65535).astype(np.uint64)
                left, right = (_beside(h, before, doc, by) for by in (-1, 1))
                near = _sides(left, right)
                outer = _sides(_beside(h, before, doc, -2), _beside(h, before, doc, 2)) >> np.uint64(48)
                bucket = (near >> np.uint64(64 - bits)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                near, word, outer, log, doc = near[order] << np.uint64(bits) >> np.uint64(WORD_BITS), h[order] & np.uint64((1 << WORD_BITS) - 1), outer[order], log[order], doc[order]
                ends = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(ends))
                blobs = []
                for x, y in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True):
                    blobs.append(_packed(near[x:y], word[x:y], outer[x:y], log[x:y], np.diff(doc[x:y], prepend=0)))
                mine = ids.slice(a, b - a)
                head = np.concatenate([mine.fill_null(0).to_numpy(zero_copy_only=False), mine.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n]).astype("<i8").tobytes()
                buckets = np.append(some, (chunk ^ chunk >> 32) % (1 << bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array([chunk] * len(buckets), pa.int64()), pa.array([False] * len(blobs) + [True]), pa.array([*blobs, head], pa.binary())], ["bucket", "chunk", "head", "data"])
                chunk += 1

    windows = rows.mapInArrow(lean(run), part_of).repartition(1 << bits, "bucket")
    sums_of = windows.groupBy("bucket").applyInArrow(lean_table(_scored), part_of)
    return sums_of.groupBy("chunk").applyInArrow(_documents, "doc_id long, n_tokens long, log_likelihood double, mean_log_prob double")
