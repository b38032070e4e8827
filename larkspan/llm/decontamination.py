"""Benchmark decontamination by latent semantic retrieval.

Passages are runs of words, white space and punctuation apart.  One pass counts
in how many passages of the corpus each hashed word occurs; a second gathers
A'A·O for the TF-IDF matrix A of all passages and a random O, from which the
leading right singular vectors follow on the driver (single-pass randomised
SVD).  In the third pass every window of every document is projected, whitened
and compared by cosine with all benchmark items of its length.  Candidates that
hold too few of the item's rarer words, or of all its words, are dropped, which
loses none that the last step confirms; the others are confirmed by the longest common subsequence with the item: most of it, or half of it together with the item's answer (its last words, in order).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import textvec
from larkspan.llm.common import lean, ship, summed, sums

FEATURES = 1 << 14
PASSAGE = 48
RANK = 40
SKETCH = 48
#: Window lengths in words, carried on as far as the longest item; an item is searched with the shortest one that holds it.
WINDOWS = (8, 12, 16, 24, 36, 54, 81, 122, 183, 274, 411)
#: Only what points away from an item is no candidate: paraphrases lie far below verbatim copies, and the count of shared words rules out the rest.
COSINE = 0.0
VERBATIM = 0.7
PARAPHRASE = 0.5
ANSWER = 3
#: Benchmark items searched in one pass; more are searched in blocks.
ITEMS = 2000
#: Bytes of text projected at a time.
PIECE = 200_000

_BLOCK = 256
#: Windows compared with the items of their length at a time.
_WINDOWS = 1 << 13
#: Words of candidate regions looked up at a time.
_WORDS = 1 << 18


def _features(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(50)).astype(np.int16)  # below FEATURES


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words before each row) of pieces of a batch."""
    data, offsets = textvec.utf8(batch.column(column))
    for a, _, piece, at in textvec.chunks(data, offsets, PIECE):
        h, _, _, before = textvec.words(piece, at, textvec.PUNCTUATION)
        yield a, h, before


def _passages(before: np.ndarray) -> np.ndarray:
    """Passage number of each word: runs of PASSAGE words of one document."""
    n = np.diff(before)
    count = -(-n // PASSAGE)
    first = np.cumsum(count) - count
    return np.repeat(first, n) + (np.arange(before[-1]) - np.repeat(before[:-1], n)) // PASSAGE


def _counted(f: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage * FEATURES + feature, occurrences), sorted."""
    pairs = at * FEATURES + f
    if (int(at[-1]) + 1) * FEATURES < 1 << 31:
        pairs = pairs.astype(np.int32)
    pairs.sort()
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[first], np.diff(np.append(first, len(pairs)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Passages of all documents that hold each feature, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, h, before in _pieces(batch, 0):
                if len(h):
                    at = _passages(before)
                    pairs, _ = _counted(_features(h), at)
                    total += np.bincount(pairs % FEATURES, minlength=FEATURES)
                    passages += int(at[-1]) + 1
        yield from sums({0: total, 1: np.array([passages])})

    found = summed(texts, run, "<i8")
    return found.get(0, np.zeros(FEATURES, np.int64)), int(found[1][0]) if 1 in found else 0


def right_vectors(texts: DataFrame, idf: np.ndarray, seed: int = 7) -> np.ndarray:
    """FEATURES x RANK: word weights that take a bag of words to whitened latent coordinates."""
    rng = np.random.default_rng(seed)
    probe = rng.standard_normal((FEATURES, SKETCH)).astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((idf.astype(np.float32), probe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, probe = shared.value
        weighted = np.ascontiguousarray((probe * idf[:, None]).T)
        total = np.zeros((SKETCH, FEATURES), np.float64)
        for batch in batches:
            for _, h, before in _pieces(batch, 0):
                if not len(h):
                    continue
                f, at = _features(h), _passages(before)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                length = np.maximum(np.sqrt(_squares(f, at, idf, int(at[-1]) + 1)), 1e-9) ** 2  # once for the row, once for its transpose
                f = f.astype(np.int64)
                for k in range(SKETCH):  # a column at a time: sums along memory
                    seen = np.add.reduceat(weighted[k].take(f), first) / length
                    total[k] += np.bincount(f, seen.take(at), FEATURES)
        total = np.ascontiguousarray(total.T)
        total *= idf[:, None]
        yield from sums({b: total[b * _BLOCK : (b + 1) * _BLOCK].astype(np.float32) for b in range(FEATURES // _BLOCK)})

    found = summed(texts, run, "<f4")
    if not found:
        return np.zeros((FEATURES, RANK), np.float32)
    gram = np.concatenate([found[b] for b in sorted(found)]).reshape(FEATURES, SKETCH).astype(np.float64)
    core = probe.astype(np.float64).T @ gram
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    safe = values > max(values.max(), 0) * 1e-9
    half = gram @ (vectors[:, safe] / np.sqrt(values[safe]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    k = min(RANK, int((s > s.max(initial=0) * 1e-6).sum()))
    out = np.zeros((FEATURES, RANK), np.float32)
    out[:, :k] = u[:, :k] / np.maximum(s[:k], 1e-12) * idf[:, None]
    return out / max(float(np.abs(out).max()), 1e-30)


def _squares(f: np.ndarray, at: np.ndarray, idf: np.ndarray, passages: int) -> np.ndarray:
    """Squared length of each passage's TF-IDF vector."""
    pairs, n = _counted(f, at)
    return np.bincount(pairs // FEATURES, (n * idf[pairs % FEATURES]) ** 2.0, passages)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _lengths(longest: int) -> list[int]:
    """WINDOWS, carried on in the same ratio until one holds ``longest`` words."""
    lengths = list(WINDOWS)
    while lengths[-1] < longest:
        lengths.append(lengths[-1] * 3 // 2)
    return lengths


class Items:
    """Benchmark items with their words, answers and, for each window length, latent directions."""

    def __init__(self, ids: list[int], texts: list[str], basis: np.ndarray, centre: np.ndarray, frequency: np.ndarray | None = None):
        """``frequency`` of the features says which words are rare; without it results are the same, only slower."""
        self.ids, self.words = ids, []
        data, offsets = textvec.utf8(pa.array(texts, pa.string()))
        h, _, _, before = textvec.words(data, offsets, textvec.PUNCTUATION)
        rows: dict[int, list[int]] = {}
        latent = []
        lengths = _lengths(int(np.diff(before).max(initial=0)))
        for i, (a, b) in enumerate(zip(before[:-1], before[1:], strict=True)):
            self.words.append(h[a:b].tolist())
            latent.append((basis[_features(h[a:b])] - centre).sum(axis=0) if b > a else np.zeros(RANK))
            if b > a:
                rows.setdefault(next(w for w in lengths if w >= b - a), []).append(i)
        n = len(ids)
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.member = np.zeros((n, FEATURES + 1), bool)  # the last column stands for no word
        self.answer = np.full((n, ANSWER), FEATURES, np.int64)
        for i, w in enumerate(self.words):
            if w:
                f = _features(np.array(w, np.uint64)).astype(np.int64)
                self.member[i, f] = True
                self.answer[i] = np.resize(f[-ANSWER:], ANSWER)
        self._rarest(np.zeros(FEATURES, np.int64) if frequency is None else frequency)
        unit = _unit(np.array(latent, np.float32).reshape(-1, RANK))
        self.by_window = {w: (np.array(i), np.ascontiguousarray(unit[i].T)) for w, i in sorted(rows.items())}

    def _rarest(self, frequency: np.ndarray) -> None:
        """Words by which a region is found: where c of an item's n words match, m at least of any n - c + m of them do."""
        self.least = np.ones(len(self.ids), np.int64)
        of: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            c = int(np.ceil(PARAPHRASE * len(w)))
            self.least[i] = m = max(1, len(w) // 6)
            order = np.argsort(frequency[_features(np.array(w, np.uint64))], kind="stable") if w else []
            for word in {w[k] for k in order[: len(w) - c + m]}:
                of.setdefault(word, []).append(i)
        self.rare = np.array(sorted(of), np.uint64)
        self.rare_items = np.array([i for word in sorted(of) for i in of[word]], np.int16)  # ITEMS at most
        self.rare_ends = np.cumsum([0, *(len(of[word]) for word in sorted(of))])
        self.maybe = np.zeros(FEATURES, bool)
        self.maybe[_features(self.rare)] = True

    def hits(self, h: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of each rarer word of an item among ``h``, by item and then in order."""
        place = np.flatnonzero(self.maybe[features])
        at = np.searchsorted(self.rare, h[place])
        known = self.rare[np.minimum(at, len(self.rare) - 1)] == h[place]
        place, at = place[known], at[known]
        n = self.rare_ends[at + 1] - self.rare_ends[at]
        item = self.rare_items[np.repeat(self.rare_ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.argsort(item, kind="stable")
        return item[order], np.repeat(place, n)[order]


def common_subsequence(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for w in region:
        if p := places.get(w):
            u = v & p
            v = (v + u | v - u) & full
    return len(item) - bin(v).count("1")


def _in_order(answer: list[int], region: list[int]) -> bool:
    rest = iter(region)
    return all(w in rest for w in answer)


def _starts(before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of the windows of each row; the last ends with the row."""
    n = np.diff(before)
    stride = max(1, size // 4)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - size) // stride)), 0)
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = before[:-1][row] + np.minimum(k * stride, np.maximum(0, n[row] - size))
    return row, first, np.minimum(first + size, before[1:][row])


class Search:
    """Items that the rows of a batch give away."""

    def __init__(self, items: Items, basis: np.ndarray, centre: np.ndarray):
        self.items = items
        self.basis = np.ascontiguousarray((basis - centre).T)

    def _possible(self, features: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether a region holds enough of the item's words, and its answer's where those are asked for; what it denies no subsequence can give."""
        place = low[:, None] + np.arange(int((high - low).max()) if len(low) else 0)
        word = np.where(place < high[:, None], features[np.minimum(place, len(features) - 1)], FEATURES)
        held = self.items.member[item[:, None], word].sum(axis=1)
        answered = np.ones(len(item), bool)
        for k in range(ANSWER):
            answered &= (word == self.items.answer[item, k][:, None]).any(axis=1)
        size = self.items.sizes[item]
        return (held >= VERBATIM * size) | ((held >= PARAPHRASE * size) & answered)

    def _regions(self, item: np.ndarray, place: np.ndarray, size: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item), by window, of the items of one length and the windows whose regions hold enough of their rarer words; low and high ascend."""
        last = np.arange(len(item)) + self.items.least[item] - 1
        inside = np.minimum(last, len(item) - 1)
        enough = np.flatnonzero((last < len(item)) & (item[inside] == item) & (place[inside] - place < size + 2 * max(2, size // 4)))
        a, b = np.searchsorted(high, place[last[enough]], "right"), np.searchsorted(low, place[enough], "right")
        n = np.maximum(0, b - a)
        window = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.unique(window * len(self.items.ids) + np.repeat(item[enough], n))
        return both // len(self.items.ids), both % len(self.items.ids)

    def _candidates(self, total: np.ndarray, size: int, first: np.ndarray, end: np.ndarray, window: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(windows, items, cosines) of those of the pairs (window, item) that are near enough; every window is compared with every item of its length."""
        rows, latent = self.items.by_window[size]
        for a in range(0, len(first), _WINDOWS):
            seen = total.take(end[a : a + _WINDOWS], axis=1) - total.take(first[a : a + _WINDOWS], axis=1)
            cosine = (latent.T @ seen) / np.maximum(np.sqrt(np.einsum("kw,kw->w", seen, seen)), 1e-30)
            some = slice(*np.searchsorted(window, (a, a + _WINDOWS)))
            near = cosine[np.searchsorted(rows, item[some]), window[some] - a]
            keep = near >= COSINE
            yield window[some][keep], item[some][keep], near[keep]

    def __call__(self, batch: pa.RecordBatch, column: int) -> dict[tuple[int, int], tuple[float, float, int]]:
        """(row, item) -> (share of the item, cosine, first word) of the best passage."""
        found: dict[tuple[int, int], tuple[float, float, int]] = {}
        for top, h, before in _pieces(batch, column):
            if not len(h):
                continue
            features = _features(h)
            items, places = self.items.hits(h, features)
            features = np.append(features, np.int16(0)).astype(np.int64)
            total = np.zeros((RANK, len(h) + 1), np.float32)
            for k in range(RANK):
                np.cumsum(self.basis[k].take(features[:-1]), out=total[k, 1:])
            for size in self.items.by_window:
                row, first, end = _starts(before, size)
                slack = max(2, size // 4)
                low, high = np.maximum(before[:-1][row], first - slack), np.minimum(before[1:][row], end + slack)
                some = max(1, _WORDS // (size + 2 * slack))
                mine = np.isin(items, self.items.by_window[size][0])
                for window, item, near in self._candidates(total, size, first, end, *self._regions(items[mine], places[mine], size, low, high)):
                    for c in range(0, len(window), some):
                        w, i, cos = window[c : c + some], item[c : c + some], near[c : c + some]
                        for k in np.flatnonzero(self._possible(features, low[w], high[w], i)).tolist():
                            lo, hi, j = int(low[w[k]]), int(high[w[k]]), int(i[k])
                            region, words = h[lo:hi].tolist(), self.items.words[j]
                            if sum(map(set(region).__contains__, words)) < PARAPHRASE * len(words):
                                continue
                            share = common_subsequence(words, region) / len(words)
                            if share < PARAPHRASE or share < VERBATIM and not _in_order(words[-ANSWER:], region):
                                continue
                            r = int(row[w[k]])
                            got = (share, float(cos[k]), lo - int(before[r]))
                            if got > found.get((top + r, j), (0.0, 0.0, 0)):
                                found[top + r, j] = got
        return found


def _latent_space(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word weights, their mean over the corpus, passages with each word) from all passages of all texts."""
    frequency, passages = document_frequencies(texts)
    basis = right_vectors(texts, np.log((passages + 1) / (frequency + 1)) + 1e-3)
    return basis, (frequency / max(1, frequency.sum()) @ basis).astype(np.float32), frequency


def _blocks_of_items(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The query set, ``ITEMS`` at a time; one empty block if there is none."""
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    ids, texts, some = [], [], False
    for item in wanted.orderBy("item_id", "text").toLocalIterator():
        ids.append(item["item_id"])
        texts.append(item["text"])
        if len(ids) == ITEMS:
            yield ids, texts
            ids, texts, some = [], [], True
    if ids or not some:
        yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine, word) for each document and each benchmark item that it gives away.

    ``word`` is where the best passage starts.  Null and wordless texts or items
    match nothing; items without an id are left out; items with equal texts
    match alike; repeated rows give repeated results.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    basis, centre, frequency = _latent_space(rows.select("text"))
    out = None
    for ids, texts in _blocks_of_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Search(Items(ids, texts, basis, centre, frequency), basis, centre))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted(shared.value(batch, 1).items())
                doc_ids, item_ids = batch.column(0).to_pylist(), shared.value.items.ids
                columns = [pa.array([doc_ids[r] for (r, _), _ in found], pa.int64()), pa.array([item_ids[i] for (_, i), _ in found], pa.int64())]
                columns += [pa.array([x[k] for _, x in found], t) for k, t in ((0, pa.float64()), (1, pa.float64()), (2, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "lcs_share", "cosine", "word"])

        got = rows.mapInArrow(lean(run), "doc_id long, item_id long, lcs_share double, cosine double, word long")
        out = got if out is None else out.unionByName(got)
    return out


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that give no benchmark item away; nothing is shuffled.

    Null and wordless texts give nothing away and stay; repeated rows and rows
    with a null id are judged each by their text; an empty table, or an empty
    benchmark, changes nothing.  Columns of any name are allowed.
    """
    ship(docs.sparkSession)
    basis, centre, frequency = _latent_space(docs.select(F.col(text_col).alias("text")))
    at = docs.columns.index(text_col)
    for ids, texts in _blocks_of_items(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Search(Items(ids, texts, basis, centre, frequency), basis, centre))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _ in shared.value(batch, at)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
