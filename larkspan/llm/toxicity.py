"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, undoes compatibility forms, maps look-alike letters to
Latin ones, drops invisible characters, reads digits and signs inside words as
the letters they stand for, and leaves one space between words.  The lexicon
holds whole words (`` word ``) and word beginnings (`` stem``); weights are the
log-odds of a term's document frequencies in toxic and clean labelled texts.
Hits inside an exception phrase do not count.  The sum of weights and its ratio
to the length in words go through a logistic function fitted on the labels.

The labelled texts used for fitting are a bounded sample (``SAMPLE`` rows, those
of smallest hash); scoring covers every whole text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import lean, ship

#: Labelled rows used for fitting at most; the lexicon and the exception phrases are as large as these rows make them.
SAMPLE = 40_000
STEMS = (4, 5, 6)
LEAST_TOXIC = 4
LEAST_WEIGHT = 3.0
LEAST_CLEAN = 3
REJECT = 0.3

# Look-alike letters of other scripts and the Latin letters they pass for.
LOOKALIKES = dict(
    zip(
        "абвгдеёзикмнорстухіїјѕԁһӏԛԝɡɑαβγεηικνορτυχωϲ",
        "abbrdee3ukmhopctyxiijsdhlqwgaabyenikvoptuxwc",
        strict=True,
    )
)
# Digits and signs read as letters inside a word.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Harmless phrases around words that a lexicon may hold.
EXCEPTIONS = ("trash can", "trash bin", "circus clown", "clown fish", "pathetic fallacy", "sore loser rule")
# Characters without a width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

_FOLD = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$8](?=[^\W_]|[@$](?=[^\W_]))|(?<![^\W_])[013457@$8](?=[^\W\d_])|(?<=[^\W\d_])[0134578](?![^\W_])|(?<=[^\W_])[013457@$8](?=[^\W\d_])")
_REST = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """One space before, between and after the folded words."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_FOLD)
    return f" {_REST.sub(' ', _INSIDE.sub(lambda m: LEET[m[0]], text)).strip()} "


def terms(words: set[str]) -> Iterator[str]:
    """What the lexicon may hold for a text of these words."""
    yield from {f" {w} " for w in words if len(w) >= 3}
    yield from {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in exceptions:
            self.machine.add_word(folded := fold(phrase), (len(folded), None))
        self.any = bool(weights or exceptions)
        if self.any:
            self.machine.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """First position -> weight of the heaviest term there, outside exceptions."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(folded) if self.any else ():
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        return found if not spared else self._outside(found, sorted(spared))

    @staticmethod
    def _outside(found: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
        """The hits that start in none of the spans, which come sorted by their first position."""
        out, k, until = {}, 0, -1
        for at in sorted(found):
            while k < len(spared) and spared[k][0] <= at:
                until, k = max(until, spared[k][1]), k + 1
            if at >= until:
                out[at] = found[at]
        return out

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(self.hits(folded).values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))


class Scorer:
    """Scores of the texts of an Arrow column."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...], coefficients: np.ndarray):
        self.lexicon, self.b = Lexicon(weights, exceptions), coefficients

    def __call__(self, texts: pa.Array) -> np.ndarray:
        x = np.array([self.lexicon.features(t.as_py() or "") for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.b[0] + x @ self.b[1:], -30, 30)))


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def _documents(n: int, weights: np.ndarray) -> np.ndarray:
    return (weights + 0.5) / (n + 1)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], tuple[str, ...], np.ndarray]:
    """(weights, exception phrases, logistic coefficients) from the labelled rows that are not held out.

    Labels without an id or a verdict are left out; a document labelled more
    than once is toxic if any label says so.  Without labels the lexicon is empty
    and every text scores low.
    """
    ship(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).where(~held_out("id"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").select("text", "y")  # chosen: SAMPLE rows of 12 bytes at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        size = [0, 0]

        def out() -> pa.RecordBatch:
            seen[1][""], seen[0][""] = size[1], size[0]
            names = list(seen[1] | seen[0])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "bad", "good"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size[y > 0] += 1
                seen[y > 0].update(terms(set(fold(text).split())))
            if len(seen[0]) + len(seen[1]) > 150_000:
                yield out()
                seen, size = (Counter(), Counter()), [0, 0]
        yield out()

    counts = rows.mapInArrow(lean(count), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    good_enough = (F.col("term") == "") | ((F.col("bad") >= LEAST_TOXIC) & (F.col("bad") > F.col("good")))
    kept = counts.where(good_enough).collect()  # terms of LEAST_TOXIC of SAMPLE rows or more
    size = next(((r["bad"], r["good"]) for r in kept if not r["term"]), (0, 0))
    weights = {r["term"]: float(np.log((r["bad"] + 0.5) / (size[0] + 1)) - np.log((r["good"] + 0.5) / (size[1] + 1))) for r in kept if r["term"]}
    weights = {t: weights[t] for t in sorted(weights) if weights[t] >= LEAST_WEIGHT}
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = Lexicon(shared.value), (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(text)
                found = set()
                for at in lexicon.hits(folded):
                    end = folded.find(" ", at + 1)
                    before, after = folded[:at].rsplit(" ", 1)[-1], folded[end + 1 :].split(" ", 1)[0]
                    found |= {p for p in (f"{before} {folded[at + 1 : end]}" if before else "", f"{folded[at + 1 : end]} {after}" if after else "") if p}
                seen[y > 0].update(found)
        names = [p for p in seen[0]]  # a phrase no clean text holds is no exception
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["phrase", "bad", "good"])

    spared = rows.mapInArrow(lean(phrases), "phrase string, bad long, good long").groupBy("phrase").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.expr(f"good >= {LEAST_CLEAN} AND bad * 4 <= good")).orderBy("phrase").collect()  # phrases of LEAST_CLEAN of SAMPLE rows or more
    exceptions = (*EXCEPTIONS, *(r["phrase"] for r in spared))
    model = docs.sparkSession.sparkContext.broadcast((weights, exceptions))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*model.value)
        for batch in batches:
            x = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], ["total", "ratio", "y"])

    at = rows.mapInArrow(lean(measured), "total double, ratio double, y int").groupBy(F.round("total", 2).alias("total"), F.round("ratio", 2).alias("ratio"), "y").count().orderBy("total", "ratio", "y").collect()  # of SAMPLE rows at most
    x = np.array([[1.0, r["total"], r["ratio"]] for r in at]).reshape(-1, 3)
    return weights, exceptions, logistic(x, np.array([r["y"] > 0 for r in at], float), np.array([r["count"] for r in at], float))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic coefficients by Newton's method; the intercept is free of the penalty."""
    b = np.zeros(x.shape[1])
    if not n.sum():  # nothing is known to be toxic: every text scores low
        b[0] = -4.0
        return b
    penalty = np.diag([1e-3, *[0.1] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    b[1:] = np.maximum(b[1:], 0)  # more toxic words never lower the score
    return b


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    A null or empty text has no hits and gets the score of such texts; rows
    that repeat an id are scored each; a null id is not held out.  Other columns
    of either table are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*model.value)
        for batch in batches:
            s = score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= REJECT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``REJECT``; nothing is shuffled.

    A null or empty text has the score of such texts (no hits), rows with a null
    id and repeated rows are judged each by their text; an empty table gives an
    empty one; without labels every row stays.  Columns of any name are allowed.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(*model.value)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < REJECT))

    return docs.mapInArrow(lean(run), docs.schema)
