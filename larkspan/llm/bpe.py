"""Exact byte-level BPE by backtracking, and decoding by an offset table.

The vocabulary file is read once, on the driver, and shipped as bytes (its size
is checked); nothing is trained.  A text is cut at the special tokens and then
by the pre-tokeniser pattern; merges never cross those cuts.  Each piece is
encoded in linear time: Aho-Corasick gives the longest token at every position,
a token may follow another only if the pair is compatible (no cheaper merge
would have crossed their boundary), and a dead end steps back to the next
shorter token.  Encoded pieces are kept in a bounded table of each worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import kept, lean, ship

#: A vocabulary file over this size is refused: it goes to every worker.
MOST_BYTES = 64_000_000
#: Pieces that a worker remembers, twice.
PIECES = 300_000

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _latin() -> str:
    """PATTERN for texts of the first 256 characters, its classes spelt out: for these Python's own engine can be used, which is faster."""
    letters, digits, spaces = ("".join(re.escape(chr(i)) for i in range(256) if regex.match(p, chr(i))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    out = PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
    return out.replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


LATIN = _latin()

# Letters and digits of Unicode 17 that the tokenisers' Unicode 16 tables do not know as such.
NEWER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codes:
    """Ranks: 0 to 255 are the bytes, 256 + i is the product of merge i."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        by_letter = {b: c for c, b in letters.items()}
        self.bytes = [bytes([b]) for b in range(256)]
        self.id = [vocabulary[by_letter[b]] for b in range(256)]
        rank = {t: r for r, t in enumerate(self.bytes)}
        self.left, self.right, self.pair = list(range(256)), list(range(256)), {}
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = rank[as_bytes(a)], rank[as_bytes(b)]
            whole = self.bytes[left] + self.bytes[right]
            if whole in rank:  # an earlier merge makes it too
                self.pair[left, right] = rank[whole]
                continue
            rank[whole] = self.pair[left, right] = len(self.bytes)
            self.bytes.append(whole)
            self.left.append(left)
            self.right.append(right)
            self.id.append(vocabulary[a + b])
        self.rank = rank
        self.compatible = cache(lambda a, b: self._apart(a, b, len(self.bytes)))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*self.id, *self.special.values()]) + 1
        self.text = [b""] * size
        for t, text in enumerate(self.bytes):
            self.text[self.id[t]] = text
        for text, i in self.special.items():
            self.text[i] = text.encode()

    # What only ``ranks`` needs is made when it is asked first: other encoders use the rest alone.

    @cached_property
    def real(self) -> list[bool]:
        real = [True] * 256
        for t in range(256, len(self.bytes)):
            real.append(real[self.left[t]] and real[self.right[t]] and self._apart(self.left[t], self.right[t], t))
        return real

    @cached_property
    def longest(self) -> ahocorasick.Automaton:
        longest = ahocorasick.Automaton()
        for text, t in self.rank.items():
            if self.real[t]:
                longest.add_word(text.decode("latin-1"), (t, len(text)))
        longest.make_automaton()
        return longest

    @cached_property
    def shorter(self) -> list[int]:
        return [self._prefix(text) for text in self.bytes]

    def _prefix(self, text: bytes) -> int:
        for n in range(len(text) - 1, 0, -1):
            if self.real[t := self.rank.get(text[:n], -1)] and t >= 0:
                return t
        return -1

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below what already happened joins a's end to b's start: merges are undone, latest first."""
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                if a >= 256:
                    limit, a = a, self.right[a]
                elif b >= 256:
                    limit, b = b + 1, self.left[b]
                else:
                    return True
            elif b >= 256:
                limit, b = b + 1, self.left[b]
            elif a >= 256:
                limit, a = a, self.right[a]
            else:
                return True

    def ranks(self, piece: bytes) -> list[int]:
        if self.real[t := self.rank.get(piece, -1)] and t >= 0:
            return [t]
        n = len(piece)
        at = [-1] * n
        for end, (t, size) in self.longest.iter(piece.decode("latin-1")):
            if at[start := end - size + 1] < 0 or len(self.bytes[at[start]]) < size:
                at[start] = t
        out: list[int] = []
        open_end = bytearray(b"\x01") * (n + 1)
        pos, t, texts, shorter, compatible = 0, at[0] if n else -1, self.bytes, self.shorter, self.compatible
        while t >= 0:
            last = out[-1] if out else -1
            end = pos + len(texts[t])
            if open_end[end] and (last < 0 or compatible(last, t)):
                out.append(t)
                pos = end
                t = at[pos] if pos < n else -1
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                open_end[pos] = 0
                t = out.pop()
                pos -= len(texts[t])
        return out

    def pieces_ids(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all pieces, and where those of each end."""
        ids: list[int] = []
        ends = []
        for piece in pieces:
            ids.extend([self.id[t] for t in self.ranks(piece.encode())])
            ends.append(len(ids))
        return ids, ends


class Pieces:
    """piece -> its ids as bytes, in ``now``.  Bounded: when the young pieces fill the table, it becomes the old one."""

    def __init__(self, make: Callable[[list[str]], tuple[list[int], list[int]]], most: int | None = None):
        self.most = most
        # Plain dictionaries: a set is compared with one piece by piece of its own, with a subclass by all pieces of the table.
        self.make, self.now, self.old = make, {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Makes all pieces that are not here ready; those that are not made at once are made one by one."""
        if len(self.now) >= (self.most or PIECES):
            self.now, self.old = {}, self.now
        absent = pieces.difference(self.now)
        missing = list(absent.difference(self.old))
        again = absent.difference(missing)
        self.now.update(zip(again, map(self.old.__getitem__, again), strict=True))
        for a in range(0, len(missing), 4096):
            part = missing[a : a + 4096]
            ids, ends = self.make(part)
            raw, ends = np.array(ids, "<u4").tobytes(), (4 * np.asarray(ends)).tolist()
            self.now.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))


class Encoder:
    """Whole texts to ids; ``make`` gives the ids of a list of pieces and where each piece's end, ``most`` is how many of them are remembered, twice (None: PIECES)."""

    def __init__(self, source: bytes, make: Callable[[list[str]], tuple[list[int], list[int]]] | None = None, most: int | None = None):
        self.codes = Codes(source)
        self.pieces = Pieces(make or self.codes.pieces_ids, most)
        self._find, self._find_latin = regex.compile(PATTERN).findall, re.compile(LATIN).findall

    def find(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        try:
            text.encode("latin-1")  # a quick way to see that nothing in the text is newer
            return self._find_latin(text)
        except UnicodeEncodeError:
            if not NEWER.search(text):
                return self._find(text)
        pieces, at = [], 0
        for piece in self._find(NEWER.sub("\ue000", text)):  # U+E000 is neither letter, digit nor space
            pieces.append(text[at : at + len(piece)])
            at += len(piece)
        return pieces

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, special = self.codes.cut, self.codes.special
        found = []
        for text in texts:
            if not text:
                found.append([])
            elif cut is None or not any(s in text for s in special):
                found.append(self.find(text))
            else:
                found.append([x for part in cut.split(text) for x in ([part] if part in special else self.find(part))])
        self.pieces.learn(set().union(*found).difference(special))
        table = self.pieces.now
        out = []
        for text, pieces in zip(texts, found, strict=True):
            if cut is not None and text and any(s in text for s in special):
                raw = b"".join(np.array([special[p]], "<u4").tobytes() if p in special else table[p] for p in pieces)
            else:
                raw = b"".join(map(table.__getitem__, pieces))
            out.append(np.frombuffer(raw, "<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


class Offsets:
    """Strings laid end to end; ids are turned into text by one gather."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        if not len(end):
            return self.all[:0]
        return self.all[np.arange(end[-1]) + np.repeat(self.start[ids] - (end - size), size)]


class Decoder(Offsets):
    def __init__(self, codes: Codes):
        super().__init__(codes.text)

    def text(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; bytes that are no text become U+FFFD."""
        raw = self.join(ids).tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_WORKER: dict[str, tuple] = kept(__name__)


def worker(source: bytes) -> tuple[Encoder, Decoder, Offsets]:
    """Encoder, decoder and decimal table of this process."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _WORKER:
        encoder = Encoder(source)
        _WORKER[key] = encoder, Decoder(encoder.codes), Offsets([b"%d," % i for i in range(len(encoder.codes.text))])
    return _WORKER[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        source = f.read(MOST_BYTES + 1)
    if len(source) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    return source


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null text has no ids.  Other columns are ignored."""
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(source.value)[0]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                ids = encoder.encode_all(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>")


def bpe_decode(rows: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row; null or no ids give the empty text."""
    ship(rows.sparkSession)
    source = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker(source.value)[1]
        for batch in batches:
            texts = [decoder.text(np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run), "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]): encoding and decoding in one pass, with digests of both.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over
    the decoded text in UTF-8.  A null text counts as empty; repeated rows give
    repeated results.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder, decimal = worker(source.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                all_ids = encoder.encode_all(part.column(1).to_pylist())
                n = [len(ids) for ids in all_ids]
                ids_sha = [hashlib.sha256(decimal.join(ids)[:-1]).hexdigest() for ids in all_ids]
                text_sha = [hashlib.sha256(decoder.text(ids)).hexdigest() for ids in all_ids]
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(all_ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), schema)
