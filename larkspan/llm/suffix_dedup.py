"""Removal of passages that an earlier document holds, by suffix arrays.

A byte goes if a string of ``span`` bytes over it also starts in a document of
smaller id.  Every such string is owned by the k-byte run of smallest hash
inside it, so equal strings have equal owners wherever they stand; a segment is
a run of strings with one owner.  Owners are those smallest hashes mixed once
more: the smallest of many are small numbers, and owners are dealt out by size.

1. Documents give their segments as owner, fingerprint and place.  Equal
   segments are settled by their smallest document, within a partition first,
   so that a passage that very many documents hold asks once a partition.
2. Only owners whose segments differ between documents are left; the smallest
   document of each such segment cuts its bytes.
3. Segments of one owner that differ meet in a suffix array: suffixes smaller
   than their successors are sorted directly, all others are induced from them
   by one scan over the buckets of first bytes; neighbours in the array whose
   common prefix reaches ``span`` hold the same string, and the smallest
   document among them keeps it.
4. The spans found are merged for each document and cut from its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import textvec
from larkspan.llm.common import lean, ship, written

SPAN = 50
GRAM = 16
#: Segments that one partition holds before it settles and sends them.
HELD = 200_000
#: Bytes of text for each bucket of owners, so that a bucket is held in one task however large the input is.
BUCKET = 4_000_000
#: Bytes of segments in one suffix array, unless one owner has more.
ARRAY = 150_000

_U = np.uint64


def owners(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, owner, fingerprint, first byte, end byte) of the segments of a chunk."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none.astype(_U), none.astype(_U), none, none
    up, down = textvec._powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) * up[:n], out=total[1:])
        least = textvec.mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    width, done = span - gram + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + span <= offsets[row + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(_U), none.astype(_U), none, none
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = at[new]
    end = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + span
    with np.errstate(over="ignore"):
        print_ = textvec.mix64((total[end] - total[first]) * down[first] + (end - first).astype(_U))
    return row[first], textvec.mix64(least[first] + _U(1)), print_, first, end


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the numbers by significance, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


#: Columns of a packed block, sorted by owner, which is stored as differences.
_PLACE = (("owner", "<u8"), ("print", "<u8"), ("id", "<i8"), ("version", "<i8"), ("start", "<u4"), ("size", "<u4"))
#: Columns of a packed block of spans that go.
_GOES = _PLACE[2:]
_OWN = "bucket int, settled boolean, payload binary"


def _pack(places: dict[str, np.ndarray], columns: tuple = _PLACE) -> bytes:
    return b"".join(_planes((np.diff(places[k], prepend=_U(0)) if k == "owner" else places[k]).astype(t)) for k, t in columns)


def _unpack(raw: bytes | pa.Buffer, columns: tuple = _PLACE) -> dict[str, np.ndarray]:
    widths = {k: np.dtype(t).itemsize for k, t in columns}
    n, at, out = len(raw) // sum(widths.values()), 0, {}
    for k, t in columns:
        out[k] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, widths[k] * n, at).reshape(widths[k], n).T).view(t).reshape(-1)
        at += widths[k] * n
    if "owner" in out:
        out["owner"] = np.cumsum(out["owner"], dtype=_U)
    return out


def _fused(places: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Places that touch or overlap in one text become one span; the order is that of the texts."""
    places = {k: places[k] for k, _ in _GOES}
    places = _some(places, np.lexsort((places["start"], places["version"], places["id"])))
    if not len(places["id"]):
        return places
    other = np.ones(len(places["id"]), bool)
    other[1:] = (places["id"][1:] != places["id"][:-1]) | (places["version"][1:] != places["version"][:-1])
    shift = (np.cumsum(other) - 1) << 33  # texts one behind the other, further apart than a text is long
    start = places["start"].astype(np.int64) + shift
    end = np.maximum.accumulate(start + places["size"].astype(np.int64))
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    out = _some(places, at)
    out["size"] = np.append(end[at[1:] - 1], end[-1]) - start[at]
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k, _ in _PLACE}


def _some(places: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in places.items()}


def _settle(parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(places of the smallest document of each segment, places of the others, which lose theirs), sorted by owner and fingerprint."""
    places = _joined(parts)
    places = _some(places, np.lexsort((places["start"], places["id"], places["print"], places["owner"])))
    new = np.ones(len(places["id"]), bool)
    new[1:] = (places["owner"][1:] != places["owner"][:-1]) | (places["print"][1:] != places["print"][:-1])
    first = np.flatnonzero(new)
    least = np.repeat(places["id"][first], np.diff(np.append(first, len(new))))
    stays = places["id"] == least
    return _some(places, stays), _some(places, ~stays)


def _own_rows(span: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by bucket of their owner; equal ones of this partition are settled here and only the smallest document's go on."""
        held: list[dict[str, np.ndarray]] = []
        size, turn = 0, TaskContext.get().partitionId() * 1009

        def send() -> pa.RecordBatch:
            nonlocal turn
            go, gone = _settle(held)
            gone = _fused(gone)
            of = go["owner"] // _U((1 << 64) // buckets + 1)
            cut = np.append(np.flatnonzero(np.diff(of, prepend=of[:1] + _U(1))), len(of)).tolist()
            rows = [(int(of[x]), False, _pack({k: v[x:y] for k, v in go.items()})) for x, y in zip(cut, cut[1:], strict=False)]
            for a in range(0, len(gone["id"]), 50_000):
                rows.append(((turn * 0x9E3779B1 >> 7) % buckets, True, _pack({k: v[a : a + 50_000] for k, v in gone.items()}, _GOES)))
                turn += 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["bucket", "settled", "payload"])

        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = textvec.utf8(batch.column(2))
            for a, _, piece, at in textvec.chunks(data, offsets):
                row, owner, print_, first, end = owners(piece, at, span, gram)
                if len(row):
                    held.append({"owner": owner, "print": print_, "id": ids[a + row], "version": versions[a + row], "start": first - at[row], "size": end - first})
                    size += len(row)
                if size >= HELD:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return run


_FOUND = "id long, version long, start int, end int, owners array<bigint>"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (settled, bucket) -> spans that go (without owners), and owners whose segments differ between documents (without a span)."""
    held: list[dict[str, np.ndarray]] = []
    current = None

    def spans(p: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(p["id"])
        return pa.RecordBatch.from_arrays([pa.array(p["id"]), pa.array(p["version"]), pa.array(p["start"].astype(np.int32)), pa.array((p["start"] + p["size"]).astype(np.int32)), pa.nulls(n, pa.list_(pa.int64()))], ["id", "version", "start", "end", "owners"])

    def settle() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        stays, gone = _settle(held)
        if len(gone["id"]):
            yield spans(_fused(gone))
        first = np.flatnonzero(np.diff(stays["owner"], prepend=stays["owner"][:1] + _U(1)))
        several = np.minimum.reduceat(stays["id"], first) < np.maximum.reduceat(stays["id"], first)
        asked = np.repeat(several, np.diff(np.append(first, len(stays["id"]))))
        owner, key = stays["owner"][asked], stays["id"][asked]
        if len(key):
            order = np.argsort(key, kind="stable")
            owner, key = owner[order], key[order]
            first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
            owners_ = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(owner.view(np.int64)))
            none = pa.nulls(len(first), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.nulls(len(first), pa.int64()), none, none, owners_], ["id", "version", "start", "end", "owners"])

    for batch in batches:
        for i, (bucket, settled) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            payload = batch.column(2)[i].as_buffer()
            if settled:
                yield spans(_unpack(payload, _GOES))
                continue
            if bucket != current:
                yield from settle()
                held, current = [], bucket
            held.append(_unpack(payload))
    yield from settle()


_SEGMENT = "owner long, id long, version long, start int, segment binary"


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap become one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], np.append(end[at[1:] - 1], end[-1:])


def _segment_rows(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, version, text, owners) -> the segments of these owners."""
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = textvec.utf8(batch.column(2))
            wanted = batch.column(3)
            for a, _, piece, at in textvec.chunks(data, offsets):
                row, owner, _, first, end = owners(piece, at, span, gram)
                cut = np.searchsorted(row, np.arange(len(at)))
                signed = owner.view(np.int64)
                mine = [np.zeros(0, np.int64)]
                for r in range(len(at) - 1):
                    lo, hi = int(cut[r]), int(cut[r + 1])
                    if lo < hi:
                        mine.append(lo + np.flatnonzero(np.isin(signed[lo:hi], wanted[a + r].values.to_numpy(zero_copy_only=False))))
                at_ = np.concatenate(mine)
                raw, r = piece.tobytes(), row[at_]
                parts = [raw[f:e] for f, e in zip(first[at_].tolist(), end[at_].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed[at_]), pa.array(ids[a + r]), pa.array(versions[a + r]), pa.array((first[at_] - at[r]).astype(np.int32)), pa.array(parts, pa.binary())], ["owner", "id", "version", "start", "segment"])

    return run


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8, no value 255, last value smaller than all) in the order of their first ``depth`` bytes.

    Two stages: suffixes smaller than their successors are sorted directly; the
    others follow from them bucket by bucket.
    """
    n = len(text)
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    run_end = change[np.searchsorted(change, np.arange(n))]
    after = np.append(text, np.uint8(255))[run_end + 1]
    small = after > text  # smaller than its successor; the end counts as such
    direct = np.flatnonzero(small)
    word = _words(text, depth + 8)
    direct = direct[np.lexsort([word[direct + 8 * k] for k in range(-(-depth // 8) - 1, -1, -1)])]
    sorted_cut = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        larger = [wave]
        while len(wave):  # runs of one byte induce within their own bucket
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~small[wave]]
            larger.append(wave)
        bucket = np.concatenate([*larger, direct[sorted_cut[c] : sorted_cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > c) & ~small[before]]
        if len(before):
            order = np.argsort(text[before], kind="stable")
            before = before[order]
            for piece in np.split(before, np.flatnonzero(np.diff(text[before])) + 1):
                induced[text[piece[0]]].append(piece)
    return np.concatenate(out)


def _words(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on as one number, zeros behind the end."""
    padded = np.zeros(len(text) + more + 8, _U)
    padded[: len(text)] = text
    word = np.zeros(len(text) + more, _U)
    for k in range(8):
        word |= padded[k : k + len(word)] << _U(56 - 8 * k)
    return word


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix with the one before it."""
    word = _words(text, depth + 8)
    lcp = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for k in range(0, depth, 8):
        apart = word[order[alive] + k] ^ word[order[alive - 1] + k]
        same = np.full(len(alive), 8)
        odd = np.flatnonzero(apart)
        same[odd] = sum((apart[odd] < _U(1 << (64 - 8 * j))).astype(np.int64) for j in range(1, 8))
        lcp[alive] += same
        alive = alive[apart == 0]
        if not len(alive):
            break
    return np.minimum(lcp, depth)


def earlier_strings(segments: list[bytes], docs: np.ndarray, span: int) -> list[np.ndarray]:
    """For each segment the starts of its strings of ``span`` bytes that a segment of a smaller document holds too."""
    sizes = np.array([len(s) for s in segments])
    joined = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = joined + np.uint8(1)  # UTF-8 has no byte 255
    text[begin + sizes] = 0
    order = suffix_array(text, span)
    which = np.repeat(np.arange(len(sizes)), sizes + 1)
    whole = order + span <= (begin + sizes)[which[order]]
    lcp = common_prefixes(text, order, span)
    # A prefix of span bytes without a separator is in whole suffixes only, so those of a class stand together.
    label = np.cumsum(lcp < span)
    order, label = order[whole], label[whole]
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    if not len(order):
        return found
    start = np.flatnonzero(np.diff(label, prepend=-1))
    doc = docs[which[order]]
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(order))))
    hit = np.sort(order[least < doc])
    cut = np.searchsorted(hit, np.append(begin, len(text)))
    return [hit[cut[i] : cut[i + 1]] - begin[i] for i in range(len(segments))]


def _spans(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(x[0]), int(x[-1]) + span) for x in np.split(starts, cut)] if len(starts) else []


def _removals(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segment rows sorted by owner -> (id, version, start, end) to be removed."""
        out: list[tuple[int, int, int, int]] = []
        group: dict[bytes, list[tuple[int, int, int]]] = {}
        array: list[tuple[bytes, int, list[tuple[int, int, int]]]] = []
        size, current = 0, None

        def settle() -> None:
            nonlocal size
            least = {s: min(p[0] for p in places) for s, places in group.items()}
            for s, places in group.items():
                out.extend((key, version, start, start + len(s)) for key, version, start in places if key > least[s])
            if len(group) > 1:
                array.extend((s, least[s], [p for p in places if p[0] == least[s]]) for s, places in group.items())
                size += sum(len(s) + 1 for s in group)
            group.clear()

        def compare() -> None:
            nonlocal size
            if array:
                hits = earlier_strings([s for s, _, _ in array], np.array([d for _, d, _ in array]), span)
                for (_, _, places), starts in zip(array, hits, strict=True):
                    for a, b in _spans(starts, span):
                        out.extend((key, version, start + a, start + b) for key, version, start in places)
                array.clear()
                size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "version", "start", "end"])

        for batch in batches:
            for owner, key, version, start, segment in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if owner != current:
                    settle()
                    current = owner
                    if size >= ARRAY:
                        compare()
                group.setdefault(segment, []).append((key, version, start))
            yield flush()
        settle()
        compare()
        yield flush()

    return run


#: Rows and bytes of text that are cut and returned together, so that a batch is not held twice over.
ROWS, BYTES = 256, 1_000_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``ROWS`` rows and about ``BYTES`` of text."""
    _, offsets = textvec.utf8(batch.column(1))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, min(row + ROWS, int(np.searchsorted(offsets, offsets[row] + BYTES, "right")) - 1))
        yield batch.slice(row, end - row)
        row = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        data, offsets = textvec.utf8(batch.column(1))
        found = batch.column(2)
        size, removed, spans, digest, kept_text = [], [], [], [], []
        for i in range(batch.num_rows):
            raw = data[offsets[i] : offsets[i + 1]]
            keep, runs = raw, []
            if found[i].is_valid and len(found[i].values):
                x = found[i].values
                start, end = x.field("start").to_numpy(), x.field("end").to_numpy()
                runs = list(zip(*(y.tolist() for y in _merged(start, end)), strict=True))
                mask = np.ones(len(raw), bool)
                for lo, hi in runs:
                    mask[lo:hi] = False
                keep = raw[mask]
            size.append(len(raw))
            removed.append(len(raw) - len(keep))
            spans.append(len(runs))
            kept_text.append(keep.tobytes())
            digest.append(hashlib.sha256(kept_text[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row of ``docs``.

    A null text counts as empty.  Rows that repeat an id are versions of one
    document: each keeps what no smaller id holds.  A row with a null id keeps
    everything and takes part in nothing.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = rows.where("id IS NOT NULL")
    seen = named.select("id", F.octet_length("text").alias("bytes")).groupBy("id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).agg(F.max("rows"), F.sum("bytes")).first()
    repeated, buckets = (seen[0] or 0) > 1, max(16, -(-(seen[1] or 0) // BUCKET))
    version = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    texts = named.select("id", "text")
    own = texts.select("id", version.alias("version"), "text").mapInArrow(lean(_own_rows(span, gram, buckets)), _OWN)
    found = written(own.repartition("bucket").sortWithinPartitions("settled", "bucket").mapInArrow(lean(_settled), _FOUND), "spans")
    marks = found.where("owners IS NOT NULL").groupBy("id").agg(F.flatten(F.collect_list("owners")).alias("owners"))
    segments = texts.join(marks, "id").select("id", version.alias("version"), "text", "owners").mapInArrow(lean(_segment_rows(span, gram)), _SEGMENT)
    removals = segments.repartition("owner").sortWithinPartitions("owner").mapInArrow(lean(_removals(span)), "id long, version long, start int, end int")
    removals = removals.unionByName(found.where("owners IS NULL").drop("owners"))
    merged = removals.groupBy("id").agg(F.collect_list(F.struct("version", "start", "end")).alias("found"))
    mine = F.filter("found", lambda x: x["version"] == version)
    rest = rows.where("id IS NULL").select("id", "text", F.lit(None).cast("array<struct<version:bigint,start:int,end:int>>").alias("found"))
    joined = texts.join(merged, "id", "left").select("id", "text", mine.alias("found")).unionByName(rest)
    return joined.mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
