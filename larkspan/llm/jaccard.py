"""N-gram Jaccard join by vertical partitioning.

1. Every partition counts its shingles into a fixed number of slots; slots
   sorted by total count give one global order of all shingles (slot rank,
   hash), rarest first.  The order is right for any counts, exact or not.
2. Documents with equal shingle sets form one class; its smallest id stands
   for it.
3. The global order is cut into fragments of equal mass; the overlap of a pair
   is counted for each fragment separately and summed for each pair.  This, and
   nothing else, decides whether a pair links.
4. Likely copies meet first: classes with an equal minimum of one of a few hash
   functions are compared with a leader, within a partition before anything
   moves, so that a group of any size sends some leaders a partition and one
   pair a member.  What links carries one label from here on.
5. Two sets can only reach the threshold if they share a shingle of their
   prefixes in the global order.  Only shingles under which two labels stand
   are buckets; in a bucket only members of different labels are compared, by
   size and by an odd sketch (parity bits: the Hamming distance never exceeds
   the symmetric difference, so no linked pair is lost).  A dense bucket first
   gives a spanning forest only, of the nearest pairs by the sketch; forests
   are taken again with the wide sketch, over the labels that are then left,
   while they join any; all pairs between labels that are still apart follow
   at the end.  So the pairs do not grow with the square of a linked group,
   and a bucket of very many members is dealt over blocks.
   A wide sketch (two to four bits a shingle) then leaves few pairs that do
   not link, before any token set is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import textvec
from larkspan.llm.common import discard, lean, ship, summed, sums, unused, written
from larkspan.llm.components import components

#: Fixed number of counters that one partition sends, and that the driver holds.
SLOTS = 1 << 16
FRAGMENTS = 16
#: A bucket with more candidate pairs than this many times its members is dense.
DENSE = 1
#: Rounds of forests by the wide sketch before all pairs between labels that are still apart are compared; more rounds only save pairs.
FORESTS = 2
#: Rows compared with the rest of a bucket at a time.
BLOCK = 256
#: Rows of a bucket up to which its pairs are formed together with those of other buckets.
SMALL = 48
#: Members of a bucket, on average, from which it is dealt over blocks, each pair of which is a task's own.
SPLIT = 8192
#: Leaders that a class is held against for each of its minima; these only save work, as the prefixes find every link that is missed here.
LEADERS = 8
#: Classes that one partition compares before it sends their leaders.
HELD = 50_000
#: Bits of the bitmap that filters documents before a join; fixed, so it is always small.
BITMAP = 1 << 23

#: Least bits of a sketch; all narrow and wide ones are multiples by powers of two.
NARROW = 256

_U = np.uint64
#: Odd factors: the least product over a set is one minimum of it each.
_MINIMA = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], _U)


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(48)).astype(np.int64) % SLOTS


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    data, offsets = textvec.utf8(batch.column(1))
    for a, _, piece, at in textvec.chunks(data, offsets):
        h, _, _, before = textvec.words(piece, at)
        yield from zip(ids[a:], textvec.shingles(h, before, size), strict=False)


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall into each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, tokens in _sets(batch, size):
                total += np.bincount(_slots(tokens), minlength=SLOTS) if len(tokens) > SLOTS // 8 else 0
                if len(tokens) <= SLOTS // 8:
                    np.add.at(total, _slots(tokens), 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["slot", "n"])

    rows = docs.mapInArrow(lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows at most
    total = np.zeros(SLOTS, np.int64)
    for slot, n in rows:
        total[slot] = n
    return total


def _least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap of a set of n with any set that it can link with."""
    return -(-n * percent // 100)


def _sum(tokens: np.ndarray) -> int:
    return int(textvec.mix64(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64))


def profiles(docs: DataFrame, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(id, n, s1, s2, prefix, odd, wide, minima) of each document: s1, s2 identify its set; odd and wide are its sketches."""
    order = docs.sparkSession.sparkContext.broadcast(ranks.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = order.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for key, tokens in _sets(batch, size):
                n = len(tokens)
                slot = ranks[_slots(tokens)]
                keep = n - int(_least_overlap(n, percent)) + 1 if n else 0
                if keep < n:
                    near = np.flatnonzero(slot <= np.partition(slot, keep - 1)[keep - 1]) if keep else np.zeros(0, np.int64)
                    near = near[np.lexsort((tokens[near], slot[near]))][:keep]
                else:
                    near = np.arange(n)
                bits = NARROW
                while bits < 8192 and bits < n // 4:
                    bits *= 2
                many = bits
                while many < 2 * n:
                    many *= 2
                mixed = textvec.mix64(tokens)
                wide = np.packbits((np.bincount((mixed % _U(many)).astype(np.int64), minlength=many) & 1).astype(np.uint8)).tobytes()
                with np.errstate(over="ignore"):
                    sums = _sum(tokens), int(textvec.mix64(tokens + _U(0x14057B7EF767814F)).sum(dtype=_U).view(np.int64))
                    minima = np.array([(mixed * m).min() for m in _MINIMA] if n else [], _U).tobytes()
                for column, x in zip(out, (key, n, *sums, tokens[near].tobytes(), _fold(wide, bits).tobytes(), wide, minima), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["id", "n", "s1", "s2", "prefix", "odd", "wide", "minima"])

    return docs.mapInArrow(lean(run), "id long, n long, s1 long, s2 long, prefix binary, odd binary, wide binary, minima binary")


class _Forest:
    """Union-find; ``join`` tells whether two nodes were apart."""

    def __init__(self, root: list[int]):
        self.root = root

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        u, v = self.find(x), self.find(y)
        self.root[max(u, v)] = min(u, v)
        return u != v


def _led(keys: np.ndarray, ns: np.ndarray, odds: list[bytes], narrow: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (leader, row) of likely copies in the groups of equal keys; rows come sorted by key and size."""
    rest = np.arange(len(keys))
    for _ in range(LEADERS):
        new = np.ones(len(rest), bool)
        new[1:] = keys[rest[1:]] != keys[rest[:-1]]
        lead = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
        at = np.flatnonzero(~new)
        p, q = lead[at], rest[at]
        near = np.bitwise_count(narrow[p] ^ narrow[q]).sum(axis=1, dtype=np.int64) * (100 + percent) <= (ns[p] + ns[q]) * (100 - percent)
        near &= ns[p] * 100 >= ns[q] * percent
        for k in np.flatnonzero(near).tolist():
            if len(odds[p[k]]) * 8 > NARROW and len(odds[q[k]]) * 8 > NARROW:
                near[k] = _near(odds[p[k]], odds[q[k]], int(ns[p[k]] + ns[q[k]]), percent)
        if near.any():
            yield p[near], q[near]
        rest = np.delete(rest, np.concatenate([np.flatnonzero(new), at[near]]))
        if not len(rest):
            return


def _narrow(odds: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x if len(x) * 8 == NARROW else _fold(x, NARROW).tobytes() for x in odds), _U).reshape(len(odds), -1)


_LEAD = "key long, id long, s long, n long, odd binary, leader long, leader_s long, leader_n long"
_LEAD_NAMES = [c.split()[0] for c in _LEAD.split(", ")]


def _local_leaders(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes (id, s, n, odd, minima) -> pairs within a partition (leader set), and one row for each minimum of each tree of these pairs."""
        held: list[pa.RecordBatch] = []

        def settle() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            ids, ss, ns = (rows.column(i).to_numpy() for i in range(3))
            odds = rows.column(3).to_pylist()
            minima = np.frombuffer(b"".join(rows.column(4).to_pylist()), _U).reshape(-1, len(_MINIMA))
            narrow, forest = _narrow(odds), _Forest(list(range(len(ids))))
            pairs: list[tuple[int, int]] = []
            orders = [np.lexsort((ids, ns, minima[:, m])) for m in range(len(_MINIMA))]
            for m, o in enumerate(orders):
                for p, q in _led(minima[o, m], ns[o], [odds[i] for i in o.tolist()], narrow[o], percent):
                    pairs.extend((x, y) for x, y in zip(o[p].tolist(), o[q].tolist(), strict=True) if forest.join(x, y))
            if pairs:
                p, q = np.array(pairs).T
                none = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(ids[q]), pa.array(ss[q]), pa.array(ns[q]), pa.nulls(len(p), pa.binary()), pa.array(ids[p]), pa.array(ss[p]), pa.array(ns[p])], _LEAD_NAMES)
            root = np.array([forest.find(i) for i in range(len(ids))])
            for m, o in enumerate(orders):
                key, tree = minima[o, m], root[o]
                again = np.lexsort((np.arange(len(o)), tree, key))
                new = np.ones(len(o), bool)
                new[1:] = (key[again[1:]] != key[again[:-1]]) | (tree[again[1:]] != tree[again[:-1]])
                at = o[again[new]]
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(textvec.mix64(minima[at, m] + _U(m)).view(np.int64)), pa.array(ids[at]), pa.array(ss[at]), pa.array(ns[at]), pa.array([odds[i] for i in at.tolist()], pa.binary()), none, none, none], _LEAD_NAMES)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield from settle()
        if held:
            yield from settle()

    return run


def _global_leaders(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaders sorted by key and size -> pairs between partitions."""
        for rows in _buckets(batches):
            keys, ids, ss, ns = (rows.column(i).to_numpy() for i in range(4))
            odds = rows.column(4).to_pylist()
            for p, q in _led(keys, ns, odds, _narrow(odds), percent):
                yield _pair_rows(ids[p], ss[p], ns[p], ids[q], ss[q], ns[q])

    return run


_PAIR = "a long, sa long, na long, b long, sb long, nb long"
_PAIR_NAMES = [c.split()[0] for c in _PAIR.split(", ")]


def _pair_rows(*columns: np.ndarray) -> pa.RecordBatch:
    """Pairs of different ids, the smaller one first."""
    swap, apart = columns[0] > columns[3], pa.array(columns[0] != columns[3])
    left, right = columns[:3], columns[3:]
    put = [np.where(swap, y, x) for x, y in zip(left, right, strict=True)] + [np.where(swap, x, y) for x, y in zip(left, right, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in put], _PAIR_NAMES).filter(apart)


def likely_pairs(stands: DataFrame, percent: int, keep: Callable = written) -> DataFrame:
    """(a, sa, na, b, sb, nb): pairs of classes that are most likely copies, a few for each class at most."""
    local = keep(stands.select("id", "s", "n", "odd", "minima").mapInArrow(lean(_local_leaders(percent)), _LEAD), "leaders")
    here = local.where("leader IS NOT NULL").selectExpr("id", "s", "n", "leader", "leader_s", "leader_n").selectExpr(
        "least(id, leader) AS a", "if(id < leader, s, leader_s) AS sa", "if(id < leader, n, leader_n) AS na", "greatest(id, leader) AS b", "if(id < leader, leader_s, s) AS sb", "if(id < leader, leader_n, n) AS nb"
    ).where("a <> b")
    between = local.where("leader IS NULL").select("key", "id", "s", "n", "odd").repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(lean(_global_leaders(percent)), _PAIR)
    return here.unionByName(between).distinct()


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefixes = batch.column(4).to_pylist()
        at = np.repeat(np.arange(batch.num_rows), [len(p) // 8 for p in prefixes])
        tokens = np.frombuffer(b"".join(prefixes), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), *(batch.column(i).take(pa.array(at)) for i in range(4))], ["token", "id", "s", "n", "label"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of whole groups of column 0; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[-1].as_py() != token[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(token, token[-1])) if token[0] <= token[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _fold(odd: bytes, to: int) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(odd, np.uint8))
    return np.packbits(np.bitwise_xor.reduce(x.reshape(-1, to), axis=0))


def _distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two sketches; the longer one is folded."""
    u, v, bits = int.from_bytes(x), int.from_bytes(y), 8 * min(len(x), len(y))
    return (_halved(u, 8 * len(x), bits) ^ _halved(v, 8 * len(y), bits)).bit_count()


def _near(x: bytes, y: bytes, both: int, percent: int) -> bool:
    """Whether two sketches allow that their sets, of ``both`` tokens together, link."""
    return _distance(x, y) * (100 + percent) <= both * (100 - percent)


def _halved(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def _allowed(p: np.ndarray, q: np.ndarray, ns: np.ndarray, narrow: np.ndarray, odds: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the index pairs that the sketches allow, at 256 bits first and then at the width that both have, and their distances as shares of both sets."""
    apart, both = np.bitwise_count(narrow[p] ^ narrow[q]).sum(axis=1, dtype=np.int64), ns[p] + ns[q]
    near = np.flatnonzero(apart * (100 + percent) <= both * (100 - percent))
    p, q, apart, both = p[near], q[near], apart[near], both[near]
    for k, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        if len(odds[x]) * 8 > NARROW and len(odds[y]) * 8 > NARROW:
            apart[k] = _distance(odds[x], odds[y])
    keep = apart * (100 + percent) <= both * (100 - percent)
    return p[keep], q[keep], apart[keep] / both[keep]


def _blocks(a: int, b: int, ns: np.ndarray, labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, by size) of the bucket a to b that labels and sizes allow, so many at a time."""
    top = a + np.searchsorted(ns[a:b], ns[a:b] * 100 // percent, "right")
    for c in range(a, b, BLOCK):
        d = min(c + BLOCK, b)
        most = int(top[c - a : d - a].max())
        for e in range(c, most, 8 * BLOCK):
            f = min(e + 8 * BLOCK, most)
            asked = (np.arange(e, f)[None, :] > np.arange(c, d)[:, None]) & (np.arange(e, f)[None, :] < top[c - a : d - a, None]) & (labels[c:d, None] != labels[None, e:f])
            i, j = np.nonzero(asked)
            for g in range(0, len(i), 1 << 16):
                yield i[g : g + (1 << 16)] + c, j[g : g + (1 << 16)] + e


def _small(bucket: np.ndarray, size: np.ndarray, ns: np.ndarray, labels: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of all buckets of at most ``SMALL`` rows together, by distance."""
    for gap in range(1, SMALL):
        p = np.flatnonzero((bucket[gap:] == bucket[:-gap]) & (size[gap:] <= SMALL))
        if not len(p):
            return
        ok = (labels[p] != labels[p + gap]) & (ns[p] * 100 >= ns[p + gap] * percent)
        yield p[ok], p[ok] + gap


_CANDIDATE = "a long, sa long, na long, partners array<struct<b:long,sb:long,nb:long>>, dense long"


def _pairs(percent: int, last: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, id, s, n, odd, label) sorted by bucket and n -> candidate pairs; dense: the bucket, if it holds more.

        A pair is an entry among the partners of one of its ends, so that no
        table of pairs grows with the number of buckets in which both stand.
        """
        for rows in _buckets(batches):
            bucket, ids, ss, ns, labels = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            odds = rows.column(4).to_pylist()
            narrow = _narrow(odds)
            start = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
            count = np.diff(np.append(start, len(bucket)))
            size = np.repeat(count, count)
            found = [_allowed(p, q, ns, narrow, odds, percent) for p, q in _small(bucket, size, ns, labels, percent)]
            none = np.zeros(0, np.int64)
            p, q, far = (np.concatenate(x) for x in (zip(*found, strict=True) if found else ((none,), (none,), (none,))))
            dense = np.zeros(len(p), bool)
            if not last and len(p):
                of = np.searchsorted(start, p, "right") - 1
                many = np.bincount(of, minlength=len(start)) > DENSE * count
                dense = many[of]
                tree = _tree(p[dense], q[dense], far[dense], labels, bucket)
                p, q = np.append(p[~dense], p[dense][tree]), np.append(q[~dense], q[dense][tree])
                dense = np.arange(len(p)) >= len(p) - len(tree)
            out = [(p, q, dense)]
            for k in np.flatnonzero(count > SMALL).tolist():
                p, q, is_dense = _large(int(start[k]), int(start[k] + count[k]), ns, labels, bucket, narrow, odds, last, percent)
                out.append((p, q, np.full(len(p), is_dense)))
            p, q, dense = (np.concatenate(x) for x in zip(*out, strict=True))
            yield from _partner_rows(ids, ss, ns, p, q, np.where(dense, bucket[p], 0))

    return run


def _partner_rows(ids: np.ndarray, ss: np.ndarray, ns: np.ndarray, p: np.ndarray, q: np.ndarray, dense: np.ndarray) -> Iterator[pa.RecordBatch]:
    swap = ids[p] > ids[q]
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    apart = ids[p] != ids[q]
    p, q, dense = p[apart], q[apart], dense[apart]
    if not len(p):
        return
    order = np.lexsort((q, dense, ss[p], ids[p]))
    p, q, dense = p[order], q[order], dense[order]
    new = np.ones(len(p), bool)
    new[1:] = (ids[p[1:]] != ids[p[:-1]]) | (ss[p[1:]] != ss[p[:-1]]) | (dense[1:] != dense[:-1])
    at = np.flatnonzero(new)
    partners = pa.StructArray.from_arrays([pa.array(ids[q]), pa.array(ss[q]), pa.array(ns[q])], ["b", "sb", "nb"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(p)), pa.int32()), partners)
    yield pa.RecordBatch.from_arrays([pa.array(ids[p[at]]), pa.array(ss[p[at]]), pa.array(ns[p[at]]), lists, pa.array(dense[at])], ["a", "sa", "na", "partners", "dense"])


def _tree(p: np.ndarray, q: np.ndarray, far: np.ndarray, labels: np.ndarray, bucket: np.ndarray) -> list[int]:
    """Numbers of pairs that span, over the labels, what all pairs of their buckets connect: the nearest ones, which are likeliest to link."""
    nodes: dict[tuple[int, int], int] = {}
    order = np.argsort(far, kind="stable")
    ends = [[nodes.setdefault(x, len(nodes)) for x in zip(bucket[side].tolist(), labels[side].tolist(), strict=True)] for side in (p[order], q[order])]
    forest = _Forest(list(range(len(nodes))))
    return [k for k, x, y in zip(order.tolist(), *ends, strict=True) if forest.join(x, y)]


def _large(a: int, b: int, ns: np.ndarray, labels: np.ndarray, bucket: np.ndarray, narrow: np.ndarray, odds: list[bytes], last: bool, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one large bucket to be verified; True: only a spanning forest, over the labels, of all of them."""
    none = np.zeros(0, np.int64)
    p, q, far, dense, total = none, none, none, False, 0
    for x, y in _blocks(a, b, ns, labels, percent):
        x, y, z = _allowed(x, y, ns, narrow, odds, percent)
        p, q, far, total = np.append(p, x), np.append(q, y), np.append(far, z), total + len(x)
        if not last and (dense or total > DENSE * (b - a)):
            dense, tree = True, _tree(p, q, far, labels, bucket)
            p, q, far = p[tree], q[tree], far[tree]
    return p, q, dense


def _paired(rows: DataFrame) -> DataFrame:
    """(a, sa, na, b, sb, nb), each pair once, from ``_CANDIDATE`` rows."""
    gathered = rows.groupBy("a", "sa", "na").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    return gathered.select("a", "sa", "na", F.inline("partners"))


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted hashes as differences, bytes by significance, so that the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(np.diff(tokens, prepend=_U(0)).view(np.uint8).reshape(len(tokens), 8).T).tobytes()


def _unpacked(raw: bytes | pa.Buffer) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    return np.cumsum(np.ascontiguousarray(x.reshape(8, len(x) // 8).T).view(_U).reshape(-1), dtype=_U)


def fragments(docs: DataFrame, size: int, of_rank: np.ndarray, maybe: Broadcast) -> DataFrame:
    """(id, s, fragment, tokens binary) of each document that the bitmap ``maybe`` cannot rule out: its set, cut along the global order.

    The bitmap only saves work; the join by id and set that follows is what decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(of_rank.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0))
            batch = batch.filter(pa.array((maybe.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            ids, sets, frags, parts = [], [], [], []
            for key, tokens in _sets(batch, size):
                frag, s = shared.value[_slots(tokens)], _sum(tokens)
                order = np.argsort(frag, kind="stable")
                cut = np.searchsorted(frag[order], np.arange(FRAGMENTS + 1))
                for f in range(FRAGMENTS):
                    if cut[f] < cut[f + 1]:
                        ids.append(key)
                        sets.append(s)
                        frags.append(f)
                        parts.append(_packed(tokens[order[cut[f] : cut[f + 1]]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(frags, pa.int32()), pa.array(parts, pa.binary())], ["id", "s", "fragment", "tokens"])

    return docs.mapInArrow(lean(run), "id long, s long, fragment int, tokens binary")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both token sets of a fragment -> the same with the overlap k instead of the sets."""
    for batch in batches:
        k = [len(np.intersect1d(_unpacked(x.as_buffer()), _unpacked(y.as_buffer()), assume_unique=True)) for x, y in zip(batch.column(6), batch.column(7), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(k, pa.int64()), batch.column(8)], [*_PAIR_NAMES, "k", "fragment"])


def _bitmap(ids: DataFrame) -> Broadcast:
    """A bitmap of fixed size with the place of every id set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(BITMAP // 8, np.uint8)
        for batch in batches:
            at = _place(batch.column(0))
            np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from sums({b: bitmap[b * 4096 : (b + 1) * 4096] for b in range(len(bitmap) // 4096)})

    found = summed(ids, mark, "u1", "or")
    bitmap = np.concatenate([found.get(b, np.zeros(4096, np.uint8)) for b in range(BITMAP // 8 // 4096)])
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def _place(ids: pa.Array) -> np.ndarray:
    return (textvec.mix64(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) % _U(BITMAP)).astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, size: int, of_rank: np.ndarray, percent: int, keep: Callable = written) -> DataFrame:
    """The pairs (a, sa, na, b, sb, nb) that link, as (a, b): overlaps counted by fragment, then summed.

    A text that several rows repeat under one id gives its fragments several
    times over; one row of each is taken.
    """
    # Both ends read the fragments from one table: they are cut once, and no task holds a second Python worker for them.
    parts = keep(fragments(docs, size, of_rank, _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("id")))), "fragments")
    asked = pairs.select(*_PAIR_NAMES, F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    left = asked.join(parts.withColumnsRenamed({"id": "a", "s": "sa", "tokens": "ta"}), ["a", "sa", "fragment"])
    both = left.join(parts.withColumnsRenamed({"id": "b", "s": "sb", "tokens": "tb"}), ["b", "sb", "fragment"])
    partial = both.select(*_PAIR_NAMES, "ta", "tb", "fragment").mapInArrow(lean(_overlaps), f"{_PAIR}, k long, fragment int")
    summed_ = partial.groupBy(*_PAIR_NAMES, "fragment").agg(F.max("k").alias("k")).groupBy(*_PAIR_NAMES).agg(F.sum("k").alias("k"))
    return summed_.where(f"100 * k >= {percent} * (na + nb - k)").select("a", "b").distinct()


def narrowed(pairs: DataFrame, stands: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, sa, na, b, sb, nb) that the wide sketches of ``stands`` (id, s, wide) allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column(2).to_numpy() + batch.column(5).to_numpy()).tolist()
            near = [_near(x, y, n, percent) for x, y, n in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), both, strict=True)]
            yield batch.select(range(6)).filter(pa.array(near, pa.bool_()))

    for c in ("a", "b"):
        pairs = pairs.join(stands.selectExpr(f"id AS {c}", f"s AS s{c}", f"wide AS w{c}"), [c, f"s{c}"])
    return pairs.select(*_PAIR_NAMES, "wa", "wb").mapInArrow(lean(run), _PAIR).distinct()


def _labelled(stands: DataFrame, links: DataFrame | None) -> DataFrame:
    """``stands`` with the smallest id that each reaches by ``links`` as label."""
    if links is None:
        return stands.withColumn("label", F.col("id"))
    return stands.join(components(links).selectExpr("node AS id", "root AS label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def bucket_rows(stands: DataFrame, keep: Callable = written) -> DataFrame:
    """(bucket, id, s, n) of the prefix shingles under which classes of different labels stand.

    The shingles are counted and their labels compared map-side, so one that
    very many copies of one label share costs one row a partition and goes.
    A bucket of over ``SPLIT`` members is dealt over blocks; every pair of
    blocks is a bucket of its own.
    """
    rows = stands.select("id", "s", "n", "label", "prefix").mapInArrow(lean(_prefix_rows), "token long, id long, s long, n long, label long")
    counted = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).where("low < high")
    tokens = keep(counted.selectExpr("token", f"CAST(ceil(rows / {SPLIT}) AS INT) AS blocks"), "tokens")
    mine = rows.drop("label").join(tokens, "token").withColumn("block", F.expr("CAST(pmod(xxhash64(id, s), blocks) AS INT)"))
    cells = F.expr("explode(transform(sequence(0, blocks - 1), x -> xxhash64(token, least(x, block), greatest(x, block))))")
    return keep(mine.select(cells.alias("bucket"), "id", "s", "n"), "buckets")


def ngram_jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; linked means 100 * overlap >= percent * union.

    A null or wordless text has no shingles and links with nothing.  Fewer
    words than ``size``: the whole sequence is the one shingle.  Rows that
    repeat an id count as that document each; rows with a null id are returned
    with their size and a null component.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = slot_counts(docs, size)
    order = np.lexsort((np.arange(SLOTS), counts))
    ranks = np.empty(SLOTS, np.int64)
    ranks[order] = np.arange(SLOTS)
    mass = np.cumsum(counts[order])
    of_rank = np.empty(SLOTS, np.int64)
    of_rank[order] = np.minimum((mass - counts[order]) * FRAGMENTS // max(int(mass[-1]), 1), FRAGMENTS - 1)

    profile = written(profiles(docs, size, percent, ranks), "profiles")
    stands = profile.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "prefix", "odd", "wide", "minima")).alias("least"))
    stands = written(stands.select("least.*", "n", F.col("s1").alias("s"), "s2"), "classes")
    spent: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A table that goes when the links are known."""
        spent.append(written(df, name))
        return spent[-1]

    def linked(pairs: DataFrame, more: DataFrame | None) -> DataFrame:
        found = verified(pairs, docs, size, of_rank, percent, keep)
        return keep(found if more is None else more.unionByName(found), "links")

    links = linked(keep(likely_pairs(stands, percent, keep), "pairs"), None)
    named = keep(_labelled(stands, links), "labelled")
    buckets = bucket_rows(named, keep)

    def candidates(labels: DataFrame, rows: DataFrame, sketch: str, last: bool) -> DataFrame:
        full = rows.join(labels.selectExpr("id", "s", f"{sketch} AS odd", "label"), ["id", "s"]).select("bucket", "id", "s", "n", "odd", "label")
        return full.repartition("bucket").sortWithinPartitions("bucket", "n", "id").mapInArrow(lean(_pairs(percent, last)), _CANDIDATE)

    def dense(found: DataFrame) -> DataFrame:
        return found.where("dense <> 0").select(F.col("dense").alias("bucket")).distinct()

    found = keep(candidates(named, buckets, "odd", False), "pairs")
    if not found.isEmpty():
        links = linked(keep(narrowed(_paired(found), stands, percent), "pairs"), links)
        forests, apart = 0, named.where("label <> id").count()
        while not (some := dense(found)).isEmpty():
            named, before = keep(_labelled(stands, links), "labelled"), apart
            apart = named.where("label <> id").count()
            last = forests == FORESTS or apart == before
            found = keep(candidates(named, buckets.join(some, "bucket", "left_semi"), "wide", last), "pairs")
            links = linked(keep(_paired(found), "pairs"), links)
            forests += 1
    # An id that is repeated with several sets is one document: it links the classes that these sets are in.
    several = profile.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high").select("id")
    if not several.isEmpty():
        own = profile.join(several, "id").select("id", "n", "s1", "s2").join(stands.selectExpr("id AS stands", "n", "s AS s1", "s2"), ["n", "s1", "s2"])
        links = keep(links.unionByName(own.where("id <> stands").selectExpr("least(id, stands) AS a", "greatest(id, stands) AS b").distinct()), "links")
    labelled = _labelled(stands, links)
    discard(*spent)
    rooted = labelled.selectExpr("n", "s AS s1", "s2", "label AS root")
    return profile.join(rooted, ["n", "s1", "s2"], "left").selectExpr("id AS doc_id", "n AS n_shingles", "CASE WHEN id IS NULL THEN NULL ELSE coalesce(root, id) END AS component_id")


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest id of each group of linked documents.

    Rows with a null id stay, and so do texts without a word; rows that repeat
    an id stay or go together; an empty table gives an empty one.  Columns of
    any name are allowed.
    """
    key = unused(docs, "gone")
    found = ngram_jaccard_join(docs, size, percent, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
