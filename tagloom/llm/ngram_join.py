"""N-gram Jaccard join with signature trees.

A document's set holds its distinct 5-word shingles; two documents link when
100 * |intersection| >= 80 * |union|.

Routing (exact).  In any fixed order of all shingles, two sets that link share
one of their first n - ceil(0.8 n) + 1.  The order is: shingles that are
frequent in a bounded sample last, then by hash; the sample only shapes the
order, so it decides how much work there is and never what is found.  A
partition packs its prefix entries for each bucket of the hash space: shingles,
keys and sizes of sets, equal sets once.  A bucket finds the groups of sets that
share a shingle; equal groups (near copies share many) become one, and only their
sets get counting bitmaps, so what travels doesn't grow with the buckets.

Pruning.  The sets of such a group are compared by a signature
tree: its nodes hold the OR of their sets' bitmaps (unary counters, so the OR is
the largest count of each cell) and the range of sizes.  A dual traversal drops
a pair of nodes when the overlap that sizes and bitmaps allow is too small, and
when both are already connected.  What is left is a spanning forest of pairs
that may link, not the pairs.

Verification.  The forest's components are small groups of texts that may be
near copies; each is read once (one text for equal sets) and joined exactly by
the same tree.  A group of more than ``block`` sets is split into blocks, whose
texts are packed and compressed once: first every block meets one pivot block,
then only what isn't yet in the group's largest component meets all blocks, so a
dense group of any size costs about one pass.

Hot keys.  Up to ``_LEAF // 2`` sets that share a shingle are one leaf; the leaves'
pairs are tested together.  Copies of one set are one row before any join; joins
by set or by group deal keys with many rows over several tasks.

Nulls and odd rows: a text without words has an empty set and no links; a null
id has a null component and no links; rows that repeat an id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C
from tagloom.llm import components as G

WORDS = 5
CELLS, LONG, LONG_CELLS = 64, 1024, 512  #: cells of a bitmap; sets from LONG shingles on have a finer one, too
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000  #: sets, and shingles, of a verification block
_LEAF = 16
_TEXTS = 2_000_000  #: bytes of text that become arrays at a time; no text is cut


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    size, lo = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _TEXTS, "right")))
        words, first = C.word_hashes(*C.string_buffers(texts.slice(lo, hi - lo)), lower=True)
        windows = C.window_hashes(words, width)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if z - a >= width:
                yield np.unique(windows[a : z - width + 1])
            elif z > a:
                yield C.window_hashes(words[a:z], z - a) ^ np.uint64(0xABCDEF0123456789 + z - a)
            else:
                yield np.zeros(0, np.uint64)
        lo = hi


def set_hash(s: np.ndarray) -> np.int64:
    return C.mix(np.array([C.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]


def bitmap(s: np.ndarray, cells: int) -> np.ndarray:
    return np.minimum(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 + percent) * overlap >= percent * (a + b)


class Signatures:
    """Sizes and bitmaps of some sets."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, long_index: np.ndarray, long_maps: np.ndarray):
        self.sizes, self.maps, self.long_index, self.long_maps = sizes.astype(np.int64), maps, long_index, long_maps
        self.slack = self.sizes - maps.sum(axis=1, dtype=np.int64)  # what clipped counters don't show

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Signatures:
        sizes = np.array([len(s) for s in sets], np.int64)
        long = np.flatnonzero(sizes >= LONG)
        index = np.full(len(sets), -1, np.int64)
        index[long] = np.arange(len(long))
        return cls(sizes, np.stack([bitmap(s, CELLS) for s in sets]) if sets else np.zeros((0, CELLS), np.uint8), index, np.stack([bitmap(sets[i], LONG_CELLS) for i in long]) if len(long) else np.zeros((0, LONG_CELLS), np.uint8))

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether sizes and bitmaps allow each pair enough overlap."""
        a, b = self.sizes[i], self.sizes[j]
        ok = enough(np.minimum(a, b), a, b, percent)
        for lo in range(0, len(i), 50_000):
            k = np.flatnonzero(ok[lo : lo + 50_000]) + lo
            most = np.minimum(self.maps[i[k]], self.maps[j[k]]).sum(axis=1, dtype=np.int64) + np.minimum(self.slack[i[k]], self.slack[j[k]])
            ok[k] = enough(most, a[k], b[k], percent)
            k = k[ok[k] & (self.long_index[i[k]] >= 0) & (self.long_index[j[k]] >= 0)]
            x, y = self.long_maps[self.long_index[i[k]]], self.long_maps[self.long_index[j[k]]]
            slack = np.minimum(a[k] - x.sum(axis=1, dtype=np.int64), b[k] - y.sum(axis=1, dtype=np.int64))
            ok[k] = enough(np.minimum(x, y).sum(axis=1, dtype=np.int64) + slack, a[k], b[k], percent)
        return ok


class Forest:
    """Union-find over sets, and the links that joined something."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.edges.append((x, y))
        return True


class Node:
    """Some sets: the OR of their bitmaps, the range of their sizes, and two children or the sets themselves."""

    def __init__(self, members: np.ndarray, sig: Signatures):
        self.members, self.whole = members, None
        sizes = sig.sizes[members]
        self.low, self.high, self.slack = int(sizes.min()), int(sizes.max()), int(sig.slack[members].max())
        if len(members) <= _LEAF:
            self.parts, self.map = (), sig.maps[members].max(axis=0)
        else:
            half = len(members) // 2
            self.parts = (Node(members[:half], sig), Node(members[half:], sig))
            self.map = np.maximum(self.parts[0].map, self.parts[1].map)

    def root(self, forest: Forest) -> int | None:
        """The component that all of it lies in, if it is one."""
        if self.whole is None:
            if self.parts:
                found = {p.root(forest) for p in self.parts}
            else:
                found = {forest.find(int(m)) for m in self.members}
            if len(found) == 1 and None not in found:
                self.whole = found.pop()
        return None if self.whole is None else forest.find(self.whole)

    def may_link(self, other: Node, percent: int) -> bool:
        low, high = (self, other) if self.high <= other.high else (other, self)
        if 100 * low.high < percent * high.low:  # all of one side are too small for the other
            return False
        most = int(np.minimum(self.map, other.map).sum(dtype=np.int64)) + min(self.slack, other.slack)
        return (100 + percent) * min(most, self.high, other.high) >= percent * (self.low + other.low)


def dual(a: Node, b: Node, sig: Signatures, forest: Forest, percent: int, links=None) -> None:
    """Joins, in ``forest``, the sets that may link (or, with ``links(i, j)``, that do)."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x.may_link(y, percent):
            continue
        if (r := x.root(forest)) is not None and r == y.root(forest):
            continue
        if x.parts or y.parts:
            if x is y:
                p, q = x.parts
                todo += [(p, q), (q, q), (p, p)]
            elif not y.parts or x.parts and len(x.members) >= len(y.members):
                todo += [(p, y) for p in x.parts]
            else:
                todo += [(x, p) for p in y.parts]
            continue
        if x is y:
            i, j = np.triu_indices(len(x.members), 1)
            i, j = x.members[i], x.members[j]
        else:
            i, j = np.repeat(x.members, len(y.members)), np.tile(y.members, len(x.members))
        ok = sig.may_link(i, j, percent)
        for u, v in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if forest.find(u) != forest.find(v) and (links is None or links(u, v)):
                forest.join(u, v)


# ---------------------------------------------------------------- routing


def _documents(width: int):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, maps, fine = [], [], [], []
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                key.append(int(set_hash(s)) if len(s) else None)
                maps.append(bitmap(s, CELLS).tobytes() if len(s) else None)
                fine.append(bitmap(s, LONG_CELLS).tobytes() if len(s) >= LONG else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(maps, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "n", "key", "map", "fine"])

    return lambda b: C.released(documents(b))


def _prefixes(width: int, percent: int, buckets: int, frequent: np.ndarray):
    cuts = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)
    shift = np.uint64(max(0, 64 - (buckets.bit_length() - 1) - 31))  # 32 bits tell a bucket's shingles apart; two that they don't are only compared more

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sizes, keys, seen = [], [], [], set()
        for b in batches:
            for s in shingle_sets(b.column(0), width):
                n = len(s)
                key = int(set_hash(s)) if n else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                if len(frequent):
                    hot = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                    s = np.concatenate([s[~hot], s[hot]])
                tokens.append(s[: n - -(-n * percent // 100) + 1])
                sizes.append(n)
                keys.append(key)
        if not keys:
            return
        owner = np.repeat(np.arange(len(keys)), [len(t) for t in tokens])
        token = np.concatenate(tokens)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        edges = np.concatenate([[0], np.searchsorted(token, cuts), [len(token)]])
        keys_, sizes_ = np.array(keys, np.int64), np.array(sizes, np.int64)
        for k in range(buckets):
            lo, hi = int(edges[k]), int(edges[k + 1])
            if hi > lo:
                used, index = np.unique(owner[lo:hi], return_inverse=True)
                short = ((token[lo:hi] - (cuts[k - 1] if k else np.uint64(0))) >> shift).astype(np.uint32)
                data = C.pack(short, index.astype(np.uint32), keys_[used], sizes_[used])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["bucket", "payload"])

    return lambda b: C.released(send(b))


def _pairs_of_small(groups: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, members in groups:
        i, j = np.triu_indices(s, 1)
        us.append(members[:, i].reshape(-1))
        vs.append(members[:, j].reshape(-1))
    return np.concatenate(us), np.concatenate(vs)


def _shared(percent: int):
    """The groups of sets that share a shingle and whose sizes allow a link, each once a task: a hash of the group, and its keys."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, base = [], 0
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                token, index, keys, sizes = C.unpack(payload)
                parts.append((token.astype(np.int64) + (np.int64(bucket) << 32), index.astype(np.int64) + base, keys, sizes))
                base += len(keys)
        if not parts:
            return
        token, index, keys, sizes = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        keys, one, which = np.unique(keys, return_index=True, return_inverse=True)
        sizes, index = sizes[one], which[index]
        order = np.lexsort((index, sizes[index], token))
        token, index = token[order], index[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (index[1:] != index[:-1])
        token, index = token[new], index[new]
        size = sizes[index]
        # in order of size: where one can't link with the next, none before can link with any after
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(token)))
        names = np.add.reduceat(C.mix(keys[index].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), starts)
        names = C.mix(names + counts.astype(np.uint64))
        some = np.flatnonzero(counts > 1)
        some = some[np.unique(names[some], return_index=True)[1]]
        lo = 0
        ends = np.cumsum(counts[some])
        while lo < len(some):  # about a million keys at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000, "right")))
            part = some[lo:hi]
            n = counts[part]
            offsets = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(starts[part], n)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(keys[index[at]]))])
            yield pa.RecordBatch.from_arrays([pa.array(names[part].view(np.int64)), data.cast(pa.binary())], ["g", "keys"])
            lo = hi

    return lambda b: C.released(find(b))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``g, key`` of each group once; rows of a group are in one task."""
    seen: set[int] = set()
    for b in batches:
        names, keys = [], []
        for g, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if g not in seen:
                seen.add(g)
                names.append(g)
                keys.append(np.frombuffer(data.as_buffer(), np.int64))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), [len(k) for k in keys])), pa.array(np.concatenate(keys))], ["g", "key"])


def _candidates(percent: int):
    """Pairs that may link, as a forest, of rows ``g, key, n, map, fine``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, index, keys, sizes, maps, fine, at = [], [], [], [], [], [], {}
        for b in batches:
            token.append(b.column(0).to_numpy(zero_copy_only=False))
            names, place = b.column(1).to_pylist(), []
            for k, key in enumerate(names):
                if key not in at:  # a set's bitmaps are kept once
                    at[key] = len(keys)
                    keys.append(key)
                    sizes.append(b.column(2)[k].as_py())
                    maps.append(np.frombuffer(b.column(3)[k].as_py(), np.uint8))
                    if sizes[-1] >= LONG:
                        fine.append(np.frombuffer(b.column(4)[k].as_py(), np.uint8))
                place.append(at[key])
            index.append(np.array(place, np.int64))
        if not keys:
            return
        token, index, keys, sizes = np.concatenate(token), np.concatenate(index), np.array(keys, np.int64), np.array(sizes, np.int64)
        where = np.full(len(sizes), -1, np.int64)
        where[sizes >= LONG] = np.arange(len(fine))
        sig = Signatures(sizes, np.stack(maps), where, np.stack(fine) if fine else np.zeros((0, LONG_CELLS), np.uint8))
        del maps, fine, at
        order = np.lexsort((index, token))
        token, index = token[order], index[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (index[1:] != index[:-1])
        token, index = token[new], index[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        counts = np.diff(np.append(starts, len(token)))
        forest = Forest(len(keys))
        small = [(s, index[starts[counts == s][:, None] + np.arange(s)]) for s in range(2, _LEAF // 2 + 1) if (counts == s).any()]
        u, v = _pairs_of_small(small)
        if len(u):
            pair = np.unique(np.minimum(u, v) * np.int64(len(keys)) + np.maximum(u, v))
            u, v = pair // len(keys), pair % len(keys)
            ok = sig.may_link(u, v, percent)
            for x, y in zip(*G.forest(u[ok], v[ok]), strict=True):
                forest.join(int(x), int(y))
        done = set()
        for k in np.flatnonzero(counts > _LEAF // 2).tolist():
            members = index[starts[k] : starts[k] + counts[k]]
            if (name := hash(members.tobytes())) in done:
                continue
            done.add(name)
            members = members[np.lexsort((members, sig.sizes[members]))]
            tree = Node(members, sig)
            dual(tree, tree, sig, forest, percent)
        if forest.edges:
            e = np.array(forest.edges)
            yield pa.RecordBatch.from_arrays([pa.array(keys[e[:, 0]]), pa.array(keys[e[:, 1]])], ["u", "v"])

    return lambda b: C.released(find(b))


def frequent_shingles(docs: DataFrame, width: int, sample_rows: int, share: float, most: int) -> np.ndarray:
    """Shingles of at least ``share`` of ``sample_rows`` documents, ``most`` at most; they only move to the end of the order."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s for s in shingle_sets(b.column(0), width) if len(s)]
            if found:
                t, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])

    # proven bound: sample_rows ids, and their texts' shingles
    sample = docs.join(F.broadcast(ids), "doc_id").select("text")
    least = max(3, int(share * sample_rows))
    rows = sample.mapInArrow(tokens, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "t").limit(most).select("t").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


# ---------------------------------------------------------------- verification


def _forest_of(first: list[np.ndarray], second: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join something, within one list of sets or between two (positions; the second's follow the first's)."""
    sets = first + (second or [])

    def links(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return bool(enough(both, len(sets[i]), len(sets[j]), percent))

    if second is None and len(sets) == 2:
        return [(0, 1)] if links(0, 1) else []
    forest, sig = Forest(len(sets)), Signatures.of(sets)
    order = np.array(sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k][0] if len(sets[k]) else 0)), np.int64)
    x = Node(order[order < len(first)] if second is not None else order, sig)
    dual(x, x if second is None else Node(order[order >= len(first)], sig), sig, forest, percent, links)
    return forest.edges


def _pack_texts(keys: np.ndarray, texts: pa.Array) -> bytes:
    data, offsets = C.string_buffers(texts)
    return C.pack(keys, offsets, data)


def _unpack_texts(payloads: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    keys, texts = [], []
    for p in payloads:
        k, offsets, data = C.unpack(p)
        keys.append(k)
        texts.append(pa.LargeStringArray.from_buffers(len(k), pa.py_buffer(offsets), pa.py_buffer(data)))
    return np.concatenate(keys), pa.concat_arrays(texts)


_OWN_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("comp", pa.int64()), ("blocks", pa.int32()), ("b", pa.int32()), ("payload", pa.binary())])
_OWN_DDL = "u long, v long, comp long, blocks int, b int, payload binary"


def _own(width: int, percent: int):
    """Links inside each block, and the packed texts of blocks that have others to meet."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        groups: dict[tuple, list[int]] = {}
        for k, g in enumerate(zip(table["comp"].to_pylist(), table["blocks"].to_pylist(), table["b"].to_pylist(), strict=True)):
            groups.setdefault(g, []).append(k)
        keys, texts, rows = table["key"].to_numpy(), table["text"].combine_chunks(), []
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        for (comp, blocks, b), at in groups.items():
            part = texts.take(pa.array(at))
            rows += [(int(keys[at[i]]), int(keys[at[j]]), comp, None, None, None) for i, j in _forest_of(list(shingle_sets(part, width)), None, percent)]
            if blocks > 1:
                rows.append((None, None, comp, blocks, b, _pack_texts(keys[at], part)))
        yield from C.record_batches(rows, _OWN_SCHEMA)

    return lambda b: C.released(verify(b))


def _across(width: int, percent: int):
    """Links between the two sides (0 and 1) of each (comp, i, j); rows hold packed texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple, tuple[list, list]] = {}
        for x in batches:
            for comp, i, j, side, payload in zip(*(x.column(c).to_pylist() for c in ("comp", "i", "j", "side", "payload")), strict=True):
                sides.setdefault((comp, i, j), ([], []))[side].append(payload)
        for one, two in sides.values():
            if one and two:
                k1, t1 = _unpack_texts(one)
                k2, t2 = _unpack_texts(two)
                keys = np.concatenate([k1, k2])
                edges = np.array(_forest_of(list(shingle_sets(t1, width)), list(shingle_sets(t2, width)), percent), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(keys[edges[:, 0]]), pa.array(keys[edges[:, 1]])], ["u", "v"])

    return lambda b: C.released(verify(b))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed texts of some keys of each block."""
    for x in batches:
        for comp, b, rests, payload, wanted in zip(*(x.column(c).to_pylist() for c in ("comp", "b", "rests", "payload", "keys")), strict=True):
            keys, texts = _unpack_texts([payload])
            at = np.flatnonzero(np.isin(keys, np.array(wanted, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([comp], pa.int64()), pa.array([b], pa.int32()), pa.array([rests], pa.int32()), pa.array([_pack_texts(keys[at], texts.take(pa.array(at)))], pa.binary())], ["comp", "b", "rests", "payload"])


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = 80, block: int = BLOCK, sample_rows: int = 2000, share: float = 0.003, most_frequent: int = 200_000) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    C.importable(docs)
    n = C.partitions_for(docs)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = C.checkpoint(source.mapInArrow(_documents(width), "doc_id long, n long, key long, map binary, fine binary"))
    table = signed.select("doc_id", "n", "key")
    known = source.where("doc_id is not null")
    frequent = frequent_shingles(known, width, sample_rows, share, most_frequent)
    sent = known.select("text").mapInArrow(_prefixes(width, percent, n, frequent), "bucket int, payload binary").repartition(n, "bucket")
    shared = sent.mapInArrow(_shared(percent), "g long, keys binary").repartition(n, "g")
    asked = C.checkpoint(shared.mapInArrow(lambda b: C.released(_members(b)), "g long, key long"))
    # a set's signature, of one of its rows, travels only if it shares a shingle
    wanted = signed.where("key is not null").join(asked.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "map", "fine")
    compared = asked.join(wanted, "key").select("g", "key", "n", "map", "fine").repartition(n, "g")
    maybe = C.checkpoint(compared.mapInArrow(_candidates(percent), "u long, v long"))
    C.forget(asked)
    groups = C.checkpoint(G.components(maybe).withColumnRenamed("node", "key").withColumnRenamed("component", "comp"))
    C.forget(maybe)
    # one row for each set, however many documents have it
    classes = C.checkpoint(table.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    members = C.checkpoint(groups.join(classes, "key"))
    C.forget(groups)
    # blocks of 64 sets in small groups and of ``block`` in large ones, so a group's first pass is spread over tasks
    sets = F.least(F.lit(block), F.greatest(F.lit(64), 8 * F.sqrt(F.count("*"))))
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    wanted = C.spread_join(members, sizes, "comp", "key").withColumn("b", F.pmod(F.xxhash64("key", F.lit(3)), "blocks").cast("int"))
    rows = wanted.select("doc_id", "comp", "key", "blocks", "b").join(known, "doc_id").repartition(n, "comp", "b")
    own = C.checkpoint(rows.mapInArrow(_own(width, percent), _OWN_DDL))
    found = own.where("u is not null").select("u", "v")
    packed = own.where("payload is not null").select("comp", "blocks", "b", "payload")
    if not packed.isEmpty():
        found = _between_blocks(found, packed, block, n, width, percent)
    joined = G.components(found).withColumnRenamed("node", "key").withColumnRenamed("component", "link")
    named = C.checkpoint(classes.join(joined, "key", "left").select("key", "doc_id", F.coalesce("link", "key").alias("link")))
    least = C.spread_join(named, named.groupBy("link").agg(F.min("doc_id").alias("least")), "link", "key").select("key", "least")
    out = C.spread_join(table, least, "key", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _between_blocks(found: DataFrame, packed: DataFrame, block: int, n: int, width: int, percent: int) -> DataFrame:
    """The links of blocks' own pairs and of pairs between blocks of a group: with the pivot block, then of what that left apart."""
    at = F.when(F.col("b") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("b"))
    first = packed.select("comp", F.lit(0).alias("i"), F.explode(at).alias("j"), (F.col("b") > 0).cast("int").alias("side"), "payload")
    found = C.checkpoint(found.union(first.repartition(n, "comp", "i", "j").mapInArrow(_across(width, percent), "u long, v long")))
    keys = packed.select("comp", "b", "blocks", "payload").mapInArrow(_keys, "comp long, b int, key long")
    now = G.components(found).withColumnRenamed("node", "key").withColumnRenamed("component", "link")
    state = C.checkpoint(keys.join(now, "key", "left").withColumn("link", F.coalesce("link", "key")))
    main = state.groupBy("comp", "link").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max_by("link", F.struct("size", "link")).alias("main"))
    left = C.checkpoint(C.spread_join(state, main, "comp", "key").where("link <> main").select("comp", "b", "key"))
    if left.isEmpty():
        return found
    rests = left.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("rests"))
    # a block has about ``block`` keys, whatever the group
    some = left.groupBy("comp", "b").agg(F.collect_list("key").alias("keys")).join(rests, "comp")
    pieces = C.checkpoint(packed.join(some, ["comp", "b"]).select("comp", "b", "rests", "payload", "keys").mapInArrow(_chosen, "comp long, b int, rests int, payload binary"))
    of = packed.groupBy("comp").agg(F.max("blocks").alias("blocks"))
    one = pieces.join(of, "comp").select("comp", F.pmod(F.xxhash64("b"), "rests").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "payload")
    two = packed.join(rests, "comp").select("comp", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"), "payload")
    return C.checkpoint(found.union(one.union(two).repartition(n, "comp", "i", "j").mapInArrow(_across(width, percent), "u long, v long")))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        for comp, b, payload in zip(*(x.column(c).to_pylist() for c in ("comp", "b", "payload")), strict=True):
            keys = C.unpack(payload)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), comp, np.int64)), pa.array(np.full(len(keys), b, np.int32)), pa.array(keys)], ["comp", "b", "key"])


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(C.read(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) m ON m.u = d.doc_id"""

QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
ORACLES = {"op6_ngram_jaccard_join": ORACLE}
