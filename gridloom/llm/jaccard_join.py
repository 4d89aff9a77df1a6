"""Set similarity join of texts by word shingles, with several global orders of the shingles.

Documents of equal sets form one class, the node of all that follows. Two sets that reach the threshold
share a token among the first few of either (their prefixes) in *every* global order of tokens.

1. A sketch of token frequencies over all texts ranks common tokens last in each order; among tokens of
   one rank each order has a hash of its own. Orders are free, so an approximate rank costs no exactness.
2. The first order's prefixes are exchanged by token. Sets that meet at a token are chained in random order:
   as many pairs as sets. Sizes, the token's places and an exact bound on the overlap (bitmaps of the sets) rule
   most chance meetings out; the rest are verified if they also share prefix tokens in the other orders.
3. Linked sets need no further pairs among themselves, as components are asked for. Where a token still joins
   several components, the pairs across components that those bounds allow go the same way while they are few for
   their sets. Sets that such pairs connect densely are a crowd: they are gathered, by blocks, and verified where they
   meet, pair by pair until they are linked, so a crowd costs a row per set and block and none per pair. A token whose
   sets all have one same shared token before it adds no pairs to that one's and is left out; tokens are dealt by
   the least of their sets, so that tokens of one passage, with the same sets, go together.

So groups of copies, of near copies and of sets with a common passage never become all their pairs, and no
link between components is lost: a pair that is never looked at is in one component already.

A token is a 64-bit hash of its words, a node the sum of its tokens' mixed hashes. The exchange of prefixes tells tokens
apart by 32 bits and their group; what meets by chance there is told apart by verification.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.hashed import blocks, mix, trimmed, trimmed_groups, window_hashes, word_hashes
from gridloom.operators.components import _hung, connected_components, extended_components
from gridloom.storage import discard, materialize, ship

#: Threshold as a ratio of whole numbers: overlap / union >= NUM / DEN.
NUM, DEN = 75, 100
WIDTH = 5
#: Orders beyond the first.
MORE_ORDERS = 2
SKETCH_BITS, SKETCH_CHUNKS = 20, 16
#: Prefix tokens of an exchange group, about; pairs of a verification group; rows of a group in which runs are paired.
GROUP_TOKENS, GROUP_PAIRS, GROUP_RUNS = 2_000_000, 2_000, 100_000
#: Nodes of a token that are paired across components in one task.
RUN_NODES = 4096
#: Candidate pairs a node, on average, beyond which nodes that pairs connect are a crowd; tokens of a block of one; pairs a task holds at most, about.
CROWD_PAIRS, CROWD_TOKENS, HELD_PAIRS = 4, 1_000_000, 2_000_000
#: Ids sent to every task at most; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Places in a prefix are cut below this; it marks the first token of a set within a group.
FIRST_OF_SET = np.uint16(1 << 15)
_SALTS = [np.uint64(0), *(mix(np.arange(1, 1 + MORE_ORDERS, dtype=np.uint64)))]


FIRST = ["doc_id", "text_hash", "node", "n", "bitmap", "chunk", "counts"]
#: Pairs (a, b), or members a of crowds, told apart by g and crowd, with their component and size.
CANDIDATES = ["a", "b", "g", "crowd", "part", "n"]


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def token_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text: of WIDTH words, or of all its words if fewer."""
    h, bounds = word_hashes(texts)
    windows = window_hashes(h, WIDTH)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            yield np.unique(windows[a : b - WIDTH + 1])
        elif b > a:
            yield mix(window_hashes(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    """Identity of a set as a signed long."""
    return int((mix(tokens + np.uint64(7)).sum() ^ np.uint64(len(tokens))).astype(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for at, n in blocks(batch.column(column)):
            yield batch.slice(at, n)


def _members_and_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member rows (doc_id, text_hash, node, n, bitmap of a set that is new to the task), then the task's share of the sketch."""
    sketch = np.zeros(1 << SKETCH_BITS, np.int32)
    seen: set[int] = set()
    for part in _texts(batches, 2):
        nodes, sizes, fresh, bitmaps = [], [], [], []
        for s in token_sets(part.column(2)):
            node = node_of(s)
            nodes.append(node)
            sizes.append(len(s))
            new = len(s) and node not in seen
            bitmaps.append(_bitmap(s).tobytes() if new else None)
            if new:
                seen.add(node)
                fresh.append(s)
        if fresh:
            sketch += np.bincount((np.concatenate(fresh) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32)
        n = part.num_rows
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], FIRST)
    chunks = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SKETCH_CHUNKS)]
    empty = pa.nulls(SKETCH_CHUNKS, pa.int64())
    yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, pa.nulls(SKETCH_CHUNKS, pa.binary()), pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array(chunks, pa.binary())], FIRST)


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int32).astype(np.int64) for x in table["counts"])
    return pa.table({"chunk": table["chunk"].slice(0, 1), "counts": [total.tobytes()]}, table.schema)


def _ranks(counted: DataFrame) -> np.ndarray:
    """Rank of each sketch bucket: 0 up to four times the mean, then one more per doubling of the count."""
    rows = counted.groupBy("chunk").applyInArrow(_add, "chunk int, counts binary").collect()
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["chunk"])])
    floor = max(1.0, 4.0 * counts.mean())
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts, 1) / floor))).astype(np.uint8)


def _prefix(tokens: np.ndarray, ranks: np.ndarray, order: int) -> np.ndarray:
    """The tokens' prefix in one of the global orders, in that order."""
    p = prefix_length(len(tokens))
    key = (mix(tokens + _SALTS[order]) >> np.uint64(8)) | (ranks[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56))
    first = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(p)
    return tokens[first[np.argsort(key[first])]]


def _deal(ranks, groups: int):
    """Prefix tokens of each distinct set of the task, packed by exchange group."""

    def pack(tokens: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat, own = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), counts)
        place = np.minimum(np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts), FIRST_OF_SET - 1).astype(np.uint16)
        spread = mix(flat)
        group = (spread % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        short, own, group, place = (spread >> np.uint64(32)).astype(np.uint32)[by], own[by], group[by], place[by]
        ends = np.searchsorted(group, np.arange(groups + 1))
        node, size = np.array(nodes, np.int64), np.array(sizes, np.int32)
        data = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            who, begin = np.unique(own[a:b], return_index=True)
            place[a + begin] |= FIRST_OF_SET
            data.append(np.array([b - a, len(who)], np.int64).tobytes() + node[who].tobytes() + size[who].tobytes() + short[a:b].tobytes() + place[a:b].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array(data, pa.binary())], ["g", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, nodes, sizes, held = [], [], [], 0
        for part in _texts(batches, 0):
            for s in token_sets(part.column(0)):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                tokens.append(_prefix(s, ranks.value, 0))
                nodes.append(node)
                sizes.append(len(s))
                held += len(tokens[-1])
            if held >= 1_000_000:
                yield pack(tokens, nodes, sizes)
                tokens, nodes, sizes, held = [], [], [], 0
        if tokens:
            yield pack(tokens, nodes, sizes)

    return run


def _need(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least overlap of sets of m and n tokens that reaches the threshold."""
    return -(-NUM * (m + n) // (NUM + DEN))


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """kind 0: pairs (x, y) chained at a token; kind 1: (token x, node y, place) of tokens with three nodes or more."""
    group, parts = np.uint64(key[0].as_py()) << np.uint64(32), ([], [])
    for raw in table["data"]:
        raw = raw.as_py()
        n, k = np.frombuffer(raw, np.int64, 2)
        node, size = np.frombuffer(raw, np.int64, k, 16), np.frombuffer(raw, np.int32, k, 16 + 8 * k)
        at = 16 + 12 * k
        place = np.frombuffer(raw, np.uint16, n, at + 4 * n)
        own, place = np.cumsum(place >= FIRST_OF_SET) - 1, place % FIRST_OF_SET
        # tokens lie by set within a group, in the order of their places
        parts[0].append(np.frombuffer(raw, np.uint32, n, at).astype(np.uint64) | group)
        parts[1].append(np.stack([node[own], size.astype(np.int64)[own], place.astype(np.int64)]))
    token, (node, size, place) = np.concatenate(parts[0]), np.concatenate(parts[1], axis=1)
    by = np.lexsort((mix(token ^ node.astype(np.uint64)), token))
    token, node, size, place = token[by], node[by], size[by], place[by]
    # equal sets from several tasks lie side by side
    own = np.ones(len(token), bool)
    own[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, size, place = token[own], node[own], size[own], place[own]
    same = token[1:] == token[:-1]
    # what comes before a pair's first common token is in neither's overlap
    fit = same & ((size - place)[1:] >= _need(size[1:], size[:-1])) & ((size - place)[:-1] >= _need(size[1:], size[:-1]))
    a, b = node[:-1][fit], node[1:][fit]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    length = np.diff(np.concatenate([start, [len(token)]]))
    many = np.repeat(length, length) >= 3
    x = np.concatenate([pairs[0], token[many].astype(np.int64)])
    y = np.concatenate([pairs[1], node[many]])
    z = np.concatenate([np.zeros(pairs.shape[1], np.int64), place[many]])
    kind = np.concatenate([np.zeros(pairs.shape[1], np.int32), np.ones(int(many.sum()), np.int32)])
    return pa.table({"kind": kind, "x": x, "y": y, "place": z})


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """Set bits at the tokens' hashes; two bits a token or more, but 128 at least and 8192 at most."""
    bits = min(8192, max(128, 1 << (2 * len(tokens) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(mix(tokens + np.uint64(99)) % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _load(ranks):
    """(groups, node, tokens, prefixes in the further orders) of texts that are what ``node`` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches, 0):
            rows = []
            for s, node, groups in zip(token_sets(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if len(s) and node_of(s) == node:
                    more = b"".join(np.sort(_prefix(s, ranks.value, k)).tobytes() for k in range(1, 1 + MORE_ORDERS))
                    rows.append((groups, node, s.tobytes(), more))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = [pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["groups", "node", "tokens", "prefixes"])

    return run


def _bounded(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs (a, b, g) whose sizes and bitmaps allow enough overlap; sets has node, n, bitmap."""
    where = {x: i for i, x in enumerate(sets["node"].to_pylist())}
    n, maps = sets["n"].to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in sets["bitmap"]]
    keep = []
    for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True):
        i, j = where[a], where[b]
        p, q = maps[i], maps[j]
        # only sets near the edge of a width differ in it, by one step
        p, q = (_fold(p[None])[0] if len(p) > len(q) else p), (_fold(q[None])[0] if len(q) > len(p) else q)
        least = _need(n[i], n[j])
        keep.append(len(p) == len(q) and n[i] - int(np.bitwise_count(p & ~q).sum()) >= least and n[j] - int(np.bitwise_count(q & ~p).sum()) >= least)
    return pairs.select(["a", "b", "g"]).filter(pa.array(keep, pa.bool_()))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _linked(p: tuple[np.ndarray, list[np.ndarray]], q: tuple[np.ndarray, list[np.ndarray]]) -> bool:
    """Whether sets, each as its tokens and its prefixes in the further orders, reach the threshold; the orders' filters first."""
    if not all(_common(x, y) for x, y in zip(p[1], q[1], strict=True)):
        return False
    both = _common(p[0], q[0])
    return DEN * both >= NUM * (len(p[0]) + len(q[0]) - both)


def _split(sets: pa.Table) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Tokens, and prefixes in the further orders, of each of ``sets``."""
    read = lambda x: np.frombuffer(x.as_py(), np.uint64)
    return [(read(x), np.split(read(y), MORE_ORDERS)) for x, y in zip(sets["tokens"], sets["prefixes"], strict=True)]


def _verify(key, pairs: pa.Table, sets: pa.Table) -> pa.Table:
    where = {n: i for i, n in enumerate(sets["node"].to_pylist())}
    known = _split(sets)
    links = [(a, b) for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True) if _linked(known[where[a]], known[where[b]])]
    cols = list(zip(*links, strict=True)) if links else [(), ()]
    return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})


def _in_groups(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (a, b), ``rows`` of them, with a group ``g``: of about GROUP_PAIRS pairs, neighbours together where they can be.

    A pair goes by the least node next to either end. The pairs of one such node are cut by blocks of their ends if they are
    many, so that a set goes to few groups and no group gets many pairs.
    """
    groups = max(8, -(-rows // GROUP_PAIRS))
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = pairs.join(least, "a").join(least.select(F.col("a").alias("b"), F.col("m").alias("o")), "b").select("a", "b", F.least("m", "o").alias("label"))
    near = materialize(near, "near", rows)
    hot = near.groupBy("label").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / GROUP_PAIRS)).cast("int").alias("parts")).where("parts > 1")
    block = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1)))
    p, q = block("a"), block("b")
    out = near.join(hot, "label", "left").select("a", "b", F.pmod(F.xxhash64("label", F.least(p, q), F.greatest(p, q)), F.lit(groups)).cast("int").alias("g"))
    out = materialize(out, "dealt", rows)
    discard(near)
    return out


def _wanted(dealt: DataFrame) -> DataFrame:
    """(node, groups) that ``dealt`` (a, b, g) needs."""
    return dealt.select("g", F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.collect_set("g").alias("groups"))


def _sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, ranks) -> DataFrame:
    """(h, node, tokens, prefixes) for each group h of ``wanted`` (node, groups), from the texts of the documents ``reps`` (node, rep) names.

    The ids wanted are sent to every task up to BROADCAST_IDS; beyond, ids and texts are joined by a shuffle.
    """
    small = F.broadcast if wanted.count() <= BROADCAST_IDS else (lambda x: x)
    named = small(wanted.join(reps.select("node", "rep"), "node"))
    texts = docs.join(named, docs["doc_id"].eqNullSafe(named["rep"])).select("text", "node", "groups")
    sets = texts.mapInArrow(trimmed(_load(ranks)), "groups array<int>, node long, tokens binary, prefixes binary")
    return sets.select(F.explode("groups").alias("h"), "node", "tokens", "prefixes")


def verify(dealt: DataFrame, docs: DataFrame, reps: DataFrame, ranks) -> DataFrame:
    """The links among ``dealt`` (a, b, group g)."""
    wanted = materialize(_wanted(dealt), "wanted", 2 * dealt.count())
    sets = _sets(wanted, docs, reps, ranks)
    links = materialize(dealt.groupBy("g").cogroup(sets.groupBy("h")).applyInArrow(trimmed_groups(_verify), "a long, b long"), "links")
    discard(wanted)
    return links


def _fold(bitmaps: np.ndarray) -> np.ndarray:
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] | bitmaps[:, half:]


class _Outlines:
    """Bitmaps of sets of ``n`` tokens, which ascend, by width."""

    def __init__(self, n: np.ndarray, own: list[np.ndarray]):
        self.n, self.words = n, np.array([len(x) for x in own])
        # those of the next width are folded in; row: where in its width's table a set stands
        self.full: dict[int, np.ndarray] = {}
        self.row = {w: np.zeros(len(own), np.int64) for w in {*self.words.tolist(), *(self.words // 2).tolist()}}
        for w, row in self.row.items():
            mine, wide = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            row[mine], row[wide] = np.arange(len(mine)), len(mine) + np.arange(len(wide))
            folded = _fold(np.stack([own[i] for i in wide.tolist()])) if len(wide) else np.empty((0, w), np.uint64)
            self.full[w] = np.concatenate([np.stack([own[i] for i in mine.tolist()]) if len(mine) else np.empty((0, w), np.uint64), folded])

    def upto(self, at: np.ndarray) -> np.ndarray:
        """For each of the sets ``at``, which ascend, the place there past the last that is not too large for it."""
        return np.searchsorted(self.n[at], self.n[at] * DEN // NUM, "right")

    def allowed(self, i: int, j: np.ndarray) -> np.ndarray:
        """Those of the sets ``j``, none smaller than ``i`` nor too large, whose bitmaps allow enough overlap with it."""
        found, w = [], self.words[i]
        for v in (w, 2 * w):  # a set of a third more tokens has the same width or the next
            g = j[self.words[j] == v]
            if len(g):
                mine, theirs, want = self.full[w][self.row[w][i]], self.full[w][self.row[w][g]], _need(self.n[i], self.n[g])
                lost_i = np.bitwise_count(mine & ~theirs).sum(axis=1)
                lost_j = np.bitwise_count(theirs & ~mine).sum(axis=1)
                found.append(g[(self.n[i] - lost_i >= want) & (self.n[g] - lost_j >= want)])
        return np.concatenate(found) if found else j[:0]


def _crowded(pairs: np.ndarray, home: np.ndarray) -> np.ndarray:
    """``pairs`` (i * len(home) + j) that stay pairs. Of nodes that too many of them connect, and of crowds those touch, ``home`` is set
    to one of them; it is -1 outside of crowds. Pairs within a crowd go."""
    n = len(home)
    pairs = np.unique(pairs)
    pairs = pairs[(home[pairs // n] < 0) | (home[pairs // n] != home[pairs % n])]
    i, j = pairs // n, pairs % n
    label = np.arange(n)
    node, least = _hung(i, j)
    label[node] = least
    ends = np.unique(np.concatenate([i, j]))
    dense = np.bincount(label[i], minlength=n) > CROWD_PAIRS * np.bincount(label[ends], minlength=n)
    new, old = ends[dense[label[ends]]], np.flatnonzero(home >= 0)
    if len(new):
        root = np.arange(n)
        node, least = _hung(np.concatenate([new, old]), np.concatenate([label[new], home[old]]))
        root[node] = least
        home[new], home[old] = root[new], root[old]
    return pairs[~dense[label[i]]]


def _across(key, runs: pa.Table, sets: pa.Table) -> pa.Table:
    """Pairs (a, b) of nodes that meet at a token, from different components, and that sizes and bitmaps allow to link. Nodes that
    they connect densely are rows (a, g, crowd, part, n) without b instead: any two of a crowd may link."""
    by_size = np.argsort(sets["n"].to_numpy(), kind="stable")
    nodes, n, part = (sets[c].to_numpy()[by_size] for c in ("id", "n", "part"))
    raw = sets["bitmap"].to_pylist()
    outlines = _Outlines(n, [np.frombuffer(raw[i], np.uint64) for i in by_size.tolist()])
    place = np.argsort(nodes, kind="stable")
    index = place[np.searchsorted(nodes[place], runs["node"].to_numpy())]
    token, mark, place_at = runs["token"].to_numpy(), runs["half"].to_numpy(), runs["place"].to_numpy()
    by = np.lexsort((index, token))
    index, token, mark, place_at = index[by], token[by], mark[by], place_at[by]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    home, found, held = np.full(len(nodes), -1), [np.zeros(0, np.int64)], 0
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(token)], strict=True):
        at, side, rest = index[s:e], mark[s:e], n[index[s:e]] - place_at[s:e]
        if part[at[0]] == part[at].min() == part[at].max():
            continue
        upto = outlines.upto(at)
        for k, i in enumerate(at.tolist()):
            j, need = at[k + 1 : upto[k]], _need(n[i], n[at[k + 1 : upto[k]]])
            ok = (part[j] != part[i]) & (rest[k] >= need) & (rest[k + 1 : upto[k]] >= need)
            if home[i] >= 0:
                ok &= home[j] != home[i]
            if side[k] >= 0:  # of two blocks of a large run only pairs between them
                ok &= side[k + 1 : upto[k]] != side[k]
            if len(j := outlines.allowed(i, j[ok])):
                found.append(i * np.int64(len(nodes)) + j)
                held += len(j)
            if held >= HELD_PAIRS:
                # what stays is bounded by the nodes
                found, held = [_crowded(np.concatenate(found), home)], 0
    pairs = _crowded(np.concatenate(found), home)
    some = np.flatnonzero(home >= 0)
    ends = np.sort(np.stack([nodes[pairs // len(nodes)], nodes[pairs % len(nodes)]]), axis=0)
    none = lambda k: pa.nulls(k, pa.int64())
    group = np.full(len(nodes), key[0].as_py())
    columns = [(ends[0], nodes[some]), (ends[1], none(len(some))), *[(none(len(pairs)), x[some].astype(np.int64)) for x in (group, nodes[home], part, n)]]
    return pa.table({c: pa.chunked_array([pa.array(x), pa.array(y)], pa.int64()) for c, (x, y) in zip(CANDIDATES, columns, strict=True)})


def _crowd_links(key, members: pa.Table, sets: pa.Table) -> pa.Table:
    """Links among ``members`` (node, half, part), whose sets are ``sets``, that connect all that similar pairs across parts and halves do."""
    order = {x: i for i, x in enumerate(sets["node"].to_pylist())}
    known = _split(sets)
    at = np.array([order[x] for x in members["node"].to_pylist()])
    size = np.array([len(t) for t, _ in known], np.int64)
    by = np.argsort(size[at], kind="stable")
    at, node, half = at[by], members["node"].to_numpy()[by], members["half"].to_numpy()[by]
    part = np.unique(members["part"].to_numpy()[by], return_inverse=True)[1]
    outlines = _Outlines(size[at], [_bitmap(known[i][0]) for i in at.tolist()])
    links = []
    for i, upto in enumerate(outlines.upto(np.arange(len(at))).tolist()):
        j = np.arange(i + 1, upto)
        for k in outlines.allowed(i, j[(part[j] != part[i]) & ((half[i] < 0) | (half[j] != half[i]))]).tolist():
            # what a link has joined needs no other
            if part[k] != part[i] and _linked(known[at[i]], known[at[k]]):
                part[part == part[k]] = part[i]
                links.append((node[i], node[k]))
    ends = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": ends.min(axis=1), "b": ends.max(axis=1)})


def _verify_crowds(members: DataFrame, docs: DataFrame, reps: DataFrame, ranks) -> DataFrame:
    """Links that connect what similar pairs within the crowds of ``members`` (a, g, crowd, part, n) connect; see :data:`CANDIDATES`.

    A crowd of more than CROWD_TOKENS tokens is met by two of its blocks at a time.
    """
    size = members.groupBy("g", "crowd").agg(F.ceil(F.sum("n") / CROWD_TOKENS).cast("int").alias("parts"))
    cells = members.join(size, ["g", "crowd"]).withColumn("me", F.pmod(F.xxhash64("a", "crowd"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    half = F.when(F.col("me") == F.col("other"), -1).otherwise(F.col("me")).alias("half")
    cells = materialize(cells.select(F.hash("g", "crowd", F.least("me", "other"), F.greatest("me", "other")).alias("g"), F.col("a").alias("node"), half, "part"), "crowds")
    wanted = materialize(cells.groupBy("node").agg(F.collect_set("g").alias("groups")), "wanted")
    sets = _sets(wanted, docs, reps, ranks)
    links = materialize(cells.groupBy("g").cogroup(sets.groupBy("h")).applyInArrow(trimmed_groups(_crowd_links), "a long, b long"), "links")
    discard(cells, wanted)
    return links


def _open_pairs(active: DataFrame, rows: int, component: DataFrame, sets: DataFrame) -> DataFrame:
    """:data:`CANDIDATES` across components among ``active`` (token, node, place), ``rows`` of them."""
    label = F.coalesce("component", "node").alias("component")
    runs = active.join(component, "node", "left").select("token", "node", "place", label)
    runs = runs.withColumn("prev", F.lag("token").over(Window.partitionBy("node").orderBy("place", "token")))
    told = runs.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k"), F.count("prev").alias("after"),
        F.min("prev").alias("prev_lo"), F.max("prev").alias("prev_hi"), F.min("node").alias("first"),
    )
    # where all sets of a token have one same shared token before it, their pairs meet there
    told = told.where("lo <> hi and not (after = k and prev_lo = prev_hi)")
    runs = runs.drop("prev").join(told.select("token", "first", F.ceil(F.col("k") / RUN_NODES).cast("int").alias("parts")), "token")
    # a run of more than RUN_NODES nodes becomes one run per two of its blocks, so no task holds all of it
    block = F.pmod(F.xxhash64("node", "token"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    runs = runs.withColumn("me", block).withColumn("other", other)
    run = F.xxhash64("token", F.least("me", "other"), F.greatest("me", "other"))
    whole = F.col("parts") == 1
    runs = runs.select(
        F.when(whole, F.col("token")).otherwise(run).alias("token"), "node", "place", "component",
        F.when(whole | (F.col("me") == F.col("other")), -1).otherwise(F.col("me")).alias("half"), F.xxhash64(F.when(whole, F.col("first")).otherwise(run)).alias("deal"),
    )
    runs = materialize(runs, "runs", rows)
    groups = max(8, runs.count() // GROUP_RUNS)
    dealt = runs.withColumn("g", F.pmod("deal", F.lit(groups)).cast("int"))
    wanted = dealt.select(F.col("g").alias("h"), F.col("node").alias("id"), F.col("component").alias("part")).distinct()
    wanted = wanted.join(sets.select(F.col("node").alias("id"), "n", "bitmap"), "id")
    met = dealt.select("g", "token", "node", "place", "half").groupBy("g").cogroup(wanted.groupBy("h"))
    out = materialize(met.applyInArrow(trimmed_groups(_across), ", ".join(f"{c} long" for c in CANDIDATES)), "open")
    discard(runs)
    return out


def jaccard_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, classes) of ``docs`` (doc_id, text).

    members: doc_id, text_hash, node, n_shingles of each row. links: verified pairs (a, b) of nodes, enough to connect
    all that similar pairs connect. classes: node, component (a node), component_id (least doc_id that links reach).
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, text_hash long, node long, n long, bitmap binary, chunk int, counts binary"
    first = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(trimmed(_members_and_sketch), schema), "members")
    members = first.where("chunk is null").select("doc_id", "text_hash", "node", F.col("n").alias("n_shingles"))
    reps = members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    reps = materialize(reps, "reps", members.count())
    total, sets = reps.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not total:
        return members, spark.createDataFrame([], "a long, b long"), reps.select("node", F.col("node").alias("component"), F.col("rep").alias("component_id"))
    ranks = spark.sparkContext.broadcast(_ranks(first.where("chunk is not null").select("chunk", "counts")))

    groups = max(8, -(-total // (4 * GROUP_TOKENS)))
    dealt = docs.select("text").mapInArrow(trimmed(_deal(ranks, groups)), "g int, data binary")
    met = materialize(dealt.groupBy("g").applyInArrow(trimmed_groups(_meet), "kind int, x long, y long, place long"), "met")
    chained, places = met.agg(F.count_if(F.expr("kind = 0")), F.count_if(F.expr("kind = 1"))).first()
    pairs = materialize(met.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs", chained)
    active = met.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("node"), "place")
    # one bitmap per set, though several tasks may have met it
    outlines = first.where("bitmap is not null").select("node", "n", "bitmap")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(active.select("node")).distinct()
    outlines = materialize(outlines.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "outlines", sets)
    dealt = _in_groups(pairs, pairs.count())
    maps = _wanted(dealt).join(outlines, "node").select(F.explode("groups").alias("h"), "node", "n", "bitmap")
    near = materialize(dealt.groupBy("g").cogroup(maps.groupBy("h")).applyInArrow(trimmed_groups(_bounded), "a long, b long, g int"), "near")
    discard(pairs, dealt)

    links = verify(near, docs, reps, ranks)
    component = connected_components(links)
    more = _open_pairs(active, places, component, outlines)
    discard(near, met, outlines)
    further = []
    between = materialize(more.where("b is not null").select("a", "b").distinct(), "between")
    if rows := between.count():
        dealt = _in_groups(between, rows)
        further.append(verify(dealt, docs, reps, ranks))
        discard(dealt)
    crowds = more.where("b is null").drop("b")
    if not crowds.isEmpty():
        further.append(_verify_crowds(crowds, docs, reps, ranks))
    if further:
        found = reduce(DataFrame.unionByName, further)
        known, component = component, extended_components(component, found)
        links = links.unionByName(found)
    labelled = reps.join(component, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = materialize(labelled.join(least, "component").select("node", "component", "component_id"), "classes", sets)
    discard(reps, more, between, component, *([known] if further else []))
    return members, links, classes


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    Null texts and texts without words have no shingles and are components of their own. Equal texts are linked.
    Null ids take part; a component of nothing else has component_id null. Rows that share an id each go by their own text.
    Further columns, whatever their names, are not looked at.
    """
    members, _, classes = jaccard_classes(docs)
    out = members.join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that stay when of each component one does, that of the least id, null last.

    Rows without words all stay. Rows that repeat an id and text are one document: one of them stays. Those that go are sent to
    every task up to BROADCAST_IDS; beyond, they are joined by a shuffle.
    """
    members, _, classes = jaccard_classes(docs)
    rows = members.where("n_shingles > 0").join(classes.select("node", "component"), "node")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    stays = rows.groupBy("component").agg(F.min(key).alias("k"))
    rows = rows.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(stays, "component")
    judged = materialize(rows.select("doc_id", "text_hash", "n", (key == F.col("k")).alias("stays")).where("n > 1 or not stays"), "judged", members.count())
    small = F.broadcast if judged.count() <= BROADCAST_IDS else (lambda x: x)
    hashed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64(F.col("text").cast("string"))})
    listed = judged.select(F.col("doc_id").alias("_id2"), F.col("text_hash").alias("_hash2"), "stays")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    kept = hashed.join(small(listed.drop("stays")), same, "left_anti").select(*docs.columns)
    if judged.where("stays").isEmpty():
        return kept
    again = hashed.join(small(listed.where("stays")), same, "left_semi").dropDuplicates(["_id", "_hash"]).select(*docs.columns)
    return kept.unionByName(again)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Digest of the components of all documents: doc_id, n_shingles, component_id."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
