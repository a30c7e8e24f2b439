"""SimHash fingerprints and their near-duplicate groups through vantage-point trees.

Fingerprints that differ in at most `bits` bits agree to within bits // blocks in at least one of
`blocks` equal blocks. For each block, a vantage-point tree over the block's Hamming distance deals the
fingerprints out: a node holds a vantage point and a radius, a fingerprint's home is one side, and by
the triangle inequality it must also visit the other side only if its distance lies within the block's
bound of the radius. A leaf is a shard: its homes are compared with all that visit it, with further
vantage points inside the task, and the full distance decides. So every linked pair is found, exactly.

The upper tree is fitted on at most SAMPLE fingerprints (the smallest by hash); all fingerprints are
dealt through it. A shard returns a spanning star for each of its linked groups, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fits, mapped, materialise

#: Bound on the fingerprints that fit the upper trees.
SAMPLE = 1 << 18
#: Homes that a shard should have, and comparisons that a task makes without another vantage point.
SHARD_HOMES, DIRECT = 4096, 1 << 20
#: Points of a shard from which dense balls are taken out first.
PEEL_FROM = 1024

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK_BYTES = 1 << 22


def _spans(data: bytes, k: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """The words of data joined by blanks, with where each shingle of k words starts and ends, in blocks
    of bounded size; each shingle occurs once."""
    carry, at, some = [], 0, False
    while at < len(data):
        stop = at + _BLOCK_BYTES
        if stop < len(data):
            m = _BLANK.search(data, stop)
            stop = m.start() if m else len(data)
        words = carry + data[at:stop].lower().split()
        at = stop
        last = at >= len(data)
        if len(words) < k and not (last and words and not some):
            carry = words
            continue
        joined = b" ".join(words)
        starts, pos = [], 0
        for w in words:
            starts.append(pos)
            pos += len(w) + 1
        ends = [s - 1 for s in starts[1:]] + [len(joined)]
        if len(words) < k:
            yield joined, [0], [len(joined)]
        else:
            yield joined, starts[: len(words) - k + 1], ends[k - 1 :]
        some = True
        carry = words[len(words) - k + 1 :] if k > 1 else []


def fingerprint(data: bytes, k: int = 3, lanes: int = 1) -> bytes:
    """64 * lanes bits, most significant first: a bit is 1 if it is set in over half the shingles' hashes, a shingle
    counted as often as it occurs."""
    return _majority(_hashes(data, k), lanes)


def _hashes(data: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 with seed 42 of data's shingles of k words, as big-endian words, block by block."""
    digest = xxhash.xxh64_digest
    for joined, starts, ends in _spans(data, k):
        yield np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts, ends)]), ">u8")


def _majority(parts: Iterable[np.ndarray], lanes: int) -> bytes:
    """The first lane takes the hashes as they are; the others mix them further."""
    total, n = np.zeros(64 * lanes, np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)].view(np.uint8)
            for lane in range(lanes):
                bits = np.unpackbits((_mixed(part, lane) if lane else part).reshape(-1, 8), axis=1)
                total[64 * lane : 64 * lane + 64] += bits.sum(0, dtype=np.int32)
    return np.packbits(total * 2 > n).tobytes() if n else bytes(8 * lanes)


def _mixed(raw: np.ndarray, lane: int) -> np.ndarray:
    h = raw.view(">u8").astype(np.uint64) + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).astype(">u8").view(np.uint8)


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1) -> DataFrame:
    """row_key, doc_id, fp of each whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                raw = value.as_buffer()
                out.append(fingerprint(raw.to_pybytes() if raw is not None else b"", k, lanes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row_key", "doc_id", "fp"])

    return mapped(docs.select("row_key", "doc_id", "text"), run, f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp binary")


def _block(fp: np.ndarray, block: int, blocks: int) -> np.ndarray:
    """One block of fingerprints [n, lanes] of 64-bit words."""
    per = blocks // fp.shape[1]
    if per <= 1:
        return fp[:, block]
    width = 64 // per
    return (fp[:, block // per] >> np.uint64(64 - width * (block % per + 1))) & np.uint64((1 << width) - 1)


def fit_tree(values: np.ndarray, depth: int) -> dict[int, tuple[int, int]]:
    """A vantage-point tree as a heap of (vantage point, radius); no entry where a side can't be split, so its size
    is bounded by that of the sample, not by 2 ** depth."""
    tree: dict[int, tuple[int, int]] = {}

    def grow(at: int, own: np.ndarray) -> None:
        if at >= (1 << depth) - 1 or len(own) < 8:
            return
        found = _split(own)
        if found is None:
            return
        vantage, radius, near = found
        tree[at] = (vantage, radius)
        grow(2 * at + 1, own[near])
        grow(2 * at + 2, own[~near])

    grow(0, values)
    return tree


def _split(values: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The vantage point and radius, out of a few, that split values most evenly with few on the rim."""
    best = None
    for k in np.linspace(0, len(values) - 1, 5).astype(int):
        d = np.bitwise_count(values ^ values[k])
        radius = int(np.median(d))
        for r in (radius - 1, radius):
            near = d <= r
            n = int(near.sum())
            if r >= 0 and 0 < n < len(values):
                score = max(n, len(values) - n) + int(((d == r) | (d == r + 1)).sum()) // 2
                if best is None or score < best[0]:
                    best = (score, int(values[k]), r, near)
    return best and best[1:]


def _deal(tree: dict[int, tuple[int, int]], values: np.ndarray, slack: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Leaves with who comes there and whether it is their home."""
    todo = [(0, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        at, who, home = todo.pop()
        if not len(who):
            continue
        if at not in tree:
            yield at, who, home
            continue
        vantage, radius = tree[at]
        d = np.bitwise_count(values[who] ^ np.uint64(vantage)).astype(np.int64)
        near, far = d <= radius + slack, d > radius - slack
        todo.append((2 * at + 1, who[near], (home & (d <= radius))[near]))
        todo.append((2 * at + 2, who[far], (home & (d > radius))[far]))


class Union:
    """Smallest member as root, by pointer jumping over whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def _distances(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.zeros((len(a), len(b)), np.uint16)
    for lane in range(fp.shape[1]):
        d += np.bitwise_count(fp[a, lane][:, None] ^ fp[b, lane][None, :])
    return d


def _peel(fp: np.ndarray, points: np.ndarray, bits: int, union: Union) -> np.ndarray:
    """Take dense balls out of points: what lies within `bits` of a pivot is one group, what lies beyond twice
    that can't touch the group, and each point between needs a single link to it. Returns the rest."""
    while len(points) > PEEL_FROM:
        for k in np.linspace(0, len(points) - 1, 8).astype(int):
            d = _distances(fp, points[k : k + 1], points)[0]
            near = d <= bits
            if near.sum() >= max(PEEL_FROM // 8, len(points) // 16):
                break
        else:
            return points
        ball, shell = points[near], points[~near & (d <= 2 * bits)]
        union.join(ball, np.full(len(ball), points[k]))
        for at in range(0, len(ball), 256):
            some, left = ball[at : at + 256], []
            for to in range(0, len(shell), 4096):
                part = shell[to : to + 4096]
                hit = _distances(fp, part, some) <= bits
                linked = hit.any(1)
                union.join(part[linked], some[hit[linked].argmax(1)])
                left.append(part[~linked])
            shell = np.concatenate(left) if left else shell
            if not len(shell):
                break
        points = points[~near]
    return points


def link_shard(fp: np.ndarray, home: np.ndarray, block: np.ndarray, bits: int, slack: int) -> np.ndarray:
    """Root of each fingerprint of a shard under all links between a home and a visitor."""
    union = Union(len(fp))
    rest = _peel(fp, np.arange(len(fp)), bits, union)
    todo = [(rest[home[rest]], rest)]
    while todo:
        own, all_ = todo.pop()
        if not len(own) or not len(all_):
            continue
        found = _split(block[own]) if len(own) * len(all_) > DIRECT and len(own) >= 64 else None
        if found is not None:
            vantage, radius, near = found
            d = np.bitwise_count(block[all_] ^ np.uint64(vantage)).astype(np.int64)
            todo.append((own[near], all_[d <= radius + slack]))
            todo.append((own[~near], all_[d > radius - slack]))
            continue
        step = max(1, DIRECT // len(all_))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            i, j = np.nonzero(_distances(fp, some, all_) <= bits)
            a, b = some[i], all_[j]
            union.join(a[a != b], b[a != b])
    return union.root


def links(nodes: DataFrame, bits: int, blocks: int, lanes: int = 1) -> DataFrame:
    """Edges a, b between nodes(node, fp) that connect exactly the fingerprints within `bits` bits."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD_HOMES)))))
    wanted = min(SAMPLE, 32 << depth)
    # about twice as many as are wanted leave the tasks, however many tasks there are
    top = min(1.0, (2 * wanted + 1000) / max(1, n))
    drawn = nodes.select("fp", F.xxhash64("fp").alias("h"))
    drawn = drawn if top == 1.0 else drawn.where(F.col("h") < F.lit(int(top * (1 << 64)) - (1 << 63)))
    sample = [bytes(r.fp) for r in drawn.orderBy("h", "fp").limit(wanted).collect()] if depth else []
    drawn = np.frombuffer(b"".join(sample), ">u8").astype(np.uint64).reshape(-1, lanes)
    trees = [fit_tree(_block(drawn, b, blocks), depth) if depth else {} for b in range(blocks)]
    slack = bits // blocks  # the bits that a block may differ in

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, raw = batch.column(0), batch.column(1)
            fp = np.frombuffer(b"".join(raw.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)
            if not len(fp):
                continue
            for b in range(blocks):
                for leaf, who, home in _deal(trees[b], _block(fp, b, blocks), slack):
                    at = pa.array(who)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), b), pa.int32()), pa.array(np.full(len(who), leaf), pa.int64()), pa.array(home), node.take(at), raw.take(at)], ["block", "leaf", "home", "node", "fp"])

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        fp = np.frombuffer(b"".join(table["fp"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)[order]
        home = table["home"].to_numpy()[order]
        root = link_shard(fp, home, _block(fp, table["block"][0].as_py(), blocks), bits, slack)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(node[linked], pa.int64()), "b": pa.array(node[root[linked]], pa.int64())})

    dealt = mapped(nodes.select("node", "fp"), deal, "block int, leaf long, home boolean, node long, fp binary")
    return dealt.groupBy("block", "leaf").applyInArrow(shard, "a long, b long")


def near_groups(fps: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fps(row_key, doc_id, fp), a table, with component_id (the smallest doc_id reachable over links) and
    keep_key (the row_key of one row of that doc_id). link: edges a, b between nodes(node, fp).

    Equal fingerprints meet in one node, so copies cost nothing further. Null doc_ids are reached like
    any other row but name a component only if it has no other."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    nodes = materialise(fps.groupBy("fp").agg(F.min("row_key").alias("node"), best), "simhash-nodes")
    reached = components(materialise(link(nodes), "simhash-links"), "simhash-cc")
    own = materialise(nodes.join(reached, "node", "left"), "simhash-own")
    # a root may hold a third of all nodes: no shuffle by root while the roots are few; beyond, adaptive joins split it
    linked = own.where("root is not null")
    roots = materialise(linked.groupBy("root").agg(F.min("best").alias("first")), "simhash-roots")
    linked = linked.join(F.broadcast(roots) if fits(roots, 64) else roots, "root").select("fp", "first")
    named = linked.unionByName(own.where("root is null").select("fp", F.col("best").alias("first")))
    named = named.select(F.col("fp").alias("__fp"), F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("keep_key"))
    return fps.join(materialise(named, "simhash-named"), F.col("fp") == F.col("__fp")).drop("__fp")


def simhash_components(docs: DataFrame, k: int = 3, bits: int = 3) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at `bits` or fewer differing bits. Null texts count as empty; texts without a word
    have fingerprint zero, linked like any other; other columns are ignored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "text")
    fps = materialise(fingerprints(rows, k), "simhash")
    return near_groups(fps, lambda nodes: links(nodes, bits, blocks=2)).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
