"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces of documents are dealt out evenly into shards. Best-fit decreasing packs each shard; where that
needs as many sequences as the tokens themselves do, no packing is better and the shard is done.
Elsewhere its full bins are final, and islands evolve packings of what is in the others: a crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold duplicates, lets displaced pieces
take the place of ones that fill a bin less well, and best-fits the rest; after each epoch the islands' elites
migrate around a ring. Every epoch is written to the shared folder.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import mapped, materialise, tidy

#: Pieces in a shard on average; islands, epochs, parents and generations of the search.
SHARD_PIECES, ISLANDS, EPOCHS, PARENTS, GENERATIONS = 32_768, 3, 3, 6, 60
#: Bins that are searched together; bins injected at most, bins touched and exchanges tried in each of a child.
CORE, INJECTED, TOUCHED, OUTS = 600, 12, 64, 12


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """row_key, doc_id, piece, start, length, ids_crc32 of each document's ids with id 0 behind them.

    Only documents of more than `capacity` ids are cut, into pieces of `capacity`; the first may be
    shorter. Null text: empty, one id. Each whole text is encoded."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    stop = np.zeros(1, "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            owner, piece, start, length, crc = [], [], [], [], []
            for k, (_, ids) in enumerate(coder.encode_batch(texts)):
                raw = np.concatenate([ids.astype("<u4"), stop]).tobytes()
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins with their free space, and the fullest that still takes a piece in a few steps."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.free = capacity, [], []
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, items: list[int], used: int) -> None:
        self.bins.append(items)
        self._open(len(self.bins) - 1, self.capacity - used)

    def _open(self, k: int, free: int) -> None:
        if free:
            self.by_free[free].append(k)
            self.mask |= 1 << free

    def best_fit(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.add([item], size)
            return
        free = size + (fits & -fits).bit_length() - 1
        own = self.by_free[free]
        k = own.pop()
        if not own:
            self.mask ^= 1 << free
        self.bins[k].append(item)
        self._open(k, free - size)


def best_fit_decreasing(sizes: list[int], capacity: int, items: list[int] | None = None) -> list[list[int]]:
    out = Bins(capacity)
    for i in sorted(range(len(sizes)) if items is None else items, key=lambda i: -sizes[i]):
        out.best_fit(i, sizes[i])
    return out.bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: by total, and by pieces of over half a bin."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Fewer bins first; among equals, the more uneven filling, which leaves larger gaps."""
    return -len(bins) + sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _pair_under(keys: list[int], room: int) -> tuple[int, int, int]:
    """The largest sum of two of the ascending keys that room holds, and where they are; sum 0 if there is none."""
    best, i, j = (0, 0, 0), 0, len(keys) - 1
    while i < j:
        total = keys[i] + keys[j]
        if total > room:
            j -= 1
            continue
        if total > best[0]:
            best = (total, i, j)
            if total == room:
                break
        i += 1
    return best


def absorb(bins: list[list[int]], displaced: list[int], sizes: list[int], capacity: int, rng: random.Random) -> list[int]:
    """Dominance: in some bins with room, up to two pieces give way to one or two displaced ones that fill it better.
    Returns what is displaced then."""
    left = sorted(displaced, key=lambda i: sizes[i])
    keys = [sizes[i] for i in left]
    room = {k: free for k, b in enumerate(bins) if (free := capacity - sum(sizes[i] for i in b))}
    for k in rng.sample(list(room), min(TOUCHED, len(room))):
        own, free = bins[k], room[k]
        if not left:
            break
        outs = [(), *((i,) for i in own), *((x, y) for a, x in enumerate(own) for y in own[a + 1 :])]
        if len(outs) > OUTS:
            outs = [(), *rng.sample(outs[1:], OUTS)]
        best, swap = 0, None
        for out in outs:
            gone = sum(sizes[i] for i in out)
            at = bisect_right(keys, free + gone) - 1
            if at >= 0 and keys[at] - gone > best:
                best, swap = keys[at] - gone, (out, (at,))
            two, i, j = _pair_under(keys, free + gone)
            if two - gone > best:
                best, swap = two - gone, (out, (i, j))
            if best == free:
                break
        if swap:
            out, places = swap
            bins[k] = [i for i in own if i not in out] + [left[p] for p in places]
            for p in reversed(places):
                del left[p], keys[p]
            for i in out:
                at = bisect_right(keys, sizes[i])
                left.insert(at, i)
                keys.insert(at, sizes[i])
    return left


def crossover(into: list[list[int]], of: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A packing with some of the well-filled bins of `of` as they are, and the rest as in `into` where it can. The
    emptiest bin and some others are taken apart; displaced pieces are absorbed where they fill a bin better, and the
    rest is best-fitted."""
    fill = [sum(sizes[i] for i in b) for b in of]
    well = [k for k, used in enumerate(fill) if used >= 0.98 * capacity] or sorted(range(len(of)), key=lambda k: -fill[k])[: max(1, len(of) // 4)]
    chosen = [of[k] for k in rng.sample(well, min(len(well), 1 + rng.randrange(INJECTED)))]
    taken = {i for b in chosen for i in b}
    full = sorted(range(len(into)), key=lambda k: sum(sizes[i] for i in into[k]))
    drop = {full[0], *rng.sample(full, min(len(full), rng.randrange(1, 4)))}
    kept, displaced = [list(b) for b in chosen], []
    for k, b in enumerate(into):
        if k in drop or any(i in taken for i in b):
            displaced += [i for i in b if i not in taken]
        else:
            kept.append(list(b))
    displaced = absorb(kept, displaced, sizes, capacity, rng)
    out = Bins(capacity)
    for b in kept:
        out.add(b, sum(sizes[i] for i in b))
    for i in sorted(displaced, key=lambda i: -sizes[i]):
        out.best_fit(i, sizes[i])
    return out.bins


def seeded(sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Best-fit in a disturbed order of sizes, or in any order at all."""
    spread = rng.choice([0.7, 0.9, 0.0])
    noise = [s * rng.uniform(spread, 1.0) for s in sizes] if spread else [rng.random() for _ in sizes]
    out = Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -noise[i]):
        out.best_fit(i, sizes[i])
    return out.bins


def evolve(parents: list[list[list[int]]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The best packing after some generations; at once if it meets the lower bound. A child takes the place of the
    worst parent if it is better than that and unlike all in its fitness, so that parents stay apart."""
    bound = lower_bound(sizes, capacity)
    ranked = sorted(((_fitness(p, sizes, capacity), k, p) for k, p in enumerate(parents)), reverse=True)
    for k in range(GENERATIONS):
        if len(ranked[0][2]) <= bound:
            break
        a = ranked[min(rng.randrange(len(ranked)), rng.randrange(len(ranked)))][2]
        b = ranked[rng.randrange(len(ranked))][2]
        child = crossover(a, b, sizes, capacity, rng)
        worth = _fitness(child, sizes, capacity)
        if all(worth != r[0] for r in ranked):
            ranked = sorted([*ranked, (worth, len(parents) + k, child)], reverse=True)[:PARENTS]
    return ranked[0][2]


_PLACED = "shard int, core int, base int, island int, row_key long, length long, bin int, place long, n_bins int, bound int"
_COLUMNS = [c.split()[0] for c in _PLACED.split(", ")]


def _placed(shard: int, core: int, base: int, island: int, keys: np.ndarray, sizes: list[int], bins: list[list[int]], bound: int) -> pa.Table:
    order = [i for b in bins for i in b]
    length = np.array([sizes[i] for i in order], np.int64)
    which = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    before = np.cumsum(length) - length
    first = np.concatenate([[0], np.cumsum([len(b) for b in bins])[:-1]]).astype(int)
    same = [np.full(len(order), x, np.int32) for x in (shard, core, base, island, len(bins), bound)]
    return pa.table(dict(zip(_COLUMNS, [*same[:4], keys[order], length, which.astype(np.int32), before - before[first][which], *same[4:]])))


def _cores(shard: int, keys: np.ndarray, sizes: list[int], capacity: int) -> pa.Table:
    """Best-fit decreasing of a shard. Where it has more bins than the bound, its full bins are final (core -1), and
    the others go to cores of at most CORE bins, filled alike, that are searched on their own."""
    bins = best_fit_decreasing(sizes, capacity)
    room = [capacity - sum(sizes[i] for i in b) for b in bins]
    open_ = sorted((k for k in range(len(bins)) if room[k]), key=lambda k: -room[k]) if len(bins) > lower_bound(sizes, capacity) else []
    fixed = [b for k, b in enumerate(bins) if k not in set(open_)] if open_ else bins
    parts, base, many = [_placed(shard, -1, 0, 0, keys, sizes, fixed, len(fixed))] if fixed else [], len(fixed), -(-len(open_) // CORE)
    for c in range(many):
        own = [bins[k] for k in open_[c::many]]
        parts.append(_placed(shard, c, base, 0, keys, sizes, own, lower_bound([sizes[i] for b in own for i in b], capacity)))
        base += len(own)
    return pa.concat_tables(parts)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces(row_key, length), a table, with sequence_id and offset.

    row_key is unique; lengths are 1 to capacity. Sequences hold at most `capacity`, without gaps."""
    shards = max(1, -(-pieces.count() // SHARD_PIECES))

    def seed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row_key", "ascending")])
        return _cores(table["shard"][0].as_py(), table["row_key"].to_numpy(), table["length"].to_pylist(), capacity)

    def island(table: pa.Table) -> pa.Table:
        shard, core, base, me, bound = (table[c][0].as_py() for c in ("shard", "core", "base", "island", "bound"))
        table = table.sort_by([("elite", "ascending"), ("row_key", "ascending")])
        elite = table["elite"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], elite[1:] != elite[:-1], [True]]))
        keys, sizes, parents = table["row_key"].to_numpy()[: edges[1]], table["length"].to_pylist()[: edges[1]], []
        for a, b in zip(edges[:-1], edges[1:]):
            bins: dict[int, list[int]] = {}
            for i, k in enumerate(table["bin"].slice(a, b - a).to_pylist()):
                bins.setdefault(k, []).append(i)
            parents.append(list(bins.values()))
        rng = random.Random(f"{shard}-{core}-{me}-{len(parents)}")
        while len(parents) < PARENTS:
            parents.append(seeded(sizes, capacity, rng))
        return _placed(shard, core, base, me, keys, sizes, evolve(parents, sizes, capacity, rng), bound)

    dealt = pieces.select("row_key", "length", F.pmod(F.xxhash64("row_key"), F.lit(shards)).cast("int").alias("shard"))
    first = materialise(dealt.groupBy("shard").applyInArrow(seed, _PLACED), "pack-seed")
    done, left = first.where("n_bins = bound"), first.where("n_bins > bound")
    if not left.isEmpty():
        ring = left.drop("island").withColumn("island", F.explode(F.array(*(F.lit(k) for k in range(ISLANDS))))).withColumn("elite", F.lit(0))
        for epoch in range(EPOCHS):
            elites = materialise(ring.groupBy("shard", "core", "island").applyInArrow(island, _PLACED), f"pack-epoch{epoch}")
            moved = elites.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")).withColumn("elite", F.lit(1))
            ring = elites.withColumn("elite", F.lit(0)).unionByName(moved)
        best = elites.groupBy("shard", "core").agg(F.min(F.struct("n_bins", "island")).alias("b")).select("shard", "core", F.col("b.island").alias("island"))
        done = done.unionByName(elites.join(best, ["shard", "core", "island"]).select(*done.columns))
    return done.select("row_key", (F.col("shard").cast("long") * (1 << 32) + F.col("base") + F.col("bin")).alias("sequence_id"), F.col("place").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tidy(docs.sparkSession)
    pieces = materialise(cut_pieces(docs, vocabulary, capacity).withColumn("row_key", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "row_key").drop("row_key")
