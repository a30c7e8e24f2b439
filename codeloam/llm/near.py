"""Near copies by the exact similarity of their sets of word shingles, found through SimHash trees.

Texts are near copies if their sets of WORDS-word shingles have a Jaccard similarity of 4 / 5 or more. A SimHash
of such a pair differs in 15 % of its bits, far beyond the radius at which a vantage-point tree prunes anything,
so the search goes on behind the trees until no pair can be missing:

1. The trees of simhash.links() find the pairs within TREE_BITS bits. Each is judged by its whole sets.
2. A set of n shingles is known by n - ceil(0.8 n) + 1 of them, its prefix, rare ones first: two sets at 0.8 share
   one there. Of the sets that share a shingle, all that aren't connected to one of them are compared with it, in
   some rounds with another one each time, so a cluster of k near copies costs a few times k comparisons.
3. Where many sets share a shingle still, each goes to one crowd, and a crowd is compared in tiles, whose pairs stay
   inside a task.
4. What shares a shingle, isn't connected yet and hasn't met in a crowd are the last candidates: each component of
   theirs is compared as a crowd.

In 2 and 4 a pair is judged by whole sets only if its sizes, the number of prefix shingles in common and the
Hamming distance of four lanes of SimHash leave it a chance. Whole sets are compared in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT, components, fits, mapped, materialise, numbered, tidy, unused, without
from .simhash import Union, _hashes, _majority, links, near_groups

#: Words in a shingle; lanes of the SimHash; bits of one lane within which the trees search; bits of all lanes beyond
#: which no pair is judged. A pair at 0.8 differs in 38.9 bits of 256 with a spread of 5.7, so FAR_BITS is six spreads
#: away; sets under SMALL are exempt.
WORDS, LANES, TREE_BITS, FAR_BITS, SMALL = 5, 4, 3, 73, 16
#: Rounds of stars; sets that make a crowd, and shingles in a block of it (or those of one set).
ROUNDS, CROWD, BLOCK = 1, 64, 1 << 20
#: About the texts that tell which shingles are common, and the bound on those that are told.
COMMON_TEXTS, COMMON = 1 << 14, 1 << 17
#: Shingles in a chunk of a set, bytes in a batch of chunks, and pairs for which a star has one more part.
CHUNK, BATCH_BYTES, STAR_PAIRS = 1 << 15, 4 << 20, 1 << 20


def shingle_set(data: bytes, k: int) -> np.ndarray:
    """The hashes of data's shingles of k words, each once, in order."""
    parts = [np.unique(h.astype(np.uint64)) for h in _hashes(data, k)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _text(value: pa.Scalar) -> bytes:
    raw = value.as_buffer()
    return raw.to_pybytes() if raw is not None else b""


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that occur in several of a sample of texts, as rows (hash, count) by hash. It only sets the order
    in which shingles are taken for a prefix; any order gives the same links."""
    n = docs.count()
    top = min(1.0, COMMON_TEXTS / max(1, n), 1 / 8 + 1000 / max(1, n))
    drawn = docs.select("text", F.xxhash64("row_key").alias("h"))
    drawn = drawn if top == 1.0 else drawn.where(F.col("h") < F.lit(int(top * (1 << 64)) - (1 << 63)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(_text(value), k).view(np.int64))], ["h"])

    seen = mapped(drawn.select("text"), run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = seen.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.uint64)
    order = np.argsort(h)
    return np.stack([h[order], n[order]])


_SHINGLED = f"fp binary, size long, s struct<{', '.join(f's{k}: long' for k in range(LANES))}>, prefix array<long>"


def shingled(docs: DataFrame, k: int) -> DataFrame:
    """row_key, doc_id, fp (a 128-bit digest of the set of shingles), size (of the set), s (the lanes of its
    SimHash) and prefix: its first n - ceil(4n / 5) + 1 shingles, rare ones first."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common.value
        for batch in batches:
            fps, sizes, prints, heads = [], [], [], []
            for value in batch.column(2):
                own = shingle_set(_text(value), k)
                fps.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(_majority([own.astype(">u8")], LANES))
                n = len(own) + -4 * len(own) // 5 + 1 if len(own) else 0
                rank = np.zeros(len(own), np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, count[at], rank)
                heads.append(own[np.lexsort((own, rank))[:n]].view(np.int64))
            lanes = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, LANES)
            print_ = pa.StructArray.from_arrays([pa.array(lanes[:, j]) for j in range(LANES)], [f"s{j}" for j in range(LANES)])
            columns = [pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), print_, pa.array(heads, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row_key", "doc_id", "fp", "size", "s", "prefix"])

    return mapped(docs.select("row_key", "doc_id", "text"), run, f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SHINGLED}")


_CUT = ["group", "salt", "part", "node", "m", "n", "hashes"]


def _cut(k: int):
    """Texts, each with the stars that ask for it, as chunks of their sets: the parts of all hashes by their first
    bits, as many as the star's centre needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _CUT)

        for batch in batches:
            for asks, node, value in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                own = shingle_set(_text(value), k)
                for ask in asks.as_py():
                    bits = ((ask["m"] - 1) // CHUNK).bit_length()
                    edges = np.searchsorted(own, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                    edges = [0, *map(int, edges), len(own)]
                    for part, (a, b) in enumerate(zip(edges, edges[1:])):
                        if a < b or node == ask["group"]:
                            rows.append((ask["group"], ask["salt"], part, node, ask["m"], ask["n"], own[a:b].tobytes()))
                            held += 8 * (b - a) + 64
                            if held >= BATCH_BYTES:
                                yield out()
                                rows, held = [], 0
        if rows:
            yield out()

    return run


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles each row shares with its group's first row, the node that names it; one row at a time."""
    own = np.zeros(0, np.uint64)
    for batch in batches:
        kept, both = [], []
        for at, (group, node, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(6))):
            hashes = np.frombuffer(raw.as_buffer(), np.uint64)
            if group == node:
                own = hashes
            else:
                kept.append(at)
                both.append(len(np.intersect1d(own, hashes, assume_unique=True)))
        kept = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in (0, 3, 4, 5)), pa.array(both, pa.int64())], ["group", "node", "m", "n", "both"])


def judged(pairs: DataFrame, texts: DataFrame, k: int, label: str) -> DataFrame:
    """Links a, b: the pairs(group, node, m, n), group < node with sets of m and n shingles, whose whole sets have a
    similarity of 4 / 5 or more. A centre's set goes once to each part of its star."""
    pairs = materialise(pairs, f"{label}-pairs")
    many = pairs.count()
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(1 + many // STAR_PAIRS)).cast("int"))
    ask = lambda n: F.struct("group", "salt", "m", F.col(n).alias("n")).alias("ask")
    asked = pairs.select("node", ask("n")).unionByName(pairs.select(F.col("group").alias("node"), ask("m")).distinct())
    asked = asked.groupBy("node").agg(F.collect_list("ask").alias("asks"))
    chosen = texts.join(F.broadcast(asked) if many * 2 * 64 <= SENT else asked, texts["row_key"] == asked["node"]).select("asks", "node", "text")
    cut = mapped(chosen, _cut(k), "group long, salt int, part int, node long, m long, n long, hashes binary")
    dealt = cut.repartition("group", "salt", "part").sortWithinPartitions("group", "salt", "part", "node")
    shared = mapped(dealt, _star, "group long, node long, m long, n long, both long")
    sums = shared.groupBy("group", "node").agg(F.sum("both").alias("both"), F.first("m").alias("m"), F.first("n").alias("n"))
    return materialise(sums.where("5 * both >= 4 * (m + n - both)").select(F.col("group").alias("a"), F.col("node").alias("b")), label)


def crowded(places: DataFrame, known: DataFrame) -> DataFrame:
    """Sets that share a shingle with CROWD or more others, each in the crowd of the shingle that most do; as dealt()."""
    held = places.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= CROWD)
    held = materialise(held, "near-crowds")
    met = places.join(F.broadcast(held) if fits(held, 24) else held, "h").groupBy("node").agg(F.max(F.struct("held", "h")).alias("c"))
    return dealt(met.select("node", F.col("c.h").alias("crowd")), known)


def dealt(members: DataFrame, known: DataFrame) -> DataFrame:
    """node, crowd, block, blocks of members(node, crowd): each crowd in blocks of about BLOCK shingles."""
    own = materialise(known.select("node", "size").join(members, "node"), "near-members")
    blocks = own.groupBy("crowd").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    placed = own.join(blocks, "crowd")
    return materialise(placed.select("node", "crowd", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "blocks"), "near-blocks")


def tiled(crowds: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Links a, b that connect all near pairs of each crowd, by whole sets. A set goes to one tile for each block of
    its crowd, and a tile gives a spanning forest of its links, so no pair becomes a row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_set(_text(value), k).tobytes() for value in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(hashes, pa.binary())], ["crowd", "tile", "block", "node", "hashes"])

    def tile(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        own = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in table["hashes"]]
        root = near_roots(own, block)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": node[root[linked]], "b": node[linked]})

    many = crowds.count()
    asked = crowds.select("crowd", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    asked = asked.select("crowd", F.concat_ws(".", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "block", "node")
    chosen = texts.join(F.broadcast(asked) if many <= 1 << 14 else asked, texts["row_key"] == asked["node"]).select("crowd", "tile", "block", "node", "text")
    cut = mapped(chosen, sets, "crowd long, tile string, block int, node long, hashes binary")
    return materialise(cut.groupBy("crowd", "tile").applyInArrow(tile, "a long, b long"), "near-tiles")


def near_roots(sets: list[np.ndarray], block: np.ndarray) -> np.ndarray:
    """Smallest member of each set's component under similarity 4 / 5 or more, of sets in one block or in two."""
    size, union = np.array([len(x) for x in sets], np.int64), Union(len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    value, place = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(place, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(value)))]).astype(np.int64)
    holders, ends = owner[order], np.cumsum(size)
    whole = len(np.unique(block)) < 2
    for a in range(len(sets)):
        mine = place[ends[a] - size[a] : ends[a]]
        n = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holders[at], minlength=len(sets))
        near = 5 * both >= 4 * (size[a] + size - both)
        near[: a + 1] = False
        near &= whole | (block != block[a])
        found = np.flatnonzero(near)
        union.join(np.full(len(found), a), found)
    return union.root


#: Sets of m and n shingles, of whose prefixes `shared` are in common, have at most as many more in common as are
#: left of the one whose prefix ends first; a similarity of 4 / 5 takes 4 / 9 of m + n.
_SHARE = "9 * (shared + ceil(4 * greatest(m, n) / 5) - 1) >= 4 * (m + n)"
_NEAR = f"5 * least(m, n) >= 4 * greatest(m, n) and (least(m, n) < {SMALL} or {' + '.join(f'bit_count(x.s{k} ^ y.s{k})' for k in range(LANES))} <= {FAR_BITS})"


def near_links(nodes: DataFrame, fps: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Edges a, b that connect the nodes whose sets of shingles have a similarity of 4 / 5 or more, and no others;
    as many of them as it takes to connect every such pair."""
    twice = materialise(fps.select("row_key").join(nodes.select(F.col("node").alias("row_key")), "row_key", "left_anti"), "near-twice")
    single = without(fps.drop("doc_id", "fp"), twice, "row_key").withColumnRenamed("row_key", "node")
    known = materialise(single.select("node", "size", "s"), "near-nodes")
    small = fits(known, 24 + 8 * LANES)

    def union(found: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, found)

    def rooted(found: list[DataFrame], label: str) -> DataFrame:
        own = known.join(components(union(found), label), "node", "left").withColumn("root", F.coalesce("root", "node"))
        return materialise(own, f"{label}-roots")

    def described(pairs: DataFrame, own: DataFrame) -> DataFrame:
        """pairs(group, node, ...) that aren't connected and may be near, with their sizes m and n."""
        one = own.select(F.col("node").alias("group"), F.col("size").alias("m"), F.col("s").alias("x"), F.col("root").alias("up"))
        other = own.select("node", F.col("size").alias("n"), F.col("s").alias("y"), "root")
        put = lambda df: F.broadcast(df) if small else df
        return pairs.join(put(one), "group").join(put(other), "node").where(f"up != root and {_NEAR}")

    alone = known.withColumn("root", F.col("node"))
    tree = links(known.select("node", F.unhex(F.lpad(F.hex("s.s0"), 16, "0")).alias("fp")), TREE_BITS, 2)
    tree = tree.select(F.least("a", "b").alias("group"), F.greatest("a", "b").alias("node")).distinct()
    found = [judged(described(tree, alone).select("group", "node", "m", "n"), texts, k, "near-tree")]

    # minima are taken before the shuffle, so a shingle with a third of all rows costs one row a task
    posts = single.select(F.explode("prefix").alias("h"), "node")
    several = materialise(posts.groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("h"), "near-shingles")
    places = materialise(posts.join(several, "h"), "near-posts")
    for k_round in range(ROUNDS):
        tidy(nodes.sparkSession)
        own = rooted(found, f"near-cc{k_round}")
        moved = materialise(own.where("root != node").select("node", "root"), "near-moved")
        placed = places.select("h", "node").join(F.broadcast(moved) if fits(moved, 16) else moved, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # the same node is the centre of all shingles that it is the first of by hash, another one in each round
        first = F.min(F.struct(F.xxhash64("node", F.lit(k_round)).alias("order"), "node"))
        open_ = placed.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), first.alias("c")).where("lo != hi")
        open_ = materialise(open_.select("h", F.col("c.node").alias("centre")), "near-open")
        places = materialise(placed.join(F.broadcast(open_) if fits(open_, 24) else open_, "h"), "near-left")
        stars = places.where("node != centre").select(F.least("node", "centre").alias("group"), F.greatest("node", "centre").alias("node"))
        stars = stars.groupBy("group", "node").agg(F.count(F.lit(1)).alias("shared"))
        more = judged(described(stars, own).where(_SHARE).select("group", "node", "m", "n"), texts, k, "near-stars")
        if more.isEmpty():
            break
        found.append(more)

    places = places.select("h", "node")
    crowds = crowded(places, known)
    found.append(tiled(crowds, texts, k))

    tidy(nodes.sparkSession)
    moved = materialise(rooted(found, "near-last-cc").where("root != node").select("node", "root"), "near-moved")
    left = places.join(F.broadcast(moved) if fits(moved, 16) else moved, "node", "left")
    left = left.join(crowds.select("node", "crowd"), "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"), "crowd")
    left = materialise(left, "near-last")
    one = left.select("h", F.col("node").alias("group"), F.col("root").alias("up"), F.col("crowd").alias("own_crowd"))
    pairs = one.join(left, "h").where("group < node and up != root and coalesce(own_crowd != crowd, true)")
    pairs = pairs.groupBy("group", "node").agg(F.count(F.lit(1)).alias("shared"))
    pairs = materialise(described(pairs, known.withColumn("root", F.col("node"))).where(_SHARE).select(F.col("group").alias("a"), F.col("node").alias("b")), "near-cross-pairs")
    # each set goes once to a task of its candidates and theirs, not once for each pair
    found.append(tiled(dealt(components(pairs, "near-cross-cc").select("node", F.col("root").alias("crowd")), known), texts, k))
    return union(found)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: the first by doc_id (nulls last), then by row.

    Texts link if the exact Jaccard similarity of their sets of five-word shingles is 0.8 or more (null: empty; texts
    without a word are copies of each other, a shorter text is one shingle). All columns stay, whatever their names."""
    tidy(docs.sparkSession)
    key = unused(docs, "__row")
    rows = numbered(docs, "near-rows", key)
    texts = rows.select(F.col(key).alias("row_key"), "doc_id", "text")
    fps = materialise(shingled(texts, WORDS), "near-fps")
    marks = near_groups(fps.select("row_key", "doc_id", "fp"), lambda nodes: near_links(nodes, fps, texts, WORDS))
    gone = materialise(marks.where("row_key != keep_key").select(F.col("row_key").alias(key)), "near-gone")
    return without(rows, gone, key).drop(key)
