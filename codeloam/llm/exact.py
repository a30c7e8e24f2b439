"""Exact dedup by a cuckoo-filter index over live digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialise, numbered, tidy, unused, without

#: Slots of a bucket, and moves before a filter counts as full.
SLOTS, MOVES = 4, 64


class CuckooIndex:
    """A set of live digests: a cuckoo filter of 16-bit tags in front of bucketed keys.

    A tag sits in one of two buckets (partial-key cuckoo hashing). A lookup whose tag is found compares
    the digests that the bucket stores; only an equal one counts as a hit, so there are no false
    positives. When an insertion can't place a tag, the filter doubles and is refilled from the keys."""

    def __init__(self, buckets: int = 1 << 10):
        self._resize(buckets)
        self.resized = 0

    def _resize(self, buckets: int) -> None:
        self.buckets = buckets
        self.tags = [0] * (buckets * SLOTS)
        self.keys: list = [None] * (buckets * SLOTS)
        self.live = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self.buckets - 1)
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, digest: bytes) -> int:
        """The slot of an equal digest, or -1."""
        tag, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[slot][0] == digest:
                    return slot
        return -1

    def value(self, digest: bytes):
        slot = self.find(digest)
        return None if slot < 0 else self.keys[slot][1]

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that isn't there, or replace its value."""
        slot = self.find(digest)
        if slot >= 0:
            self.keys[slot] = (digest, value)
            return
        entry = (digest, value)
        while (entry := self._place(entry)) is not None:
            kept = [k for k in self.keys if k is not None] + [entry]
            size = self.buckets
            entry = None
            while entry is None:
                size *= 2
                self.resized += 1
                self._resize(size)
                for k in kept:
                    if self._place(k) is not None:
                        break
                else:
                    return

    def _place(self, entry):
        """None if entry found a slot; else the entry that has none now."""
        tag, a, b = self._places(entry[0])
        for bucket in (a, b):
            if self._put(bucket, tag, entry):
                return None
        bucket = a
        for move in range(MOVES):
            slot = bucket * SLOTS + move % SLOTS
            self.tags[slot], tag = tag, self.tags[slot]
            self.keys[slot], entry = entry, self.keys[slot]
            bucket = self._other(bucket, tag)
            if self._put(bucket, tag, entry):
                return None
        return entry

    def _put(self, bucket: int, tag: int, entry) -> bool:
        for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.tags[slot]:
                self.tags[slot], self.keys[slot] = tag, entry
                self.live += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        slot = self.find(digest)
        if slot < 0:
            return False
        self.tags[slot], self.keys[slot] = 0, None
        self.live -= 1
        return True

    def items(self):
        return (k for k in self.keys if k is not None)


#: Digests that a map task holds before it passes its groups on.
HELD = 200_000
#: Rows that one shard of the index takes on average.
SHARD_ROWS = 250_000


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """row_key, doc_id and the SHA-256 of each text with A-Z lower-cased (null: empty)."""
    shape = f"row_key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2).cast(pa.large_binary()):
                raw = value.as_buffer()
                out.append(hashlib.sha256(raw.to_pybytes().lower() if raw is not None else b"").digest())  # bytes.lower: A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row_key", "doc_id", "digest"])

    return mapped(docs.select("row_key", "doc_id", F.col(text).alias("__text")), run, shape)


def groups(rows: DataFrame, id_type: str) -> DataFrame:
    """Groups of equal digests: digest, keep_id, keep_key, group_size.

    Map tasks merge their own rows through an index first, so a digest with a third of all rows sends
    one row a task; then each shard of digests has an index of its own."""
    shape = f"digest binary, keep_id {id_type}, keep_key long, group_size long"

    def merge(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        index, schema = CuckooIndex(), None
        for batch in batches:
            schema = batch.schema
            for digest, doc, key, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
                old = index.value(digest)
                if old is None:
                    index.insert(digest, (doc, key, n))
                else:
                    best = max(old[:2], (doc, key), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
                    index.insert(digest, (*best, old[2] + n))
            if not final and index.live >= HELD:
                yield from flush(index, schema)
                index = CuckooIndex()
        if schema is not None:
            yield from flush(index, schema)

    def flush(index: CuckooIndex, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows = [(d, *v) for d, v in index.items()]
        for at in range(0, len(rows), 50_000):
            columns = list(zip(*rows[at : at + 50_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema.names)

    first = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key"), F.lit(1).cast("long").alias("group_size"))
    own = mapped(first, lambda b: merge(b, False), shape)
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
    return mapped(own.repartition(shards, "digest"), lambda b: merge(b, True), shape)


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that mark_duplicates doesn't keep; all columns, whatever their names."""
    tidy(docs.sparkSession)
    key = unused(docs, "__row")
    rows = numbered(docs, "exact-rows", key)
    marks = mark_duplicates(rows.select(F.col(key).alias("row_key"), "doc_id", "text"))
    gone = materialise(marks.where("not kept").select(F.col("row_key").alias(key)), "exact-gone")
    return without(rows, gone, key).drop(key)


def mark_duplicates(keyed: DataFrame) -> DataFrame:
    """For each row of keyed(row_key, doc_id, text): row_key, doc_id, keep_id, group_size, kept, text_sha256.

    Equal: the same text after lower-casing A-Z; null is the empty text. Of equal texts the row with
    the largest doc_id stays; a null doc_id counts as the smallest, and of rows that repeat a doc_id
    exactly one stays. No rows in, no rows out; other columns are ignored."""
    rows = materialise(digests(keyed), "exact-digests")
    shared = groups(rows, rows.schema["doc_id"].dataType.simpleString()).where("group_size > 1")
    of = rows.join(shared.withColumnRenamed("digest", "__digest"), F.col("digest") == F.col("__digest"), "left")
    alone = F.col("__digest").isNull()
    return of.select(
        "row_key",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_key") == F.col("keep_key"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
