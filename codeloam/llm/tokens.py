"""Token counts: encoding stages over documents, and additive totals kept up by signed batches."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder
from .common import empty_if_null, mapped, materialise


def _texts(batch: pa.RecordBatch, k: int) -> list[str]:
    return ["" if t is None else t for t in batch.column(k).to_pylist()]


def digest_tokens(docs: DataFrame, ranks: str) -> DataFrame:
    """Encode every whole text and decode the ids again.

    docs: doc_id, text; null text counts as empty; repeated rows give repeated rows; other columns are
    ignored. Returns doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            counts, ids_sha, back_sha = [], [], []
            for n, ids in coder.encode_batch(_texts(batch, 1)):
                counts.append(n)
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(docs: DataFrame, ranks: str, keep: list[str], name: str = "n_tokens") -> DataFrame:
    """The columns keep, and the token count of each whole text (null: 0)."""
    shape = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(ranks)
        for batch in batches:
            counts = [n for n, _ in coder.encode_batch(_texts(batch, batch.num_columns - 1), only_counts=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*keep, name])

    return mapped(docs.select(*keep, F.col("text").alias("__text")), run, shape)


class TokenLedger:
    """Totals of documents, tokens and characters by source, language and tokenizer version.

    A batch is a set of signed rows: +1 for an insert, -1 for a delete, both for a revised count. It becomes one
    additive row for each key and is committed by renaming its finished folder, staged under a name of its own, to
    batch=<id>; a batch that is already there changes nothing, so a retry after a lost driver or executor is safe. Of
    two that commit one id at once, the later one's folder ends up inside the other's under its hidden name, where no
    reader looks, and is taken away. Totals are the sums of the last fold and of the batches that aren't in it;
    compact() makes a fold. The ledger needs a file system that renames a folder in one step, as HDFS and local ones
    do; object stores that copy instead aren't safe. Keys may be null; a key whose three totals are all zero is not
    reported."""

    KEYS = ("source", "lang", "tokenizer")
    SUMS = ("n_docs", "n_tokens", "n_chars")
    SHAPE = ", ".join([f"{k} string" for k in KEYS] + [f"{c} long" for c in SUMS])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, kind: str) -> list[str]:
        """What stands behind kind= in the names of the ledger's folders."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(n.partition("=")[2] for n in names if n.startswith(f"{kind}="))

    def _last_fold(self) -> int:
        return max(map(int, self._named("fold")), default=0)

    def _folded(self, fold: int) -> set[str]:
        """The ids in a fold: one short string a batch."""
        return {r.id for r in self.spark.read.schema("id string").parquet(f"{self.path}/fold={fold}/ids").collect()} if fold else set()

    def _check(self, batch: str) -> None:
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch id has letters, digits, - and _ only: {batch!r}")

    def committed(self, batch: str) -> bool:
        self._check(batch)
        return bool(self._fs.exists(self._path(f"{self.path}/batch={batch}"))) or batch in self._folded(self._last_fold())

    def _put(self, staged: str, name: str) -> bool:
        """Rename a finished folder; False if another one has the name."""
        target = f"{self.path}/{name}"
        moved = not self._fs.exists(self._path(target)) and self._fs.rename(self._path(f"{self.path}/{staged}"), self._path(target))
        lost = self._path(f"{target}/{staged}")
        if moved and not self._fs.exists(lost):
            return True
        self._fs.delete(lost if moved else self._path(f"{self.path}/{staged}"), True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: sign (int), source, lang, tokenizer, n_tokens, n_chars. Whether it was new."""
        if self.committed(batch):
            return False
        signed = [F.sum(F.col("sign").cast("long")).alias("n_docs")] + [F.sum(F.col("sign") * F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in self.SUMS[1:]]
        staged = f"_staged-{uuid.uuid4().hex}"
        changes.groupBy(*self.KEYS).agg(*signed).write.parquet(f"{self.path}/{staged}")
        return self._put(staged, f"batch={batch}")

    def _sums(self) -> tuple[DataFrame, int, set[str], list[str]]:
        """Sums by key, and what they are of: the last fold, the ids in it and the batches that aren't."""
        fold = self._last_fold()
        known = self._folded(fold)
        loose = [b for b in self._named("batch") if b not in known]
        parts = [f"{self.path}/batch={b}" for b in loose] + ([f"{self.path}/fold={fold}/sums"] if fold else [])
        rows = self.spark.read.schema(self.SHAPE).parquet(*parts) if parts else self.spark.createDataFrame([], self.SHAPE)
        return rows.groupBy(*self.KEYS).agg(*(F.sum(c).alias(c) for c in self.SUMS)), fold, known, loose

    def totals(self) -> DataFrame:
        return self._sums()[0].where(" or ".join(f"{c} != 0" for c in self.SUMS))

    def compact(self) -> bool:
        """Fold all batches into one table of sums that remembers their ids, so a replay still changes nothing.
        Folders that the fold before already held are deleted: one generation late, for readers under way."""
        sums, fold, known, loose = self._sums()
        if not loose:
            return False
        staged = f"_staged-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{staged}/sums")
        self.spark.createDataFrame([(b,) for b in sorted(known | set(loose))], "id string").coalesce(1).write.parquet(f"{self.path}/{staged}/ids")
        if not self._put(staged, f"fold={fold + 1}"):
            return False
        for old in [f"batch={b}" for b in self._named("batch") if b in known] + [f"fold={n}" for n in map(int, self._named("fold")) if n < fold]:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return True


def counted(docs: DataFrame, tokenizers: dict[str, str], label: str) -> DataFrame:
    """doc_id, source, lang, n_chars, tokenizer, n_tokens of each text under each tokenizer version, as a table. Null
    text: empty; source and lang are read as strings and may be null; other columns are ignored."""
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.length(empty_if_null()).cast("long").alias("n_chars"), "text")
    each = [count_tokens(base, ranks, ["doc_id", "source", "lang", "n_chars"]).withColumn("tokenizer", F.lit(version)) for version, ranks in tokenizers.items()]
    return materialise(reduce(DataFrame.unionByName, each), label)


def rollup_edits(spark: SparkSession, docs: DataFrame, path: str, tokenizers: dict[str, str]) -> DataFrame:
    """Totals after four batches: all documents; the ones of 100 to 399 characters revised to the first half of their
    text, counted anew; the shorter ones deleted; and the first batch again, which must change nothing. The first
    two are folded before the third comes."""
    length = F.length(empty_if_null())
    before = counted(docs, tokenizers, "token-counts")
    short = docs.where((length >= 100) & (length < 400)).withColumn("text", F.expr("substr(text, 1, length(text) div 2)"))
    after = counted(short, tokenizers, "token-revised")
    plus, minus = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    load = before.select("*", plus)
    ledger = TokenLedger(spark, path)
    ledger.commit("load", load)
    ledger.commit("revise", before.where("n_chars >= 100 and n_chars < 400").select("*", minus).unionByName(after.select("*", plus)))
    ledger.compact()
    ledger.commit("delete", before.where("n_chars < 100").select("*", minus))
    ledger.commit("load", load)
    return ledger.totals()
