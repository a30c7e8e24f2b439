"""Canonical document fingerprints, in built-in functions alone.

A text's canonical form is NFKC, full case folding, NFKC again, and every run of Unicode white space as
one blank with none at the ends. Its fingerprint is four chained XXH64 lanes. Rows whose fingerprints
are equal are compared byte by byte through the smallest and largest canonical text of their bucket; in
a bucket with different texts each fingerprint gets the SHA-256 of its own text behind it.

Normalisation and folding call the ICU library that Spark ships, through the SQL function reflect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, fits, materialise

#: 64-bit lanes of a fingerprint.
LANES = 4


def _icu(kind: str, method: str, text: Column) -> Column:
    return F.call_function("reflect", F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text that isn't null."""
    folded = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text))
    # single blanks, by far the most frequent white space, are left in place
    runs = r"[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]][\s\x1c-\x1f\x85\p{Z}]*+| [\s\x1c-\x1f\x85\p{Z}]++"
    return F.trim(F.regexp_replace(_icu("text.Normalizer", "compose", folded), runs, " "))


def digest(canon: Column) -> Column:
    lanes = [F.xxhash64(canon) if not k else F.xxhash64(F.lit(k).cast("long"), canon) for k in range(LANES)]
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in lanes)))


def add_digests(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows without the column text but with its digest as name and its canonical SHA-256 as name_sha."""
    kept = [c for c in rows.columns if c != text]
    canon = rows.select(*kept, canonical(F.col(text)).alias("__canon"))
    return canon.select(*kept, F.unhex(digest(F.col("__canon"))).alias(name), F.unhex(F.sha2("__canon", 256)).alias(f"{name}_sha"))


def split_digests(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """The digests in shared(digest) under which texts(text) has different canonical forms.

    The two extremes are combined before the shuffle, so a bucket of any size sends two texts a task."""
    canon = texts.select(canonical(F.col("text")).alias("canon"))
    members = canon.select("canon", F.unhex(digest(F.col("canon"))).alias("digest")).join(shared, "digest", "left_semi")
    ends = members.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return ends.where("low != high").select("digest")


def next_ids(docs: DataFrame) -> DataFrame:
    """this_id and next_id: the distinct doc_ids in descending order (null last), joined to a ring.

    Ids are cut into ranges; a window orders each range, and the ends of the ranges are linked among
    themselves, one row a range."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").distinct()
    ranged = materialise(ids.repartitionByRange(n, F.col("doc_id").desc_nulls_last()).select("doc_id", F.spark_partition_id().alias("part")), "id-ranges")
    inside = ranged.selectExpr(
        "doc_id as this_id",
        "part",
        "lead(doc_id) over (partition by part order by doc_id desc nulls last) as inner_id",
        "row_number() over (partition by part order by doc_id nulls first) = 1 as ends",
    )
    heads = ranged.groupBy("part").agg(F.expr("max(doc_id)").alias("head"))
    ring = heads.selectExpr("part", "lead(head) over (order by part) as after", "first_value(head) over (order by part) as top", "row_number() over (order by part desc) = 1 as final")
    ring = F.broadcast(ring.selectExpr("part", "if(final, top, after) as after"))  # a row for each shuffle partition
    return inside.join(ring, "part", "left").select("this_id", F.when(F.col("ends"), F.col("after")).otherwise(F.col("inner_id")).alias("next_id"))


def edited_texts(docs: DataFrame, others: DataFrame, following: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text) with next_id, n_chars and edited: the last floor(n / 2) code points give
    way to the first as many (or all) of the next document's text, which others(doc_id, text) has.

    Rows that repeat a doc_id share their next document; of several rows with that id the smallest text counts."""
    own = docs.join(following, F.col("doc_id").eqNullSafe(F.col("this_id"))).select(F.col("doc_id").alias("own_id"), "next_id", F.length("text").cast("long").alias("n_chars"), F.expr("cast(length(text) div 2 as int)").alias("half"), F.col("text").alias("own_text"))
    own = own.withColumn("kept", F.expr("substring(own_text, 1, length(own_text) - half)")).drop("own_text")
    if not others.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = others.groupBy("doc_id").agg(F.min("text").alias("text"))
    # docs and others are left as they are up to their shuffle: where they are one table, it is shuffled once
    joined = own.join(others.alias("o"), F.col("next_id").eqNullSafe(F.col("o.doc_id")))
    return joined.select(F.col("own_id").alias("doc_id"), "next_id", "n_chars", F.expr("concat(kept, substring(o.text, 1, half))").alias("edited"))


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The likeness of two fingerprints is 1 if they are equal, else 0: the digest is exact. Null texts are
    empty; without documents there are no rows; other columns are ignored."""
    docs = docs.select("doc_id", empty_if_null().alias("text"))
    own = materialise(add_digests(docs.withColumn("n_chars", F.length("text").cast("long")), "text", "own"), "canon-own")
    following = materialise(next_ids(own), "canon-next")
    edits = edited_texts(docs, docs, following)
    edits = edits.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    changed = materialise(add_digests(edits, "edited", "changed"), "canon-edited")
    seen = own.select(F.col("own").alias("digest")).unionByName(changed.select(F.col("changed").alias("digest")))
    shared = materialise(seen.groupBy("digest").count().where("count > 1").select("digest"), "canon-shared")

    def holders(rows: DataFrame, name: str, *ids: str) -> DataFrame:
        held = rows.join(shared, rows[name] == shared["digest"], "left_semi")
        return materialise(held.select(F.explode(F.array(*ids)).alias("held_id")).distinct(), "canon-holders")

    def of(ids: DataFrame) -> DataFrame:
        ids = F.broadcast(ids) if fits(ids, 64, 16 << 20) else ids  # a proven size; else they meet in a shuffle
        return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("held_id")), "left_semi")

    texts = of(holders(own, "own", "doc_id"))
    touched = holders(changed, "changed", "doc_id")
    if not touched.isEmpty():
        around = of(holders(changed, "changed", "doc_id", "next_id"))
        texts = texts.unionByName(edited_texts(of(touched), around, following).select("doc_id", F.col("edited").alias("text")))
    split = materialise(split_digests(texts, shared), "canon-split")

    def settled(rows: DataFrame, name: str, as_: str) -> DataFrame:
        joined = rows.join(F.broadcast(split) if fits(split, 128, 16 << 20) else split, rows[name] == split["digest"], "left")
        return joined.withColumn(as_, F.when(F.col("digest").isNull(), F.col(name)).otherwise(F.concat(name, f"{name}_sha"))).drop("digest", name, f"{name}_sha")

    first = settled(own, "own", "fingerprint")
    second = settled(changed, "changed", "edited_fingerprint")
    return _paired(first, second)


def _paired(own: DataFrame, changed: DataFrame) -> DataFrame:
    """Each document's two fingerprints and its next one's side by side; repeated doc_ids by rank of their rows."""
    rank = "row_number() over (partition by doc_id, n_chars order by {}) as rank"
    own = materialise(own, "canon-first")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        pairs = own.join(changed.drop("n_chars").withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    else:
        a = own.selectExpr("*", rank.format("fingerprint"))
        b = changed.selectExpr("doc_id as __id", "n_chars as __n", "next_id", "edited_sha256", "edited_fingerprint", rank.format("edited_fingerprint")).withColumnRenamed("rank", "__rank")
        pairs = a.join(b, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("n_chars") == F.col("__n")) & (F.col("rank") == F.col("__rank")))
    ahead = own.groupBy("doc_id").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("doc_id", "__next")
    pairs = pairs.join(ahead, F.col("next_id").eqNullSafe(F.col("__next")))
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return pairs.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"))
