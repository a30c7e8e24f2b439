"""Relations of the analysis engine made from the bundled tables, so that its operators can be checked in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL that both engines run as it is; each reads one of the tables.
PATH = """concat(source, '/', CASE doc_id % 11 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'tests/' WHEN 2 THEN '__tests__/' WHEN 3 THEN '.cfg/' WHEN 4 THEN 'testdata/' ELSE '' END,
 lang, '/', CASE WHEN doc_id % 13 = 0 THEN 'test_' ELSE 'f' END, CAST(doc_id AS STRING),
 CASE doc_id % 8 WHEN 0 THEN '.go' WHEN 1 THEN '_test.go' WHEN 2 THEN '.d.ts' WHEN 3 THEN '.test.ts' WHEN 4 THEN '.py' WHEN 5 THEN '.rs' WHEN 6 THEN '.JS' ELSE '.txt' END)"""
FILES = f"SELECT doc_id, {PATH} AS path, text FROM documents"
LEADING = """CASE doc_id % 7 WHEN 0 THEN concat('// Code generated by x DO NOT EDIT.', chr(10)) WHEN 1 THEN concat('/* a', chr(10), ' @Generated */', chr(10))
 WHEN 2 THEN concat('# linguist-generated', chr(10)) WHEN 3 THEN concat('// plain', chr(10), '// Code generated y DO NOT EDIT. no', chr(10)) WHEN 4 THEN concat('x // @generated', chr(10)) ELSE '' END"""
#: Before the edit, then after it, as rows of functions; cc is filled in by each engine.
EDIT_DROP, EDIT_GROW, EDIT_FLIP, EDIT_ADD = "(conv_id + turn) % 7 = 0", "(conv_id + turn) % 5 = 0", "(conv_id + turn) % 13 = 0", "conv_id % 6 = 0 AND turn = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """rev, language, path, pos, text, line, end_line: words between blanks, without a shuffle."""
    words = F.expr("posexplode(flatten(transform(split(text, '\\n'), (l, i) -> transform(regexp_extract_all(l, '[^ \\\\t\\\\r\\\\n]+', 0), t -> struct(t as text, i + 1 as line))))) as (pos, w)")
    rows = docs.select(F.lit("r").alias("rev"), F.col("lang").alias("language"), path_of(key), words)
    return rows.select("rev", "language", "path", "pos", "w.text", "w.line", F.col("w.line").alias("end_line"))


def text_files(docs: DataFrame, rev=None) -> DataFrame:
    """rev, language, path, text: the files of tokens() whole."""
    return docs.select((F.lit("r") if rev is None else rev).alias("rev"), F.col("lang").alias("language"), path_of(), "text")


def path_of(key: str = "doc_id"):
    """d and the id, filled up to eight digits; longer ids are kept whole."""
    return F.expr(f"concat('d', lpad(cast({key} as string), greatest(8, length(cast({key} as string))), '0'))").alias("path")


def source_lines(docs: DataFrame) -> DataFrame:
    """rev, path, bucket, line of lines that aren't blank; a quarter of the documents are tests."""
    lines = docs.select(F.lit("r").alias("rev"), path_of(), F.when(F.col("doc_id") % 4 == 0, "tests").otherwise("source").alias("bucket"), F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return lines.where(F.col("l").rlike(r"(?U)\S")).select("rev", "path", "bucket", (F.col("i") + 1).alias("line"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as functions: path, name, line, cc, sloc, bucket, mass, fn_id, ord."""
    from ..functions.text import mass, non_blank_lines

    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(
        F.lit("r").alias("rev"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), "conv_id", "turn", F.col("role").alias("name"), (F.col("turn") + 1).cast("int").alias("line"),
        (F.regexp_count("text", F.lit("[,;:?!]")) + 1).cast("int").alias("cc"), non_blank_lines(F.col("text")).cast("int").alias("sloc"),
        F.when(F.col("conv_id") % 4 == 0, "tests").otherwise("source").alias("bucket"),
    )
    rows = rows.withColumn("mass", mass(F.col("cc"), F.col("sloc")))
    rows = rows.withColumn("fn_id", fn_id(0)).withColumn("ord", F.col("turn").cast("int"))
    return rows.withColumn("parent_id", F.when(F.lit(False), F.col("fn_id"))).withColumn("depth", F.lit(0))


def fn_id(added: int):
    """Key of a function: its conversation and turn, and 900 for one that the edit adds."""
    return F.struct("conv_id", "turn", F.lit(added).alias("added"))


def fn_number(key: str):
    """A key as the text that the SQL gives; null where there is no function."""
    return F.when(F.col(key).isNotNull(), F.concat_ws("/", *(F.col(f"{key}.{c}").cast("string") for c in ("conv_id", "turn", "added")))).alias(key)


def functions_head(base: DataFrame) -> DataFrame:
    """A fixed edit of functions(): some dropped, grown, moved to the other bucket or added."""
    from ..functions.text import mass

    kept = base.where(f"not ({EDIT_DROP})")
    edited = kept.withColumn("cc", F.expr(f"if({EDIT_GROW}, cc + 11, cc)")).withColumn("bucket", F.expr(f"if({EDIT_FLIP}, if(bucket = 'tests', 'source', 'tests'), bucket)"))
    extra = base.where(EDIT_ADD).withColumn("fn_id", fn_id(900)).withColumn("line", F.lit(90)).withColumn("ord", F.lit(90)).withColumn("cc", F.lit(12))
    return edited.unionByName(extra).withColumn("mass", mass(F.col("cc"), F.col("sloc")))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, before_start, before_count, after_start, after_count: one deletion and one insertion a file."""
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    parts = F.array(F.struct(F.lit(2).alias("s"), F.lit(1).alias("b"), F.lit(1).alias("t"), F.lit(0).alias("a")), F.struct((F.col("conv_id") % 4 + 3).cast("int").alias("s"), F.lit(0).alias("b"), (F.col("conv_id") % 4 + 3).cast("int").alias("t"), F.lit(2).alias("a")))
    rows = ids.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("path"), F.explode(parts).alias("h"))
    return rows.select("path", F.col("h.s").alias("before_start"), F.col("h.b").alias("before_count"), F.col("h.t").alias("after_start"), F.col("h.a").alias("after_count"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, rev, ts: orders as commits in log order by key, so that it disagrees with the dates."""
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_orderkey").alias("top"))
    return orders.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("o_orderkey")).alias("pos"), F.col("o_orderkey").cast("string").alias("rev"), F.col("o_orderdate").cast("timestamp").alias("ts"))
