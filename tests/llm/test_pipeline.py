import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_and_drop(spark, tmp_path):
    import random

    rng = random.Random(9)
    parts = {"en": ["the", "ing", "th"], "de": ["sch", "ung", "ei"]}
    rows = []
    for i in range(40):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) + str(rng.randrange(1000)) for _ in range(80)), lang, "s", 0, "x"))
    copies = [(100 + i, rows[i][1].upper(), rows[i][2], "s", 0, "x") for i in range(5)]
    near = [(200 + i, rows[i + 10][1] + " added", rows[i + 10][2], "s", 0, "x") for i in range(5)]
    odd = [(300, None, "en", "s", 0, "x"), (301, "12 34 !", "en", "s", 0, "x"), (302, rows[20][1] + " 152.143.123.131", "en", "s", 0, "x")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, row_key string"
    docs = spark.createDataFrame(rows + copies + near + odd, shape)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == (set(range(5, 40)) | set(range(100, 105)))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, "")
        assert docs_out.count() == 0
