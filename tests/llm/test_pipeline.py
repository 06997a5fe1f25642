import corpus_pipeline

from bondflow.llm import shared

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = shared.kept(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = docs.count()
        assert before >= after > before / 2
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before
    assert sorted(out.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]


def odd_rows(spark):
    long = "und der " * 200_000
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "the cat and the dog are here", "en", "a", 3), (3, "x", "en", "a", 1), (3, "x", "en", "a", 1), (4, long, "de", "a", len(long)), (5, "\n\n", None, None, 2)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, row string, id bigint, count int"
    return spark.createDataFrame([(*r, "own", 7, 8) for r in rows], schema)


def test_stages_take_odd_rows_and_clashing_columns(spark):
    docs = odd_rows(spark)
    both = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars", "'own' as row", "7L as id", "8 as count"))
    for name, stage in corpus_pipeline.STAGES:
        for table, least in ((docs, 0), (both, 100)):
            out = stage(spark, table, SF)
            rows = out.collect()
            assert len(rows) >= least
            if name != "tokens":
                assert out.columns == docs.columns and all((r["row"], r["id"], r["count"]) == ("own", 7, 8) for r in rows)
            if name in ("lines", "tokens"):
                assert len(rows) == table.count()
            if name in ("near_duplicates", "benchmark"):
                assert {1, 2, 3, 4, 5, None} <= {r["doc_id"] for r in rows}
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_short_passage_in_a_long_text_is_found(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"].split()[:13]
    rows = [(1, " ".join(["filler"] * 500 + item + ["words"] * 500)), (2, " ".join(["filler"] * 500 + item[:12] + ["words"] * 500))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    assert [r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, SF).collect()] == [2]
