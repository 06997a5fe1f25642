import random

import pyarrow.parquet as pq

from bondflow.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    out = langid.report(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == pq.read_metadata(DOCS).num_rows
    held = [r for r in out if r["held_out"] and len(r["text"]) > 20]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_texts_without_letters_and_odd_rows():
    model = langid.train(["the cat and the dog are in the house"] * 20 + ["der hund und die katze sind im haus"] * 20, ["en"] * 20 + ["de"] * 20)
    assert model.predict(None) == model.predict("") == model.predict("12 !? 3") == model.predict("² ½ Ⅷ ①_") == ("und", 0.0, True)
    assert model.predict("the house and the cat " * 5000)[0] == "en"
    assert model.predict("die katze und der hund")[0] == "de"
    assert model.predict("x" * 300_000)[0] in ("en", "de")
    assert langid.train([], []).predict("abc") == ("und", 0.0, True)


def test_the_sample_is_bounded(spark):
    rows = [(i, f"text {i}", f"l{i % 7}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "count bigint, text string, n string")
    got = langid.sample(docs, key="count", lang="n", per_language=100, most_rows=300, most_languages=5)
    assert len({y for _, y in got}) == 5 and 100 < len(got) <= 600
    assert len(langid.sample(docs, key="count", lang="n")) == sum(1 for r in langid.sample(docs, key="count", lang="n", most_rows=10**6))


def test_table(spark):
    docs = spark.createDataFrame([(1, "abc", None, 1.0), (None, None, "en", 2.0), (1, "abc", None, 1.0)], "doc_id bigint, text string, lang string, score double")
    out = langid.report(docs).collect()
    assert [r["lang_pred"] for r in out] == ["und"] * 3 and not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert langid.keep_known(docs).count() == 0
    assert langid.report(docs.limit(0)).count() == 0


def test_unknown_languages_and_junk_are_rejected_despite_wrong_labels():
    rows = [(t, y) for t, y in zip(*pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text", "lang"]).to_pydict().values(), strict=True) if t and y and len(t) <= 20_000]
    random.Random(1).shuffle(rows)
    learn, other = rows[:3000], rows[3000:5000]
    wrong = [(t, "de" if y != "de" else "en") if i % 100 == 0 else (t, y) for i, (t, y) in enumerate(learn)]
    model = langid.train([t for t, _ in wrong], [y for _, y in wrong])
    draw = random.Random(2)
    planted = ["kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "все люди рождаются свободными и равными", "すべての人間は生まれながらにして自由である"]
    planted += ["x" * 500, "".join(draw.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(400))]
    assert [t[:10] for t in planted if not model.predict(t)[2]] == []
    assert sum(model.predict(t)[2] for t, _ in other) <= 0.03 * len(other)
