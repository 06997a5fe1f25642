import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest

from bondflow.llm import sentencepieces


@pytest.fixture(scope="module")
def model():
    return sentencepieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_are_the_librarys(model):
    own, draw = sentencepieces.Agenda(model, remember=500), random.Random(1)
    letters = "  ▁▁▁ab the in\n\n\téß你好😀\x00\x01�[]<0x0A>s>TH"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, "▁" * 50, " " * 37, "<s>", "</s>", "<unk>", "the  in   on", None]
    own.agree(texts, [own.encode(t) for t in texts])


def test_a_wrong_id_is_noticed(model):
    own = sentencepieces.Agenda(model)
    with pytest.raises(ValueError, match="differ"):
        own.agree(["abc"], [own.encode("abd")])


def test_every_new_word_is_compared(model):
    own = sentencepieces.Agenda(model)
    for t in ("The end is near", "  two  spaces ", "a\nb ende"):
        own.encode(t)
    assert [w for w, _ in own.fresh] == ["The", "end", "is", "near", "a\nb", "ende"] and [t for t, _ in own.odd] == ["  two  spaces "]
    own.agree_fresh()
    assert not own.fresh and not own.odd
    own.fresh.append(("abc", own.word_ids("abd")))
    with pytest.raises(ValueError, match="differ"):
        own.agree_fresh()
    own.fresh.clear()
    own.odd.append(("a  b", own.encode("a b")))
    with pytest.raises(ValueError, match="differ"):
        own.agree_fresh()


def test_table(spark, model):
    rows = [(1, "The end", "x"), (2, None, "y"), (2, None, "y"), (3, "", "z"), (None, "a\nb", "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r.asDict() for r in sentencepieces.digests(docs, model).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for (key, text, _), r in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), got, strict=True):
        ids = np.array(sentencepieces.agenda(model).library.encode(text or "", add_bos=True, add_eos=True), "<u4")
        assert (r["doc_id"], r["n_tokens"], r["ids_sha256"]) == (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert sentencepieces.digests(docs.limit(0), model).count() == 0
    assert sentencepieces.encode(docs, model).where("doc_id = 1").first()["decoded"] == "The end"


def test_new_words_merged_together_are_the_librarys(model):
    own, draw = sentencepieces.Agenda(model, remember=300), random.Random(2)
    letters = "ab the in\n\téß你好😀\x00�[]<0x0A>s>TH▁eraontioningschtst"
    words = [["".join(draw.choice(letters) for _ in range(draw.randrange(1, draw.choice((5, 12, 62, 63, 64, 65, 200))))) for _ in range(200)] for _ in range(40)]
    texts = [" ".join(w) for w in words] + [" ".join("x" * n for n in range(1, 130)), None, "", "a  b"]
    for most in (1, 9, len(texts)):
        ids = [i for first in range(0, len(texts), most) for i in own.encode_all(texts[first : first + most])]
        own.agree(texts, ids)
        own.agree_fresh()
        assert len(own.known) <= 300
    assert own.decode_all(ids) == [own.decode(i) for i in ids]


def test_a_wrong_id_of_many_is_noticed(model):
    own = sentencepieces.Agenda(model)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(3)]
    own.encode_all(texts)
    (a, x), (b, y) = own.fresh[70:72]
    own.fresh[70:72] = [(a, x + y), (b, b"")]  # the same ids in all, otherwise divided
    with pytest.raises(ValueError, match="differ"):
        own.agree_fresh()


def test_new_words_take_about_the_librarys_time(model):
    """A large corpus brings new words without end, so what they cost must not be many times a look-up."""
    draw = random.Random(3)
    texts = ["".join(draw.choice("etaoinshrdlu") for _ in range(9 * 20_000)) for _ in range(3)]
    texts = [" ".join(t[i : i + 9] for i in range(0, len(t), 9)) for t in texts]
    ratios = []
    for text in texts:
        own = sentencepieces.Agenda(model)
        began = time.process_time()
        own.library.encode(text.split(" "), num_threads=1)
        library = time.process_time() - began
        began = time.process_time()
        own.encode(text)
        ratios.append((time.process_time() - began) / library)
    assert min(ratios) < 2.5


def test_slices_by_bytes(spark, model):
    rows = [(i, None if i % 7 == 0 else " ".join(f"wörd{i}_{j}" for j in range(i % 50 * 20))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    whole = sentencepieces.digests(docs, model).orderBy("doc_id").collect()
    assert len(whole) == 120 and sentencepieces.digests(docs, model, slice_bytes=1000).orderBy("doc_id").collect() == whole
    assert sentencepieces.digests(docs, model, check="all").orderBy("doc_id").collect() == whole
