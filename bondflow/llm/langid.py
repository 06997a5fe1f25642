"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the 1- to 4-letter runs of its words with their ends marked,
lower-cased, hashed to buckets. Its vector is the mean of the buckets' embeddings; a
linear softmax gives each language's probability. Embeddings and weights are trained
together by stochastic gradient descent in numpy on the driver, on a sample of at
most `per_language` labelled rows a language and `most_rows` in all (texts up to
`most_chars`, whole), of the `most_languages` languages with most rows; what other labels
there are is not learned.
A part of that sample is kept out of training: it sets the softmax's temperature and
two bounds, below either of which a prediction is rejected: on its score, and on the
share of the text's subwords that occur in training (a text of no known language may
score high by a few of them). Each is what all but `alpha` / 2 of the part's rightly
predicted texts reach, so about `alpha` of clean texts is rejected and rows with a
wrong label count for neither. The bound on the score is half way from 1 / languages
to 1 at least. Prediction reads whole texts in blocks;
as embedding and weights are both linear, tasks get their product, one row a bucket.

Defined results: a null text, or one without a letter (numerals such as \u2167 or \u00bd are
none), gets `und`, score 0, and is rejected. A text is judged by itself, so repeated rows and ties in order do not
matter; among equally probable languages the first by name wins. Rows with a null
language or id are never learned from. Without any labelled row all get `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondflow.llm import textops

BUCKETS = 1 << 17
SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")  # finds some numerals too
BLOCK_CHARS = 1 << 17


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's subwords, in blocks of bounded size."""
    letters = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    first = 0
    while first < len(letters) - 1:
        end = min(len(letters), first + BLOCK_CHARS)
        if end < len(letters) and (space := letters.rfind(" ", first + 1, end)) > 0:
            end = space + 1
        code = np.frombuffer(letters[first:end].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        space = code == 32
        first = end - 1 if end < len(letters) else end
        for n in SIZES:
            m = len(code) - n + 1
            if m <= 0:
                continue
            inside = ~space[:m] if n == 1 else np.ones(m, bool)
            for i in range(1, n - 1):
                inside &= ~space[i : i + m]
            hashed = code[:m].copy()
            for i in range(1, n):
                hashed *= np.uint64(0x9E3779B97F4A7C15)
                hashed += code[i : i + m]
            if n == 2:
                inside &= ~(space[:m] & space[1:])
            yield ((textops.mix(hashed[inside] + np.uint64(n << 56)) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs, as shares."""
    found = list(subwords(text))
    ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
    return ids, n / max(n.sum(), 1)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times weights
    bias: np.ndarray
    temperature: float
    least: float
    seen: np.ndarray  # which buckets occur in training
    least_seen: float

    def logits(self, text: str) -> tuple[np.ndarray, float]:
        """Logits, and the share of the text's subwords that occur in training."""
        total, n, seen = np.zeros(len(self.languages)), 0, 0
        for ids in subwords(text):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
            seen += int(np.count_nonzero(self.seen[ids]))
        return total / max(n, 1) + self.bias, seen / max(n, 1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether the prediction is rejected."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        logits, seen = self.logits(text)
        p = softmax(logits / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.least or seen < self.least_seen)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], width: int = 12, epochs: int = 4, rate: float = 8.0, calibrate: float = 0.2, alpha: float = 0.01, seed: int = 7) -> Model:
    """Fits embeddings, weights, temperature and the rejection bounds."""
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(BUCKETS, bool), 0.0)
    number = {y: i for i, y in enumerate(languages)}
    draw = np.random.default_rng(seed)
    bags = [(*bag(t), number[y]) for t, y in rows]
    held = draw.random(len(bags)) < calibrate
    learn = [b for b, h in zip(bags, held, strict=True) if not h] or bags
    check = [b for b, h in zip(bags, held, strict=True) if h] or bags
    embed = draw.uniform(-1 / width, 1 / width, (BUCKETS, width))
    weight, bias = draw.normal(0, 0.1, (width, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in draw.permutation(len(learn)):
            ids, share, y = learn[i]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[ids]
            gap = softmax(hidden @ weight + bias)
            gap[y] -= 1
            back = weight @ gap
            weight -= 0.02 * step * np.outer(hidden, gap)
            bias -= 0.01 * step * gap
            embed[ids] -= step * share[:, None] * back
    seen = np.zeros(BUCKETS, bool)
    for ids, *_ in learn:
        seen[ids] = True
    model = Model(languages, (embed @ weight).astype(np.float32), bias, 1.0, 0.0, seen, 0.0)
    scores = np.array([share @ model.table[ids] + bias for ids, share, _ in check])
    truth = np.array([y for *_, y in check])
    own = np.arange(len(truth))
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    model.temperature = float(min(grid, key=lambda t: -np.log(softmax(scores / t)[own, truth] + 1e-12).sum()))
    right = scores.argmax(axis=1) == truth
    model.least = (1 + 1 / len(languages)) / 2
    if right.any():
        model.least = max(model.least, float(np.quantile(softmax(scores / model.temperature)[own, truth][right], alpha / 2)))
        model.least_seen = float(np.quantile(np.array([share[seen[ids]].sum() for ids, share, _ in check])[right], alpha / 2))
    model.least, model.least_seen = model.least - 1e-9, model.least_seen - 1e-9  # sums in another order may differ by as much
    return model


def held_out(key: str = "doc_id", folds: int = 5):
    """Rows that are never learned from: crc32 of the id as text divides by `folds`. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, per_language: int = 1500, most_chars: int = 20_000, most_languages: int = 1000, most_rows: int = 60_000) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: about `per_language` of each language, fewer where that were more than `most_rows` in all, by a hash of the id."""
    usable = docs.where(F.col(key).isNotNull() & ~held_out(key, folds) & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & (F.length(text) <= most_chars))
    usable = usable.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return []
    each = min(per_language, most_rows // len(sizes))
    share = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["n"])))))
    chance = F.pmod(F.xxhash64("key", F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    rows = usable.where(chance < share[F.col("lang")]).select("key", "text", "lang").limit(2 * each * len(sizes)).collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> Model:
    rows = sample(docs, text=text, lang=lang, **options)
    return train([t for t, _ in rows], [y for _, y in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """For each row: row (a struct of all its columns), lang_pred, score and rejected."""
    place = docs.columns.index(text)
    docs = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers, whatever the input

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            row = batch.column(0)
            out = [own.predict(t.as_py()) for t in row.field(place)]
            pred, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"row {docs.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, held_out, lang_pred, score, rejected of each document, from a model fitted on the documents not held out."""
    model = fit(docs, key=key, text=text, **options)
    out = predict(docs.select(key, text), model, text)
    out = out.select(F.col("row").getField(key).alias(key), "lang_pred", "score", "rejected")
    return out.select(key, held_out(key, options.get("folds", 5)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language prediction is not rejected, with all their columns."""
    return predict(docs, fit(docs, **options)).where(~F.col("rejected")).select("row.*")
