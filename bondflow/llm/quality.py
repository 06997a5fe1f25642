"""Document quality by hierarchical empirical Bayes.

Evidence: a logistic classifier of bad documents (low quality or toxic) over word presence
and the shape of the text. It is fitted on the driver to at most `per_class` labelled
rows of each class (whole texts of up to `most_chars`), by Newton steps in numpy, on the
words whose association with the class is significant. Its score of every document,
corrected for the classes' shares among the labelled rows, is that document's chance of
being bad by its text alone.

Hierarchy: labelled outcomes outside the held-out fifth are counted by path (section of a
site), site and over all; each level's rate is drawn to that of the level above by a beta
prior, whose strength is fitted per level by moments of the beta-binomial. A sparse path so
takes its site's rate, a sparse site the global one. Nothing is counted twice: the prior of a
path leaves the path's own pages out of its site, and a labelled document's posterior leaves
its own label out. A document's final odds are its own odds by its text times its path's
posterior odds over the global odds. Counts are grouped with map-side partial sums.

Defined results: a null or wordless text has no word evidence; null sites and sections are
groups of their own. Rows are judged one by one, so repeated rows get like results. With
labels of fewer than two classes all documents get the labels' rate (0 without labels). Several
label rows of an id count each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bondflow.llm import shared, textops
from bondflow.llm.langid import held_out
from bondflow.llm.urlfilter import fitted

_UPPER = textops.word_bytes((0, 64), (91, 255))
_LETTER = textops.word_bytes((0, 64), (91, 96), (123, 127))
_DIGIT = textops.word_bytes((0, 47), (58, 255))
_MARK = textops.word_bytes((0, 32), (48, 57), (65, 90), (97, 122), (127, 255))
SHAPES = 5


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the words used
    weights: np.ndarray  # shapes, words, intercept
    centre: np.ndarray
    spread: np.ndarray
    shift: float  # log odds that correct for the classes' shares in the sample


def shapes(words: textops.Words, first: np.ndarray) -> np.ndarray:
    """Shares of upper case, marks, digits and non-spaces among a text's bytes, and log of its words' number."""
    data = words.data[: first[-1]].tobytes()
    out = np.zeros((len(first) - 1, SHAPES))
    n = np.maximum(np.diff(first), 1)
    for i, table in enumerate((_UPPER, _MARK, _DIGIT, textops.NOT_SPACE)):
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(data.translate(table.tobytes()), np.uint8), dtype=np.int64)])
        out[:, i] = np.diff(sums[first]) / n
    out[:, 4] = np.log1p(words.counts())
    return out


def features(column: pa.Array, chosen: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: rows from and to, shapes, and (text, word) pairs; of chosen words only, as their places, if these are given."""
    for first, end, data, at in textops.blocks(column):
        words = textops.Words(data, at, textops.ALNUM)
        shape = shapes(textops.Words(data, at, textops.NOT_SPACE, lower=False), at)
        h = words.hashes()
        text = np.repeat(np.arange(end - first), words.counts())
        if chosen is not None:
            place = np.searchsorted(chosen, h)
            place[place == len(chosen)] = 0
            hit = chosen[place] == h if len(chosen) else np.zeros(len(h), bool)
            pairs = np.unique(np.stack([text[hit], place[hit]]), axis=1)
            yield first, end, shape, pairs[0], pairs[1]
        else:
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield first, end, shape, text[new], h[new]


def train(texts: list[str], bad: np.ndarray, rate: float, most_words: int = 400, least_g: float = 22.0) -> Model | None:
    """Fits the classifier; rate: the share of bad documents among all labelled ones."""
    n_bad = int(bad.sum())
    if not 0 < n_bad < len(bad):
        return None
    shape, owner, word = [], [], []
    for first, _, s, t, w in features(pa.array(texts, pa.string())):
        shape.append(s)
        owner.append(t + first)
        word.append(w)
    shape, owner, word = np.concatenate(shape), np.concatenate(owner), np.concatenate(word)
    distinct, back = np.unique(word, return_inverse=True)
    a = np.bincount(back, weights=bad[owner], minlength=len(distinct))
    b = np.bincount(back, minlength=len(distinct)) - a
    share = (a + b) / len(bad)
    fit_ = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0)
    cells = ((a, n_bad * share), (b, (len(bad) - n_bad) * share), (n_bad - a, n_bad * (1 - share)), (len(bad) - n_bad - b, (len(bad) - n_bad) * (1 - share)))
    g = 2 * sum(fit_(seen, expected) for seen, expected in cells)  # likelihood-ratio test of independence
    g[a + b < 5] = 0
    top = np.argsort(-g, kind="stable")[:most_words]
    chosen = np.sort(distinct[top[g[top] >= least_g]])
    centre, spread = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    x = np.zeros((len(bad), SHAPES + len(chosen) + 1))
    x[:, :SHAPES] = (shape - centre) / spread
    place = np.searchsorted(chosen, word)
    place[place == len(chosen)] = 0
    hit = chosen[place] == word if len(chosen) else np.zeros(len(word), bool)
    x[owner[hit], SHAPES + place[hit]] = 1
    x[:, -1] = 1
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        weights -= np.linalg.solve(h, x.T @ (p - bad) + ridge * weights)
    own = n_bad / len(bad)
    return Model(chosen, weights, centre, spread, float(np.log(rate / (1 - rate)) - np.log(own / (1 - own))))


def logits(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for first, end, shape, text, place in features(column, model.words):
        score = (shape - model.centre) / model.spread @ model.weights[:SHAPES] + model.weights[-1]
        score += np.bincount(text, weights=model.weights[SHAPES + place], minlength=end - first)
        out[first:end] = score + model.shift
    return np.clip(out, -12, 12)


def learned(labels: DataFrame, key: str) -> DataFrame:
    """(_id, bad) of the labels that may be learned from: outside the held-out fifth, nothing null. labels: (key, bad)."""
    return labels.where(F.col(key).isNotNull() & F.col("bad").isNotNull() & ~held_out(key)).select(F.col(key).alias("_id"), F.col("bad").cast("int").alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = 4000, most_chars: int = 20_000) -> tuple[Model | None, float]:
    """The classifier and the rate of bad documents, from labelled documents outside the held-out fifth. labels: (key, bad)."""
    seen = learned(labels, key)
    counts = {r["bad"]: r["n"] for r in seen.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rate = counts.get(1, 0) / total if total else 0.0
    if not 0 < rate < 1:
        return None, rate
    chance = F.pmod(F.xxhash64(F.col("_id"), F.lit("quality sample")), F.lit(1 << 40)) / float(1 << 40)
    picked = seen.where(chance < F.when(F.col("bad") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))).limit(3 * per_class)
    own = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") <= most_chars)
    rows = own.join(picked, F.col("_key") == F.col("_id")).select("_id", "_text", "bad").limit(3 * per_class).collect()
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    return train([r[1] or "" for r in rows], np.array([r[2] for r in rows], float), rate), rate


def levels(scored: DataFrame) -> DataFrame:
    """Adds site_bad, section_bad and all_bad, posterior rates of bad outcomes, to rows with site, section, own_n and own_bad (how many labels a row has, and how many bad ones); null sites and sections are values."""
    sections, _ = shared.kept(scored.groupBy("site", "section").agg(F.sum("own_n").cast("double").alias("n"), F.sum("own_bad").cast("double").alias("bad")), "sections")
    sites = sections.groupBy("site").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top, low = fitted(sites.where("n > 0")).first(), fitted(sections.where("n > 0")).first()
    rate, strong, weak = float(top["rate"] or 0.0), float(top["strength"] or 1e6), float(low["strength"] or 1e6)
    sites = sites.select(F.col("site").alias("_site"), F.col("n").alias("site_n"), F.col("bad").alias("site_sum"))
    known = sections.join(sites, F.col("site").eqNullSafe(F.col("_site"))).select(F.col("site").alias("_site"), F.col("section").alias("_section"), "n", "bad", "site_n", "site_sum")
    known, _ = shared.kept(known, "levels")
    mean = lambda strength, prior, bad, n: (strength * prior + bad) / (strength + n)
    out = scored.join(known, F.col("site").eqNullSafe(F.col("_site")) & F.col("section").eqNullSafe(F.col("_section")))
    others = mean(F.lit(strong), F.lit(rate), F.col("site_sum") - F.col("bad"), F.col("site_n") - F.col("n"))
    return out.select(
        *scored.columns,
        mean(F.lit(strong), F.lit(rate), F.col("site_sum") - F.col("own_bad"), F.col("site_n") - F.col("own_n")).alias("site_bad"),
        mean(F.lit(weak), others, F.col("bad") - F.col("own_bad"), F.col("n") - F.col("own_n")).alias("section_bad"),
        F.lit(rate).alias("all_bad"),
    )


def judge(docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", key: str = "doc_id", text: str = "text", most_bad: float = 0.5, **options) -> DataFrame:
    """For each row: key, text_bad (by the text alone), site_bad and section_bad (posterior rates), score (final chance of being good) and kept."""
    model, rate = fit(docs, labels, key, text, **options)
    prior = float(np.log(rate / (1 - rate))) if 0 < rate < 1 else -12.0 if rate == 0 else 12.0

    @textops.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = logits(model, batch.column(3)) if model else np.full(batch.num_rows, prior)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own)], names=["key", "site", "section", "logit"])

    rows = docs.select(F.col(key).alias("key"), F.col(site).cast("string").alias("site"), F.col(section).cast("string").alias("section"), F.col(text).alias("text"))
    outcomes = learned(labels, key).groupBy("_id").agg(F.count("*").alias("own_n"), F.sum("bad").alias("own_bad"))
    scored = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, site string, section string, logit double")
    scored = scored.join(outcomes, F.col("key") == F.col("_id"), "left").select("key", "site", "section", "logit", F.coalesce("own_n", F.lit(0)).alias("own_n"), F.coalesce("own_bad", F.lit(0)).alias("own_bad"))
    scored, _ = shared.kept(scored, "scored")
    odds = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-6)) / F.greatest(1 - F.col(c), F.lit(1e-6)))
    final = 1 / (1 + F.exp(-(F.col("logit") + odds("section_bad") - odds("all_bad"))))
    return levels(scored).select(F.col("key").alias(key), (1 / (1 + F.exp(-F.col("logit")))).alias("text_bad"), "site_bad", "section_bad", (1 - final).alias("score"), (final < most_bad).alias("kept"))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """judge() with bad labels from quality and toxic, the source as site and the language as its section."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return judge(docs, labels.select(F.col("doc_id").alias(options.get("key", "doc_id")), bad.cast("int").alias("bad")), **options)
