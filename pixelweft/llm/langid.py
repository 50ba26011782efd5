"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal: adaptive rates, elastic net) on a sample of
labelled training-fold documents that holds every language, then calibrated by one temperature on a part
of each language kept aside. Document frequencies are those of the whole training fold.
A text's vector is its n-gram counts times idf, divided by their sum; both sums add up over words, so a
worker scores each distinct word once.

Edge cases: null text or one without letters gives ``und`` with score 0; without training rows all do;
null languages are not learnt from; a label that only repeats is one class; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, held_out, sample_ids, small_batches, table, trimmed, word_ngrams

SIZES = (1, 2, 3)
BITS = 15


@dataclass
class LangModel:
    langs: list[str]
    weights: np.ndarray  # (features, languages + 1): idf times weight, and idf itself
    bias: np.ndarray
    temperature: float


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter (Unicode categories L*); numerals that aren't digits are none."""
    return any(map(str.isalpha, text or ""))


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = text.lower().split()
    found = [f for _, f in word_ngrams(words, SIZES, BITS)] if words else []
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for softmax loss; the last row of weights is the bias, which isn't penalised."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        w[-1] = -z[at[-1]] / ((beta + np.sqrt(n[at[-1]])) / alpha)
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f, x = rows[i]
            at, v = np.append(f, size - 1), np.append(x, 1.0)
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


class _Features:
    """In how many documents each feature occurs, each distinct word's features found once."""

    def __init__(self):
        self.memo, self.df, self.n = Memo(self._learn), np.zeros(1 << BITS, np.int64), 0

    def _learn(self, words: list[str]) -> list[np.ndarray]:
        found = list(word_ngrams(words, SIZES, BITS))
        owner, f = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.split(f[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])

    def add(self, texts: list) -> None:
        for a, b in small_batches(texts):
            split = [set(t.lower().split()) if t else set() for t in texts[a:b]]
            known = self.memo.learn(set().union(*split))
            for words in filter(None, split):
                here = np.zeros(len(self.df), bool)
                here[np.concatenate(list(map(known.__getitem__, words)))] = True
                self.df += here
                self.n += 1


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents with words, and of those with each feature: each task counts first, then sums meet."""

    def tally(batches):
        count = _Features()
        for batch in batches:
            count.add(batch.column(0).to_pylist())
        at = np.flatnonzero(count.df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(count.df[at], count.n), pa.int64())], ["f", "n"])

    got = docs.select("text").mapInArrow(trimmed(tally), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = got["f"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << BITS)
    df[f[f >= 0]] = n[f >= 0]
    return int(n[f < 0].sum()), df


def most_frequent(known: DataFrame, most: int) -> DataFrame:
    """(lang, n): the ``most`` languages with most distinct documents, of equals the first by name."""
    counts = known.select("doc_id", "lang").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return table(counts.orderBy(F.desc("n"), "lang").limit(most))


def _sample(known: DataFrame, sample: int, counts: DataFrame) -> DataFrame:
    """Ids of a sample of the documents, and of one of each language's: by the same hash, so most of them agree."""
    pairs = known.select("doc_id", "lang").distinct()
    each = max(50, sample // max(10, counts.count()))
    # A hash under a bound that four times as many pass at a mean leaves few rows of a language to rank.
    order = F.xxhash64(F.col("doc_id"), F.lit(101))
    low = pairs.join(F.broadcast(counts), "lang").where(order.cast("double") / 2.0**64 + 0.5 <= F.lit(4.0 * each) / F.col("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id"))
    own = low.withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id")
    return sample_ids(known, "doc_id", sample, 101).union(own).distinct()


def fit(docs: DataFrame, sample: int = 3000, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, scale: float = 20.0, most: int = 256) -> LangModel:
    """Learn from labelled training-fold documents, chosen by a hash of their ids: ``sample`` of all, and for
    each language at least a tenth of that (with more than ten languages an equal part, but 50), or all it has.
    Of labels with a very long tail the ``most`` frequent languages are learnt; the bound holds for the memory of the
    weights and for what is collected and broadcast."""
    fold = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    known = fold.where(F.col("lang").isNotNull())
    counts = most_frequent(known, most)
    known = known.join(F.broadcast(counts.select("lang")), "lang", "left_semi")

    def tally(batches):
        for batch in batches:
            rows = [_counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f for f, _ in rows], pa.list_(pa.int32())), pa.array([c for _, c in rows], pa.list_(pa.int64()))], ["doc_id", "lang", "f", "c"])

    rows = known.select("doc_id", "text", "lang").join(F.broadcast(_sample(known, sample, counts)), "doc_id", "left_semi")
    got = rows.mapInArrow(tally, "doc_id long, lang string, f array<int>, c array<long>").toArrow()
    lists = []
    for name in ("f", "c"):  # arrays, as Python's lists of a sample of many languages would be large
        col = got[name].combine_chunks()
        values, cuts = col.values.to_numpy(), col.offsets.to_numpy()
        lists.append([values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    got = [r for r in zip(got["doc_id"].to_pylist(), got["lang"].to_pylist(), *lists, strict=True) if len(r[2])]
    got.sort(key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    langs = sorted({r[1] for r in got})
    if not langs:
        return LangModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros(0), 1.0)
    n, df = document_frequencies(fold)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows, seen, aside, place = [], [0] * len(langs), [], {x: i for i, x in enumerate(langs)}
    for _, lang, f, c in got:
        x = c * idf[f]
        rows.append((f, scale * x / x.sum()))
        aside.append(seen[place[lang]] % 5 == 4)  # every fifth of each language
        seen[place[lang]] += 1
    y, aside = np.array([place[r[1]] for r in got]), np.array(aside)
    w, b = _ftrl([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(langs), epochs, alpha, beta, l1, l2)
    temperature = 1.0
    if aside.any():
        s = np.array([x @ w[f] for (f, x), a in zip(rows, aside, strict=True) if a]) + b

        def loss(t):
            u = s / t
            u = u - u.max(1, keepdims=True)
            return float((np.log(np.exp(u).sum(1)) - u[np.arange(len(u)), y[aside]]).mean())

        temperature = min(np.geomspace(0.25, 4, 33).tolist(), key=loss)
    return LangModel(langs, np.hstack([idf[:, None] * scale * w, idf[:, None]]).astype(np.float32), b, temperature)


class Scorer:
    """Scores texts in one worker, each distinct word once."""

    def __init__(self, model: LangModel):
        self.model, self.memo = model, Memo(self._learn)
        self.table = np.zeros((0, len(model.langs) + 1))

    def _learn(self, words: list[str]) -> range:
        out = np.zeros((len(words), len(self.model.langs) + 1))
        for owner, f in word_ngrams(words, SIZES, BITS):
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(cuts):
                out[owner[cuts]] += np.add.reduceat(self.model.weights[f], cuts, axis=0)
        first = len(self.table) if self.memo.known else 0
        self.table = np.concatenate([self.table[:first], out])
        return range(first, first + len(words))

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        langs, scores, m = [], [], self.model
        for a, b in small_batches(texts):
            split = [t.lower().split() if t and m.langs and has_letter(t) else [] for t in texts[a:b]]
            known = self.memo.learn(set().union(*split))
            for words in split:
                if not words:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                v = self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                s = (v[:-1] / v[-1] + m.bias) / m.temperature
                p = np.exp(s - s.max())
                p /= p.sum()
                langs.append(m.langs[int(p.argmax())])
                scores.append(float(p.max()))
        return langs, scores


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): fit on the training fold, predict every whole text."""
    model = fit(docs, **options)

    def run(batches):
        score = Scorer(model)
        for batch in batches:
            langs, scores = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows whose language is told with probability ``least`` or more; others and ``und`` go."""
    model = fit(docs, **options)

    def run(batches):
        score = Scorer(model)
        for batch in batches:
            langs, scores = score(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
