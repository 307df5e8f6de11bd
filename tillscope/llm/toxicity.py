"""Toxicity from averaged subword embeddings and a linear softmax, trained in numpy.

A word is the mean of the vectors of its character n-grams; a window is the mean of
its words; a softmax over the window gives the chance of either label. Both the
vectors and the softmax are trained together. A text is as toxic as its two worst
windows, so a remark does not drown in a long text. Misspelt words share most n-grams with the
words seen in training.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tillscope.llm.sampling import labelled_sample
from tillscope.llm.tokens import text_parts
from tillscope.llm.workers import give_back, turn_to

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Sizes of the model and bounds of what it is fitted on."""

    buckets: int = 1 << 16  # n-gram vectors, shared by hash
    width: int = 12  # numbers in a vector
    shortest: int = 3  # n-grams of a word with its two borders
    longest: int = 6
    window: int = 8  # words averaged together
    per_label: int = 2500  # texts of each label to learn from
    longest_text: int = 20_000  # characters; longer ones are not learned from
    rounds: int = 6
    batch: int = 2048
    step: float = 0.05
    seed: int = 11
    memo: int = 200_000  # word scores a worker keeps


@dataclass
class Model:
    grams: np.ndarray  # buckets x width
    weights: np.ndarray  # width
    bias: float
    slope: float  # window score to chance of a text
    shift: float
    settings: Settings


def word_grams(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of ``words``, and where each word's begin."""
    text = "".join(f"<{word}>" for word in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(word) + 2 for word in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    rolling = np.zeros(len(codes), np.uint64)
    found, owners = [], []
    for n in range(1, settings.longest + 1):
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        rolling = (rolling ^ shifted) * _MIX
        rolling ^= rolling >> np.uint64(29)
        if n < settings.shortest:
            continue
        whole = left >= n
        found.append((rolling[whole] % np.uint64(settings.buckets)).astype(np.int32))
        owners.append(owner[whole])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return found[order], starts


def word_vectors(words: list[str], grams: np.ndarray, settings: Settings) -> np.ndarray:
    """Mean n-gram vector per word; every word has at least one n-gram, its borders count."""
    if not words:
        return np.zeros((0, grams.shape[1]), np.float32)
    buckets, starts = word_grams(words, settings)
    sums = np.add.reduceat(grams[buckets], starts)
    counts = np.diff(np.append(starts, len(buckets)))
    return sums / counts[:, None]


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores, each once, as they first occur.

    A word said a thousand times would otherwise fill windows by itself.
    """
    return list(dict.fromkeys(_WORD.findall(text.lower()))) if text else []


def worst_windows(scores: np.ndarray, sizes: np.ndarray, window: int, beside=None):
    """Highest window mean per text and the word it starts at; -inf where there is none.

    ``scores`` are the words of all texts one after another. A text shorter than a
    window is one window. ``beside``: windows that share a word with the one starting
    there are left out.
    """
    best = np.full(len(sizes), -np.inf)
    place = np.zeros(len(sizes), np.int64)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    small = (sizes > 0) & (sizes < window)
    if beside is None:
        best[small] = (total[starts[small] + sizes[small]] - total[starts[small]]) / sizes[small]
        place[small] = starts[small]
    full = np.flatnonzero(sizes >= window)
    if len(full):
        means = (total[window:] - total[:-window]) / window
        # windows that reach into the next text do not count
        last = starts[full] + sizes[full] - window
        allowed = np.zeros(len(means) + 1, np.int64)
        np.add.at(allowed, starts[full], 1)
        np.add.at(allowed, last + 1, -1)
        allowed = np.cumsum(allowed)[:-1] > 0
        if beside is not None:
            near = beside[full][:, None] + np.arange(1 - window, window)
            near = near[(near >= starts[full][:, None]) & (near <= last[:, None])]
            allowed[near] = False
        means = np.where(allowed, means, -np.inf)
        best[full] = np.maximum.reduceat(means, starts[full])
        hit = np.flatnonzero(allowed & (means == np.repeat(best, sizes)[: len(means)]))
        owner = np.searchsorted(starts, hit, side="right") - 1
        place[owner[::-1]] = hit[::-1]  # the first of several
    return best, place


def text_scores(scores: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Mean of the two worst windows that share no word; a missing second counts 0.

    So one doubtful word in an innocent text weighs half of two.
    """
    best, place = worst_windows(scores, sizes, window)
    second, _ = worst_windows(scores, sizes, window, place)
    return np.where(sizes > 0, (best + np.where(np.isfinite(second), second, 0.0)) / 2, 0.0)


def train(texts: list[str], labels: list[int], settings: Settings | None = None) -> Model:
    """Fit vectors and softmax together on texts labelled 0 or 1.

    The first round takes windows at random from texts of both labels; later ones take
    the worst window of each text, and some at random from those labelled 0. A last
    logistic fit turns the two worst windows' mean score into the chance of a text. With fewer
    than two labels the model gives every text the label it saw, or 0.
    """
    settings = settings or Settings()
    rng = np.random.default_rng(settings.seed)
    labels_ = np.asarray(labels, np.int64)
    grams = rng.uniform(-1, 1, (settings.buckets, settings.width)) / settings.width
    model = Model(grams.astype(np.float32), np.zeros(settings.width), 0.0, 1.0, 0.0, settings)
    vocabulary: dict[str, int] = {}
    # a text's words are held as numbers only
    ids = [
        np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text_words(text)], int)
        for text in texts
    ]
    if len(set(labels)) < 2 or not vocabulary:
        model.slope = 0.0
        model.shift = 20.0 if labels and min(labels) == 1 else -20.0
        return model
    words = list(vocabulary)
    sizes = np.array([len(d) for d in ids])
    flat = np.concatenate(ids)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    buckets, at = word_grams(words, settings)
    counts = np.diff(np.append(at, len(buckets)))
    fit = _Adam(model, settings.step)
    for round_ in range(settings.rounds):
        random = rng.integers(0, np.maximum(sizes - settings.window, 0) + 1, (6, len(sizes)))
        random = np.where(sizes > 0, starts + random, -1)
        if round_ == 0:
            chosen = [(p, labels_) for p in random]
        else:
            score = np.add.reduceat((model.grams @ model.weights)[buckets], at) / counts
            _, worst = worst_windows(score[flat], sizes, settings.window)
            clean = labels_ == 0
            chosen = [(np.where(sizes > 0, worst, -1), labels_)] * 2
            chosen += [(np.where(clean, p, -1), labels_) for p in random[:2]]
        places = np.concatenate([p for p, _ in chosen])
        wanted = np.concatenate([y for _, y in chosen])
        owner = np.tile(np.arange(len(sizes)), len(chosen))
        usable = np.flatnonzero(places >= 0)
        for part in np.array_split(
            rng.permutation(usable), max(1, len(usable) // settings.batch)
        ):
            length = np.minimum(sizes[owner[part]], settings.window)
            spots = places[part][:, None] + np.arange(settings.window)
            inside = np.arange(settings.window) < length[:, None]
            fit.learn(flat, spots, inside, length, wanted[part], buckets, at, counts)
    score = np.add.reduceat((model.grams @ model.weights)[buckets], at) / counts
    whole = text_scores(score[flat], sizes, settings.window)
    model.slope, model.shift = _calibrated(whole[sizes > 0], labels_[sizes > 0])
    return model


class _Adam:
    """Adam steps on n-gram vectors, softmax weights and bias at once."""

    def __init__(self, model: Model, step: float) -> None:
        self.model, self.step, self.time = model, step, 0
        self.first = [np.zeros_like(model.grams), np.zeros_like(model.weights), np.zeros(1)]
        self.second = [np.zeros_like(x) for x in self.first]

    def learn(self, flat, spots, inside, length, wanted, buckets, at, counts) -> None:
        model, m = self.model, self.model.settings
        if not self.time:  # weights of both signs, so that vectors get a gradient at once
            model.weights = np.where(np.arange(m.width) % 2, -1.0, 1.0)
        used, where = np.unique(flat[np.minimum(spots, len(flat) - 1)], return_inverse=True)
        where = where.reshape(spots.shape)
        own = np.repeat(np.arange(len(used)), counts[used])
        within = np.arange(len(own)) - np.repeat(np.cumsum(counts[used]) - counts[used], counts[used])
        gram = buckets[np.repeat(at[used], counts[used]) + within]
        begin = np.cumsum(counts[used]) - counts[used]
        vectors = np.add.reduceat(model.grams[gram], begin) / counts[used][:, None]
        hidden = (vectors[where] * inside[:, :, None]).sum(1) / length[:, None]
        chance = 1 / (1 + np.exp(-np.clip(hidden @ model.weights + model.bias, -30, 30)))
        share = np.where(wanted == 1, wanted.mean(), 1 - wanted.mean())
        error = (chance - wanted) / (2 * np.maximum(share, 1e-9)) / len(wanted)
        to_words = (error / length)[:, None] * inside
        per_word = np.bincount(where.ravel(), to_words.ravel(), len(used)) / counts[used]
        per_gram = np.bincount(gram, np.repeat(per_word, counts[used]), m.buckets)
        touched = np.flatnonzero(per_gram)
        slopes = [
            per_gram[touched, None] * model.weights,
            hidden.T @ error,
            np.array([error.sum()]),
        ]
        self.time += 1
        places = [touched, slice(None), slice(None)]
        bias = np.array([model.bias])
        for x, place, slope, one, two in zip(
            (model.grams, model.weights, bias), places, slopes, self.first, self.second, strict=True
        ):
            one[place] = 0.9 * one[place] + 0.1 * slope
            two[place] = 0.99 * two[place] + 0.01 * slope**2
            x[place] -= (
                self.step
                * (one[place] / (1 - 0.9**self.time))
                / (np.sqrt(two[place] / (1 - 0.99**self.time)) + 1e-8)
            )
        model.bias = float(bias[0])


def _calibrated(score: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the texts' scores."""
    scale = max(float(np.std(score)), 1e-9)
    x = np.stack([score / scale, np.ones(len(score))], 1)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 0.1 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w -= np.linalg.solve(bend, slope)
    return float(w[0] / scale), float(w[1])


class Scorer:
    """Scores texts in a worker; keeps the scores of words it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.per_gram = (model.grams @ model.weights)[:, None]
        self.known: dict[str, float] = {}

    def _words(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        except KeyError:
            new = list(set(words).difference(self.known))
            if len(self.known) + len(new) > self.model.settings.memo:
                self.known.clear()
                new = list(set(words))
            scores = word_vectors(new, self.per_gram, self.model.settings)[:, 0]
            self.known.update(zip(new, scores.tolist(), strict=True))
            return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Chance of label 1 per text; a text without words is as toxic as no window."""
        m = self.model
        docs = [text_words(text) for text in texts]
        words = [word for doc in docs for word in doc]
        sizes = np.array([len(doc) for doc in docs], np.int64)
        whole = text_scores(self._words(words), sizes, m.settings.window)
        raw = m.slope * whole
        raw = np.where(sizes > 0, raw + m.shift, -20.0 if m.slope else m.shift)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


_FITTED = "grams binary, weights binary, bias double, slope double, shift double"
_FITTED_NAMES = [part.split()[0] for part in _FITTED.split(", ")]


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on a bounded, hash-chosen sample of ``docs`` (doc_id, text) that ``labels``
    (doc_id, label) calls 0 or 1; other labels are ignored.

    One executor task reads the sample, at most ``per_label`` texts of each label, and
    trains; only the model, of fixed size, comes to the driver.
    """
    settings = settings or Settings()
    known = labels.where(F.col("label").isin(0, 1))
    sample = labelled_sample(docs, known, settings.per_label, settings.longest_text)

    def learn(texts: pa.Table) -> pa.Table:
        turn_to("toxicity")
        rows = texts.sort_by([("label", "ascending"), ("rank", "ascending")])
        model = train(rows["text"].to_pylist(), rows["label"].to_pylist(), settings)
        fields = (model.grams.tobytes(), model.weights.tobytes(), model.bias, model.slope, model.shift)
        del texts, rows
        give_back()
        return pa.table({name: [x] for name, x in zip(_FITTED_NAMES, fields, strict=True)})

    texts = sample.select(F.col("label").cast("int").alias("label"), "rank", "text")
    fitted = texts.groupBy().applyInArrow(learn, _FITTED).collect()
    if not fitted:
        return train([], [], settings)
    row = fitted[0]
    grams = np.frombuffer(row["grams"], np.float32).reshape(settings.buckets, settings.width)
    weights = np.frombuffer(row["weights"], np.float64)
    return Model(grams, weights, row["bias"], row["slope"], row["shift"], settings)


def score_toxicity(
    docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True
) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Every whole text is scored. Null and empty texts, and texts without a word
    character, score near 0 unless only toxic rows were learned from. Equal texts score
    alike, an empty table gives an empty one, columns named score or predicted are
    replaced, all others pass through; the text too unless ``keep_text`` is false. The
    model has a fixed size and is broadcast.
    """
    others = [c for c in docs.columns if c not in ("score", "predicted", text)]
    source = docs.select(*(F.col(f"`{c}`") for c in (*others, text)))
    result = source if keep_text else source.drop(text)
    schema = StructType(
        [*result.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("toxicity")
        scorer = Scorer(shared.value)
        for batch in batches:
            parts = [scorer.scores(texts) for _, _, texts in text_parts(batch.columns[-1])]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            columns = batch.columns if keep_text else batch.columns[:-1]
            columns += [pa.array(scores), pa.array((scores >= 0.5).astype("int32"))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            give_back()  # the worker lives on beside the next stage

    return source.mapInArrow(score, schema)
