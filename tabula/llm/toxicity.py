"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, each with an embedding. The words of the whole text are averaged and
classified by a linear softmax; both are trained jointly in numpy. Misspellings and inflections that were never seen
share n-grams with what was seen. The average is a weighted one: a word weighs the more, exponentially, the more it
speaks for toxicity by itself, so that an insult among thousands of clean words isn't averaged away, and no word of a
text is left out. As long as nothing is learned all words weigh alike.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import bounded_sample, held_out, learnable, small_batches

#: Embeddings, their length, n-gram lengths.
BUCKETS, DIM, GRAMS = 1 << 17, 12, (3, 4, 5)
#: Log odds that make a word weigh e times as much; in training, the weight up to which a word is faint, and about how
#: many of a text's faint words are drawn anew in each epoch.
TEMPERATURE, FAINT, DRAWN = 1.0, 0.01, 128
#: Share of n-grams left out at random in each training step, so that no n-gram stands for a word alone.
DROPPED = 0.3
#: Labelled documents of each class that training sees at most, each with its whole text.
PER_CLASS = 2000
#: Texts of a training step, and the fewest steps, for few texts are learned in more epochs.
MINIBATCH, LEAST_STEPS = 128, 400
#: Word scores that a task keeps.
CACHE = 400_000
#: Letters of a run that are scored as one word.
PIECE = 60
_WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Embedding numbers of a word: its n-grams, with marked ends."""
    marked = f"<{word}>"
    parts = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(p.encode()) & (BUCKETS - 1) for p in parts]


def words_of(text: str | None) -> list[str]:
    """The runs of letters and digits; a run above PIECE letters as pieces that overlap by half and leave nothing out."""
    found = _WORD.findall((text or "").lower())
    if all(len(w) <= PIECE for w in found):
        return found
    return [w[at : at + PIECE] for w in found for at in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def weighed(gains: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The weights, of sum 1 in each text, of words by their gains; texts begin at `first` and have `size` words."""
    top = np.repeat(np.maximum.reduceat(gains, first), size)
    grown = np.exp((gains - top) / TEMPERATURE)
    return grown / np.repeat(np.add.reduceat(grown, first), size)


class _WordScores(dict):
    """Mean gain of a word's bag, computed once per word."""

    def __init__(self, gain: np.ndarray) -> None:
        super().__init__()
        self.gain = gain.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        bag = subwords(word)
        score = self[word] = sum(map(self.gain.__getitem__, bag)) / len(bag)
        return score


@dataclass
class SubwordModel:
    """`gain[k]` is what embedding k adds to the log odds of label 1, the product of its embedding and the softmax."""

    gain: np.ndarray
    bias: float

    def scorer(self):
        """A function from a text to its probability of label 1; a text without words has that of the bias alone. As the
        softmax is linear, a text's log odds are the weighted mean of its words' gains."""
        known = _WordScores(self.gain)

        def score(text: str | None) -> float:
            words = words_of(text)
            odds = self.bias
            if words:
                found = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                grown = np.exp((found - found.max()) / TEMPERATURE)
                odds += float(found @ grown / grown.sum())
            return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))

        return score


def _misspell(word: str, rng: np.random.Generator) -> str:
    """The word with one letter changed, doubled, dropped or swapped with the next."""
    if len(word) < 4:
        return word
    i = int(rng.integers(1, len(word) - 1))
    kind = int(rng.integers(4))
    if kind == 0:
        return word[:i] + "abcdefghijklmnopqrstuvwxyz0134"[int(rng.integers(30))] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1 :]
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :]


@dataclass
class Bags:
    """Bags of embedding numbers, one after another."""

    flat: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, words: Iterable[str]) -> Bags:
        flat, size = array("i"), array("i")
        for word in words:
            bag = subwords(word)
            flat.extend(bag)
            size.append(len(bag))
        sizes = np.array(size, dtype=np.int32)
        return cls(np.array(flat, dtype=np.int32), np.cumsum(sizes, dtype=np.int64) - sizes, sizes)

    def gather(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedding numbers of the chosen bags, and which of the chosen each belongs to."""
        size = self.size[chosen]
        owner = np.repeat(np.arange(len(chosen), dtype=np.int32), size)
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.first[chosen] - (ends - size), size)
        at += np.arange(len(at))
        return self.flat[at], owner

    def gains(self, gain: np.ndarray) -> np.ndarray:
        """The mean gain of every bag."""
        return np.add.reduceat(gain[self.flat], self.first) / self.size


@dataclass
class Softmax:
    """Embeddings and the linear softmax above their weighted means."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def slopes(self, k: np.ndarray, row: np.ndarray, part: np.ndarray, labels: np.ndarray, share: np.ndarray):
        """Gradients of the weighted mean cross entropy: touched embeddings, theirs, that of `out` and of `bias`.
        Entry n of the bags adds `part[n]` times embedding `k[n]` to the mean of text `row[n]`."""
        mean = np.stack([np.bincount(row, part * self.embed[k, d], len(labels)) for d in range(self.embed.shape[1])], axis=1)
        logits = mean @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - np.eye(2)[labels]) * share[:, None] / len(labels)
        d_mean = slope @ self.out.T
        touched, where = np.unique(k, return_inverse=True)
        g = np.stack([np.bincount(where, part * d_mean[row, d], len(touched)) for d in range(self.embed.shape[1])], axis=1)
        return touched, g, mean.T @ slope, slope.sum(0)

    def gain(self) -> np.ndarray:
        return self.embed @ (self.out[:, 1] - self.out[:, 0])


def train(texts: Iterable[list[str]], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, rate: float = 0.3, seed: int = 0):
    """Adagrad on the weighted cross entropy of the texts, the weights of words being those at the beginning of an
    epoch. Of a text's faint words a random part stands for all, another one in each epoch. After the first epochs, a copy of each text in which words are misspelt anew is learned beside it."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], dtype=np.int32) for t in texts]
    bags, names = Bags.of(vocabulary), list(vocabulary)
    del vocabulary
    size, flat = np.array([len(c) for c in coded]), np.concatenate(coded)
    n_texts, first = len(coded), np.cumsum(size) - size
    text_of = np.repeat(np.arange(n_texts, dtype=np.int32), size)
    model = Softmax(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2))
    sq_embed, sq_out, sq_bias = np.full(BUCKETS, 1e-3), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    share = weights / weights.mean()
    epochs = max(epochs, -(-LEAST_STEPS // -(-n_texts // MINIBATCH)))
    for epoch in range(epochs):
        weight = weighed(bags.gains(model.gain().astype(np.float32))[flat], first, size)
        at = np.flatnonzero((weight > FAINT) | (rng.random(len(weight)) * size[text_of] < DRAWN))
        kept_of, kept = text_of[at], flat[at]
        weight = weight[at] / np.bincount(kept_of, weight[at], n_texts)[kept_of]
        begin = np.searchsorted(kept_of, np.arange(n_texts + 1))
        copies = 1 if epoch < epochs // 5 else 2
        if copies == 2:
            used, bent = np.unique(kept, return_inverse=True)
            spelled = Bags.of(_misspell(names[w], rng) for w in used)
        order = rng.permutation(n_texts)
        for step in range(0, n_texts, MINIBATCH):
            grams, rows, parts = [], [], []
            slots = order[step : step + MINIBATCH]
            many = begin[slots + 1] - begin[slots]
            row = np.repeat(np.arange(len(slots)), many)
            place = begin[slots][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            for copy in range(copies):
                changed = rng.random(len(place)) < (0.5 if copy else 0.0)
                for source, words, own in ((bags, kept, ~changed), *([(spelled, bent, changed)] if copy else [])):
                    k, word = source.gather(words[place[own]])
                    grams.append(k)
                    rows.append(row[own][word] + copy * len(slots))
                    parts.append((weight[place[own]] / source.size[words[place[own]]])[word])
            k, part = np.concatenate(grams), np.concatenate(parts)
            part = part * (rng.random(len(k)) >= DROPPED) / (1 - DROPPED)
            both = np.tile(slots, copies)
            touched, g, d_out, d_bias = model.slopes(k, np.concatenate(rows), part, labels[both], share[both])
            g = g * len(both)
            sq_embed[touched] += (g**2).mean(1)
            model.embed[touched] -= rate * g / np.sqrt(sq_embed[touched])[:, None]
            sq_out += d_out**2
            sq_bias += d_bias**2
            model.out -= 0.1 * d_out / np.sqrt(sq_out)
            model.bias -= 0.1 * d_bias / np.sqrt(sq_bias)
    return SubwordModel(model.gain().astype(np.float32), float(model.bias[1] - model.bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    modulus: int = 3, remainder: int = 1, per_class: int = PER_CLASS,
) -> SubwordModel | None:
    """Learn from labelled documents whose crc32(id) mod `modulus` is not `remainder`.

    At most about `per_class` documents of each class, chosen by hash, are learned from with their whole texts; the
    classes are weighted back to their shares. Null labels and ids are left out, of several labels of one document the
    largest counts. None if there is nothing to learn from.
    """
    known = (
        labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_y").isin(0, 1)).filter(learnable(F.col("_id"), modulus, remainder))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    shares = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = bounded_sample(known, "_id", "_y", per_class)
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([" ".join(words_of(text)) for text in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), words], ["id", "y", "words"])

    sample = rows.join(F.broadcast(chosen), "_id").select("_id", "_y", "text").mapInArrow(run, "id long, y int, words string")
    found = sorted((r["id"], r["y"], r["words"]) for r in sample.dropDuplicates(["id"]).collect() if r["words"])
    if not found:
        return None
    y = np.array([y for _, y, _ in found])
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.where(y == 1, shares.get(1, 0) / seen[1], shares.get(0, 0) / seen[0])
    return train((w.split() for _, _, w in found), y, weights)


def scored(docs: DataFrame, model: SubwordModel | None, text: str = "text") -> DataFrame:
    """`docs` with a column `score`, the probability of label 1; without a model 0.5."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rate = held.value.scorer() if held.value is not None else lambda text: 0.5
        for texts in batches:
            yield pa.array([rate(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("score", F.arrow_udf(score, "double")(F.col(text).cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    modulus: int = 3, remainder: int = 1, threshold: float = 0.7, per_class: int = PER_CLASS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`; predicted is 1 from `threshold` on.

    Null texts and texts without letters or digits score as the bias alone. A null doc_id is scored and never learned
    from. Repeated rows get equal scores. An empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs, labels, "toxic", doc_id, text, modulus, remainder, per_class)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return scored(rows, model).select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
