"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every document that may be learned from. The weights are trained with
follow-the-regularised-leader under an elastic net (most stay zero), and a temperature, fitted on documents that
training did not see, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import bounded_sample, held_out, learnable, small_batches

#: Hashed features, n-gram lengths, characters handled at once.
FEATURES, GRAMS, PIECE = 1 << 14, (1, 2, 3), 1 << 19
#: Documents of each language that training sees at most, and the most languages that are learned, the most frequent.
PER_LANGUAGE, LANGUAGES = 1500, 500
UNDETERMINED = "und"
_MIX = np.uint32(0x9E3779B1)


def _gram_ids(codes: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of all n-grams of code points, by length."""
    value = codes * _MIX
    out, chain = [], value
    for n in GRAMS:
        if n > 1:
            chain = (chain[:-1] ^ (chain[:-1] >> np.uint32(13))) * _MIX + value[n - 1 :]
        out.append(((chain ^ (chain >> np.uint32(15))) * _MIX) >> np.uint32(32 - FEATURES.bit_length() + 1))
    return out


def gram_counts(text: str | None) -> np.ndarray:
    """How often each feature occurs in the whole lower-cased text, blanks taken as one blank."""
    total = np.zeros(FEATURES, dtype=np.int64)
    plain = f" {' '.join((text or '').lower().split())} "
    overlap = max(GRAMS) - 1
    for at in range(0, len(plain), PIECE):
        codes = np.frombuffer(plain[at : at + PIECE + overlap].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for n, ids in zip(GRAMS, _gram_ids(codes)):
            total += np.bincount(ids[:PIECE], minlength=FEATURES)
    return total


@dataclass
class LanguageModel:
    """idf of the features in use (`used`), their weights by language, biases, and the temperature."""

    names: list[str]
    used: np.ndarray
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> np.ndarray:
        """Sublinear TF-IDF of the features in use, of length 1."""
        x = np.log1p(counts[self.used]) * self.idf
        return x / max(1e-9, float(np.sqrt((x * x).sum())))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        logits = (x @ self.weights + self.bias) / self.temperature
        grown = np.exp(logits - logits.max(-1, keepdims=True))
        return grown / grown.sum(-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        p = self.probabilities(self.vector(gram_counts(text)))
        best = int(p.argmax())
        return self.names[best], float(p[best])


class SparseRows:
    """Vectors kept by their non-zero features, made dense a few at a time."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], width: int) -> None:
        self.vectors, self.width = vectors, width

    def __len__(self) -> int:
        return len(self.vectors)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width), dtype=np.float32)
        for n, row in enumerate(rows):
            at, value = self.vectors[row]
            out[n, at] = value
        return out


def train_ftrl(
    x: SparseRows, y: np.ndarray, classes: int, rows: np.ndarray | None = None, epochs: int = 6, batch: int = 16,
    alpha: float = 0.5, beta: float = 1.0, lasso: float = 0.02, ridge: float = 0.01, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over small batches of `rows`: weights (features x classes), most of them zero, and unpenalised
    biases."""
    rng = np.random.default_rng(seed)
    rows = np.arange(len(x)) if rows is None else rows
    z, n = (np.zeros((x.width + 1, classes)) for _ in range(2))
    l1 = np.full((x.width + 1, 1), lasso)
    l1[-1] = 0.0

    def solve() -> np.ndarray:
        return -np.where(np.abs(z) > l1, z - np.sign(z) * l1, 0) / ((beta + np.sqrt(n)) / alpha + ridge)

    w = solve()
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // batch)):
            dense = np.hstack([x.dense(part), np.ones((len(part), 1), dtype=np.float32)])
            logits = dense @ w
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = dense.T @ p / len(part)
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / alpha * w
            n += g * g
            w = solve()
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least cross entropy, on a grid of ratios from 1/20 to 20; memory is one copy of the logits."""
    top, own = logits.max(1, keepdims=True), logits[np.arange(len(y)), y]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 200):
        loss = float((np.log(np.exp((logits - top) / t).sum(1)) + (top[:, 0] - own) / t).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts. Every task sends one vector of fixed length."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen += gram_counts(value.as_py()) > 0
                n += 1
        if n:
            filled = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, filled]), pa.array(np.r_[n, seen[filled]])], ["k", "n"])

    found = rows.select(F.col(text).alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out, n = np.zeros(FEATURES, dtype=np.int64), 0
    for row in found.collect():
        if row["k"] < 0:
            n = row["n"]
        else:
            out[row["k"]] = row["n"]
    return out, n


def fit(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    modulus: int = 3, remainder: int = 1, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES,
) -> LanguageModel | None:
    """Learn from documents with a text and a language whose crc32(id) mod `modulus` is not `remainder`.

    Document frequencies count all of them; the weights are trained on about `per_language` documents of each
    language, chosen by hash, four in five of them, and the temperature on the fifth. Of more than `languages` values
    of `lang` the most frequent are learned, which bounds the driver's memory. None if there are none.
    """
    known = docs.select(
        F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    ).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & learnable(F.col("id"), modulus, remainder))
    frequency, n = document_frequencies(known)
    if not n:
        return None
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column("text"):
                counts = gram_counts(value.as_py())
                at = np.flatnonzero(counts)
                packed.append(at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(packed)], ["id", "lang", "counts"])

    chosen = bounded_sample(known, "id", "lang", per_language, languages)
    sample = chosen.select("id", "lang", "text").mapInArrow(run, "id string, lang string, counts binary")
    found = sorted((r["id"], r["lang"], bytes(r["counts"])) for r in sample.collect())
    names = sorted({lang for _, lang, _ in found})
    used = np.flatnonzero(frequency >= min(3, n))
    model = LanguageModel(names, used, np.log((1 + n) / (1 + frequency[used])) + 1, np.zeros((0, 0)), np.zeros(0))
    vectors, y = [], np.zeros(len(found), dtype=np.int64)
    for row, (_, lang, packed) in enumerate(found):
        size, counts = len(packed) // 6, np.zeros(FEATURES)
        counts[np.frombuffer(packed[: 2 * size], "<u2")] = np.frombuffer(packed[2 * size :], "<u4")
        vector = model.vector(counts)
        at = np.flatnonzero(vector)
        vectors.append((at.astype(np.int32), vector[at].astype(np.float32)))
        y[row] = names.index(lang)
    x, fifth = SparseRows(vectors, len(used)), np.arange(len(found)) % 5 == 4
    model.weights, model.bias = train_ftrl(x, y, len(names), np.flatnonzero(~fifth))
    if fifth.any():
        parts = np.array_split(np.flatnonzero(fifth), -(-fifth.sum() // 64))
        model.temperature = fit_temperature(np.concatenate([x.dense(p) @ model.weights + model.bias for p in parts]), y[fifth])
    return model


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    modulus: int = 3, remainder: int = 1, per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`.

    lang_pred is a language that was learned, or "und" with score 0 where the text is null or has no letter, or nothing
    could be learned. A null doc_id is predicted and never learned from; a null language is never learned. Repeated
    rows get equal predictions. An empty table gives an empty result. Other columns are not read.
    """
    model = fit(docs, doc_id, text, lang, modulus, remainder, per_language)
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                held.value.predict(t.as_py()) if letters.as_py() and held.value is not None else (UNDETERMINED, 0.0)
                for t, letters in zip(batch.column("text"), batch.column("letters"))
            ]
            names, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), names, scores], schema_names)

    schema_names = ["doc_id", "held_out", "lang_pred", "score"]
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id), modulus, remainder).alias("held_out"),
        F.col(text).alias("text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
