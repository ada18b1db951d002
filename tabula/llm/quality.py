"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. A passage is described by its content, the mean of the embeddings of its hashed
character trigrams, which are trained with the rest, and by its form: shares of kinds of characters and words, and how
much it repeats itself or the document before it. A small network encodes the description; gated attention (a tanh gate
times a sigmoid gate) weighs the passages, and a logistic layer scores the weighted representation. Only documents are
labelled: what makes a passage count is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import bounded_sample, held_out, learnable, small_batches

#: Words in a passage.
PASSAGE_WORDS = 48
FEATURES = (
    "words", "word length", "capitals", "digits", "symbols", "exclamations", "bars", "stops", "commas", "other bytes",
    "lines", "distinct words", "commonest word", "same as the word before", "repeated in the document", "long words",
)
#: Trigram embeddings and their length.
GRAMS, DIM = 1 << 13, 12
#: Bytes of text described at once; longer texts are described in pieces of whole passages.
PIECE = 1 << 20
_KIND = np.zeros((8, 256), dtype=bool)
_KIND[0, list(range(65, 91))] = True
_KIND[1, list(b"0123456789")] = True
_KIND[2, list(b"#$%&*@^~_+=<>{}[]\\/")] = True
_KIND[3, list(b"!?")] = True
_KIND[4, list(b"|")] = True
_KIND[5, list(b".")] = True
_KIND[6, list(b",;:")] = True
_KIND[7, list(range(128, 256))] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[_BLANK] = 32


def _lead(ids: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins."""
    return np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])


def _share_seen_before(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the value occurred before in its group, by position."""
    order = np.lexsort((value, group))
    same = np.r_[False, (group[order][1:] == group[order][:-1]) & (value[order][1:] == value[order][:-1])]
    seen = np.zeros(len(value), dtype=bool)
    seen[order] = same
    return seen


@dataclass
class Carry:
    """What a piece of a long text needs of the pieces before it: the last word hashes, the number of words, and the
    sorted hashes of all triples of words."""

    last: np.ndarray = field(default_factory=lambda: np.zeros(2, dtype=np.uint64))
    words: int = 0
    triples: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))


@dataclass
class Passages:
    """Described passages in order: features of form, trigrams one after another with each passage's first and number,
    and the text each passage belongs to."""

    form: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    gram_count: np.ndarray
    text: np.ndarray


def _trigrams(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding numbers of the byte trigrams from `begins` to `ends` of each passage, A-Z and blanks taken alike."""
    low = _LOWER[data]
    whole = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA6B) ^ low[2:] * np.uint32(0xC2B2AE35)) if len(low) > 2 else low[:0]
    ids = ((whole ^ (whole >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAMS.bit_length() + 1)
    count = np.maximum(0, ends - begins - 2)
    first = np.cumsum(count) - count
    at = np.repeat(begins - first, count) + np.arange(count.sum())
    return ids[at].astype(np.uint16), first, count


def describe(texts: list[bytes | None], carry: Carry | None = None) -> Passages:
    """All passages of some texts. Blank texts have no passage. With `carry`, which is brought up to date, the one text
    is a piece that begins with a passage."""
    joined = b"\n".join(x or b"" for x in texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    lengths = np.fromiter((len(x or b"") + 1 for x in texts), dtype=np.int64, count=len(texts))
    blank = _BLANK[data]
    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(data) else np.zeros(0, dtype=np.int64)
    if not len(begins):
        none = np.zeros(0, dtype=np.int64)
        return Passages(np.zeros((0, len(FEATURES)), dtype=np.float32), none.astype(np.uint16), none, none, none)
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    size = ends - begins
    doc = np.searchsorted(np.cumsum(lengths), begins, side="right")
    first = _lead(doc)
    within = np.arange(len(begins)) - np.repeat(first, np.diff(np.r_[first, len(begins)]))
    passage_of = doc * (1 + within.max() // PASSAGE_WORDS) + within // PASSAGE_WORDS
    starts = _lead(passage_of)
    counts = np.diff(np.r_[starts, len(begins)])
    number = np.repeat(np.arange(len(starts)), counts)

    weights = np.cumprod(np.full(64, _MIX, dtype=np.uint64))
    offset = np.arange(len(data)) - np.repeat(np.r_[0, begins[1:]], np.diff(np.r_[0, begins[1:], len(data)]))
    weighed = np.where(blank, 0, data).astype(np.uint64) * weights[np.clip(offset, 0, 10**9) % 64]
    weighed *= (np.clip(offset, 0, 10**9) // 64 * 2 + 1).astype(np.uint64)
    word = np.add.reduceat(weighed, begins)
    word ^= word >> np.uint64(29)
    word *= _MIX

    last = carry.last if carry else np.zeros(2, dtype=np.uint64)
    longer = np.r_[last, word]
    before, before2 = longer[1:-1], longer[:-2]
    chain = word + before * np.uint64(31) + before2 * np.uint64(961)
    since = within + (carry.words if carry else 0)
    repeated = _share_seen_before(doc, chain)
    if carry:
        slot = np.minimum(np.searchsorted(carry.triples, chain), max(0, len(carry.triples) - 1))
        if len(carry.triples):
            repeated |= carry.triples[slot] == chain
        carry.triples = np.union1d(carry.triples, chain)
        carry.last, carry.words = longer[-2:], carry.words + len(word)
    repeated &= since >= 2
    seen = _share_seen_before(number, word)
    order = np.lexsort((word, number))
    runs = _lead_pairs(number[order], word[order])
    run_size = np.diff(np.r_[runs, len(order)])
    commonest = np.zeros(len(starts), dtype=np.int64)
    np.maximum.at(commonest, number[order][runs], run_size)
    stuck = (word == before) & (since > 0)

    span = np.r_[begins[starts], len(data)]
    chars = np.add.reduceat(size, starts).astype(np.float64)
    rows = np.zeros((len(starts), len(FEATURES)), dtype=np.float32)
    rows[:, 0] = counts / PASSAGE_WORDS
    rows[:, 1] = chars / counts / 10
    for k in range(8):
        rows[:, 2 + k] = np.add.reduceat(_KIND[k][data].astype(np.int32), span[:-1]) / chars
    breaks = np.flatnonzero(data == 10)
    after = np.searchsorted(begins, breaks, side="right") - 1
    breaks, after = breaks[after >= 0], after[after >= 0]
    own = breaks < np.cumsum(lengths)[doc[after]] - 1
    rows[:, 10] = np.bincount(number[after[own]], minlength=len(starts)) / counts
    rows[:, 11] = 1 - np.add.reduceat(seen.astype(np.int32), starts) / counts
    rows[:, 12] = commonest / counts
    rows[:, 13] = np.add.reduceat(stuck.astype(np.int32), starts) / counts
    rows[:, 14] = np.add.reduceat(repeated.astype(np.int32), starts) / counts
    rows[:, 15] = np.add.reduceat((size > 24).astype(np.int32), starts) / counts
    grams = _trigrams(data, begins[starts], ends[np.r_[starts[1:] - 1, len(ends) - 1]])
    return Passages(rows, *grams, doc[starts])


def _lead_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut before the first words of passages into pieces of about PIECE bytes."""
    at, reach = 0, PIECE
    while at + reach < len(text):
        blank = _BLANK[np.frombuffer(text, np.uint8, reach, at)]
        begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        whole = (len(begins) - 1) // PASSAGE_WORDS  # the last word may go on
        if whole > 0:
            stop = at + int(begins[whole * PASSAGE_WORDS])
            yield text[at:stop]
            at, reach = stop, PIECE
        else:
            reach *= 2
    yield text[at:]


def described(texts: list[bytes | None]) -> Iterator[tuple[Passages, bool]]:
    """Passages of some texts, about PIECE bytes at once, and whether the last text of these is complete; a long text
    comes in several parts."""
    group: list[bytes | None] = []
    owner: list[int] = []
    held = 0
    for n, text in enumerate([*texts, None]):
        over = n == len(texts)
        long = text is not None and len(text) > PIECE
        if group and (over or long or held >= PIECE):
            found = describe(group)
            found.text = np.array(owner, dtype=np.int64)[found.text]
            yield found, True
            group, owner, held = [], [], 0
        if long:
            carry, parts = Carry(), list(_pieces(text))
            for k, part in enumerate(parts):
                found = describe([part], carry)
                found.text = np.full(len(found.text), n)
                yield found, k == len(parts) - 1
        elif not over:
            group.append(text)
            owner.append(n)
            held += len(text or b"") + 1


@dataclass
class AttentionModel:
    """mean and scale of the form features; trigram embeddings (G), encoder (E, e), attention gates (V, U, w), output
    layer (c, b)."""

    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, form: np.ndarray, hidden: int = 16, gate: int = 8, grams: int = GRAMS, seed: int = 0) -> AttentionModel:
        rng, n = np.random.default_rng(seed), form.shape[1]
        return cls(form.mean(0), form.std(0) + 1e-3, {
            "G": rng.normal(0, 0.1, (grams, DIM)), "E": rng.normal(0, 1 / np.sqrt(n), (n + DIM, hidden)), "e": np.zeros(hidden),
            "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
            "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1),
        })

    def inputs(self, found: Passages) -> np.ndarray:
        """The encoder's inputs: standardised form, and the mean embedding of the passage's trigrams times DIM."""
        some = found.gram_count > 0
        content = np.zeros((len(found.form), DIM), dtype=self.params["G"].dtype)
        if some.any():
            sums = np.add.reduceat(self.params["G"][found.grams], found.gram_first[some], axis=0)
            content[some] = DIM * sums / found.gram_count[some][:, None]
        return np.hstack([(found.form - self.mean) / self.scale, content])

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag; bags are consecutive rows that begin at `starts`."""
        return self._forward(x, starts)["p"]

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (v * u) @ p["w"]
        sizes = np.diff(np.r_[starts, len(x)])
        raw = raw - np.repeat(np.maximum.reduceat(raw, starts), sizes)
        grown = np.exp(raw)
        a = grown / np.repeat(np.add.reduceat(grown, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": score, "sizes": sizes}

    def gradients(self, found: Passages, starts: np.ndarray, labels: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        """Slopes of the cross entropy, weighted by `share`, of bags of passages that begin at `starts`."""
        p, x = self.params, self.inputs(found)
        f = self._forward(x, starts)
        slope = (f["p"] - labels) * share
        grad = {"c": f["z"].T @ slope, "b": np.array([slope.sum()])}
        dz = np.repeat(slope[:, None] * p["c"][None, :], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(1)
        draw = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), f["sizes"]))
        dg = draw[:, None] * p["w"][None, :]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        grad |= {"w": (f["v"] * f["u"]).T @ draw, "V": f["h"].T @ dv, "U": f["h"].T @ du}
        dh = (f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        grad |= {"E": x.T @ dh, "e": dh.sum(0)}
        dx = (dh @ p["E"].T)[:, len(self.mean) :] * (DIM / np.maximum(1, found.gram_count))[:, None]
        owner = np.repeat(np.arange(len(dx)), found.gram_count)
        grad["G"] = np.stack([np.bincount(found.grams, dx[owner, k], len(p["G"])) for k in range(DIM)], axis=1)
        return grad

    def learn(self, bags: list[Passages], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, least: int = 400, batch: int = 64, rate: float = 0.01, decay: float = 1e-5, seed: int = 0) -> None:
        """Adam on small batches of bags; few bags are learned in more epochs, `least` steps at the fewest."""
        rng, share = np.random.default_rng(seed), weights / weights.mean()
        m1, m2 = ({k: np.zeros_like(a) for k, a in self.params.items()} for _ in range(2))
        step = 0
        for _ in range(max(epochs, -(-least // -(-len(bags) // batch)))):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                found, starts = stacked([bags[n] for n in chosen])
                grad, step = self.gradients(found, starts, labels[chosen], share[chosen] / len(chosen)), step + 1
                for k, values in self.params.items():
                    g = grad[k] + decay * values
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    values -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)


def stacked(bags: list[Passages]) -> tuple[Passages, np.ndarray]:
    """Some bags as one, and where each begins."""
    count = np.concatenate([b.gram_count for b in bags])
    form, grams = np.concatenate([b.form for b in bags]), np.concatenate([b.grams for b in bags])
    sizes = np.array([len(b.form) for b in bags])
    whole = Passages(form, grams, np.cumsum(count) - count, count, np.repeat(np.arange(len(bags)), sizes))
    return whole, np.cumsum(sizes) - sizes


#: Labelled documents of each class that training sees at most, each with its whole text.
PER_CLASS = 4000


def bag_of(text: bytes) -> Passages | None:
    """All passages of one text, None if it has no word."""
    parts = [found for found, _ in described([text]) if len(found.form)]
    return stacked(parts)[0] if parts else None


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    modulus: int = 5, remainder: int = 0, per_class: int = PER_CLASS,
) -> AttentionModel | None:
    """Learn from labelled documents whose crc32(id) mod `modulus` is not `remainder`.

    At most about `per_class` documents of each class, chosen by hash, are learned from with all their passages; the
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
    sample = rows.join(F.broadcast(chosen), "_id").select("_id", "_y", "text").filter(F.length("text") > 0).dropDuplicates(["_id"])
    found = [(r["_id"], r["_y"], bag_of(r["text"].encode("utf-8", "replace"))) for r in sample.toLocalIterator()]
    known_bags = sorted((f for f in found if f[2] is not None), key=lambda f: f[0])
    if not known_bags:
        return None
    y = np.array([f[1] for f in known_bags], dtype=np.float64)
    seen = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.where(y == 1, shares.get(1, 0) / seen[1], shares.get(0, 0) / seen[0])
    model = AttentionModel.new(np.concatenate([f[2].form for f in known_bags]))
    model.learn([f[2] for f in known_bags], y, weights)
    model.params = {k: a.astype(np.float32) for k, a in model.params.items()}
    return model


def scored(docs: DataFrame, model: AttentionModel | None, text: str = "text", blank: float = 0.0) -> DataFrame:
    """`docs` with a column `score`, the probability of label 1.

    Texts without words, null included, score `blank`; without a model every score is 0.5.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            raw = texts.cast(pa.binary()).to_pylist()
            out = np.full(len(raw), 0.5 if held.value is None else blank)
            open_: list[np.ndarray] = []
            for found, complete in described(raw) if held.value is not None else ():
                open_.append(held.value.inputs(found))
                if complete and len(found.text):
                    x, starts = np.concatenate(open_), _lead(found.text)
                    starts = np.r_[0, starts[1:] + len(x) - len(found.text)]  # the parts before are of the first text
                    out[found.text[_lead(found.text)]] = held.value.scores(x, starts)
                if complete:
                    open_.clear()
            yield pa.array(out, pa.float64())

    udf = F.arrow_udf(score, "double")
    return docs.withColumn("score", udf(F.col(text).cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    modulus: int = 5, remainder: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`; predicted is 1 from `threshold` on.

    Null and blank texts score 0 and so are rejected. A null doc_id is scored and never learned from. Repeated rows get
    equal scores. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    model = fit(docs, labels, "quality", doc_id, text, modulus, remainder, per_class)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = scored(rows, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with the columns of `docs`."""
    model = fit(docs, labels, text=text, **how)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return scored(packed, model).filter(F.col("score") >= threshold).select("row.*")
