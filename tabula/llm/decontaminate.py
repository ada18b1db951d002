"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit distances.

Texts are sequences of lower-case words. An item of n words is found where a stretch of the text is within n/5 word
edits of it. A CGK random walk copies the word under a pointer and moves the pointer by a random bit of that word and
step, which embeds edit distance into Hamming distance; each repetition compares a few sampled positions of the
embeddings of the item and of an item-sized window, and enough repetitions are made to reach the target recall, which
is measured on edited copies of the items themselves; where it can't be reached, every window is verified. Windows are
laid where an item's rarest words stand: of n/5 + 1 of them at least one survives n/5 edits, so this placement loses no
passage. What passes is verified exactly.

The words of all items are counted in one pass over the texts. The items are searched for in blocks whose size is
bounded by words; each block is one more pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import kept, small_batches
from tabula.llm.tokens import LETTER_BYTES, owners, word_hashes, word_spans

#: Item words searched for in one pass over the texts (one item at least), about 25 bytes each in the broadcast, and
#: distinct item words counted in one pass.
BLOCK_WORDS, COUNTED_WORDS = 2_000_000, 4_000_000
#: Edits per word of an item, sampled positions of a repetition, most repetitions, wanted recall, and by how much more
#: repetitions are made than reached it on the edited copies.
EDITS, SAMPLES, REPETITIONS, RECALL, MARGIN = 0.2, 3, 64, 0.99, 1.5
#: Bytes of text handled at once.
GROUP = 1 << 21
_TABLE_BITS = 22


def edits_allowed(words: int) -> int:
    return int(words * EDITS + 1e-9)


def best_match(pattern: list, text: list, limit: int) -> int | None:
    """The least word edits between `pattern` and any stretch of `text`, None beyond `limit` (bit-parallel columns)."""
    m = len(pattern)
    at: dict = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for w in text:
        eq = at.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        score += 1 if up & top else -1 if down & top else 0
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
    return best if best <= limit else None


@dataclass
class ItemIndex:
    """A block of items: their words' hashes, one after another, and where their windows are laid."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray
    anchors: np.ndarray
    anchor_first: np.ndarray
    anchor_item: np.ndarray
    anchor_place: np.ndarray
    table: np.ndarray
    repetitions: int = REPETITIONS

    @classmethod
    def build(cls, ids: list, texts: list[np.ndarray], counts: tuple[np.ndarray, np.ndarray]) -> ItemIndex:
        """`counts`: sorted words and how often each occurs in the corpus; the rarest words of an item place its windows."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
        words = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        known, often = counts
        slot = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
        count = np.where(known[slot] == words, often[slot], 0) if len(known) else np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(words)) - first[owner] if len(words) else np.zeros(0, np.int64)
        rarest = np.lexsort((place, count, owner))
        allowed = (size * EDITS + 1e-9).astype(np.int64)
        rarest = rarest[place <= allowed[owner]] if len(words) else rarest  # place is also the rank within the item
        laid = rarest[np.lexsort((place[rarest], owner[rarest], words[rarest]))]
        anchors, begin = np.unique(words[laid], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[anchors >> np.uint64(64 - _TABLE_BITS)] = True
        out = cls(ids, words, first, size, anchors, np.r_[begin, len(laid)], owner[laid], place[laid], table)
        out.repetitions = out.enough_repetitions()
        return out

    def placed(self, words: np.ndarray, doc_first: np.ndarray, doc_last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (begin, item, a word inside) wherever one of an item's rarest words stands; a window may stick out
        of its text by as many words as edits are allowed."""
        hit = np.flatnonzero(self.table[words >> np.uint64(64 - _TABLE_BITS)])
        slot = np.searchsorted(self.anchors, words[hit])
        slot = np.minimum(slot, len(self.anchors) - 1)
        real = self.anchors[slot] == words[hit]
        hit, slot = hit[real], slot[real]
        many = self.anchor_first[slot + 1] - self.anchor_first[slot]
        which = np.repeat(self.anchor_first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        inside = np.repeat(hit, many)
        item = self.anchor_item[which]
        begin = inside - self.anchor_place[which]
        slack = (self.size[item] * EDITS + 1e-9).astype(np.int64)
        fits = (begin >= doc_first[inside] - slack) & (begin + self.size[item] <= doc_last[inside] + slack)
        begin, item, inside = begin[fits], item[fits], inside[fits]
        order = np.lexsort((begin, item))
        begin, item, inside = begin[order], item[order], inside[order]
        new = np.r_[True, (begin[1:] != begin[:-1]) | (item[1:] != item[:-1])] if len(begin) else np.zeros(0, bool)
        return begin[new], item[new], inside[new]

    def colliding(
        self, words: np.ndarray, begin: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, repetitions: int
    ) -> np.ndarray:
        """Which windows share all sampled positions of some repetition with their item; all of them without repetitions."""
        found = np.full(len(begin), repetitions == 0)
        for rep in range(repetitions):
            rng = np.random.default_rng(1000 + rep)
            depth = np.sort(rng.random(SAMPLES))
            steps = int(2 * self.size.max()) + 1
            odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            open_ = np.flatnonzero(~found)
            due = (depth[:, None] * 2 * self.size[item[open_]]).astype(np.int64)
            at = np.zeros(len(open_), dtype=np.int64)
            own = np.zeros(len(open_), dtype=np.int64)
            for step in range(steps):
                if not len(open_):
                    break
                here, mine = begin[open_] + at, item[open_]
                size = self.size[mine]
                valid = (here >= low[open_]) & (here < high[open_]) & (at < size)
                symbol = np.where(valid, words[np.clip(here, 0, len(words) - 1)], np.uint64(0))
                wanted = np.where(own < size, self.words[np.minimum(self.first[mine] + own, len(self.words) - 1)], np.uint64(0))
                checked = (due == step).any(0)
                last = due[-1] == step
                good = ~checked | (symbol == wanted)
                found[open_[good & last]] = True
                at += ((symbol * odd[step]) >> np.uint64(63)).astype(np.int64)
                own += ((wanted * odd[step]) >> np.uint64(63)).astype(np.int64)
                if checked.any():
                    stay = good & ~last
                    open_, at, own, due = open_[stay], at[stay], own[stay], due[:, stay]
        return found

    def enough_repetitions(self, trials: int = 400) -> int:
        """MARGIN times the fewest repetitions with which RECALL of edited copies of items, with all edits that are
        allowed, are found; 0, for no hashing at all, where REPETITIONS of them are too few."""
        rng = np.random.default_rng(7)
        busy = np.flatnonzero(self.size > 0)
        if not len(busy):
            return 1
        parts, low, high, item, begin = [], [], [], [], []
        for n in rng.choice(busy, trials):
            own = self.words[self.first[n] : self.first[n] + self.size[n]].tolist()
            for _ in range(edits_allowed(len(own))):
                k, kind = int(rng.integers(len(own))), int(rng.integers(3))
                other = int(rng.integers(1, 1 << 62))
                own = own[:k] + ([other, own[k]] if kind == 0 else [other] if kind == 1 else []) + own[k + 1 :]
            start = sum(map(len, parts))
            parts.append(rng.integers(1, 1 << 62, 100).tolist() + own + rng.integers(1, 1 << 62, 100).tolist())
            stop = start + len(parts[-1])
            words = np.array(parts[-1], dtype=np.uint64)
            b, i, _ = self.placed(words, np.zeros(len(words), np.int64), np.full(len(words), len(words)))
            mine = b[i == n] + start
            begin.append(mine)
            item.append(np.full(len(mine), n))
            low.append(np.full(len(mine), start))
            high.append(np.full(len(mine), stop))
        owner = np.repeat(np.arange(trials), [len(b) for b in begin])
        args = [np.concatenate(x) for x in (begin, item, low, high)]
        flat = np.concatenate([np.array(p, dtype=np.uint64) for p in parts])
        for repetitions in range(1, REPETITIONS + 1):
            hit = self.colliding(flat, *args, repetitions)
            if len(np.unique(owner[hit])) >= RECALL * trials:
                return int(MARGIN * repetitions)
        return 0


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased UTF-8 texts in groups of about GROUP bytes, each with the position of its first text."""
    group, held, start = [], 0, 0
    for n, text in enumerate(texts):
        group.append((text or "").lower().encode("utf-8", "replace"))
        held += len(group[-1])
        if held >= GROUP or n == len(texts) - 1:
            yield start, group
            group, held, start = [], 0, n + 1


def _hashed(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    begins, ends = word_spans(data, LETTER_BYTES)
    doc = owners(np.fromiter(map(len, texts), np.int64, len(texts)), begins)
    return joined, begins, ends, word_hashes(data, begins, ends), doc


def _vocabulary(items: DataFrame) -> DataFrame:
    """(part, word): the distinct hashed words of the items' column text, in parts of at most about COUNTED_WORDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _grouped(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_hashed(texts)[3]).view(np.int64))], ["word"])

    words = kept(items.select("text").mapInArrow(run, "word long").distinct(), "benchmark-words")
    parts = -(-words.count() // COUNTED_WORDS)
    return words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(max(1, parts))))


def _word_counts(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The items' distinct hashed words, sorted, and how often each occurs in the texts.

    A task sends one number for each word it met. The driver holds 16 bytes for each word of the benchmark.
    """
    vocabulary = _vocabulary(items)
    found = []
    for part in sorted(r["part"] for r in vocabulary.select("part").distinct().collect()):
        words = np.sort(np.array([r["word"] for r in vocabulary.filter(F.col("part") == part).select("word").collect()], np.int64).view(np.uint64))
        held = docs.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            table[known >> np.uint64(64 - _TABLE_BITS)] = True
            total = np.zeros(len(known), dtype=np.int64)
            for batch in batches:
                for _, texts in _grouped(batch.column("text").to_pylist()):
                    words = _hashed(texts)[3]
                    words = words[table[words >> np.uint64(64 - _TABLE_BITS)]]
                    slot = np.minimum(np.searchsorted(known, words), len(known) - 1)
                    total += np.bincount(slot[known[slot] == words], minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["k", "n"])

        sums = docs.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
        often = np.zeros(len(words), dtype=np.int64)
        often[[r["k"] for r in sums]] = [r["n"] for r in sums]
        found.append((words, often))
    words, often = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, t) for n, t in enumerate((np.uint64, np.int64)))
    order = np.argsort(words)
    return words[order], often[order]


@dataclass
class Searcher:
    """An index and the spelling of its items' words, for finding the items of one block in texts."""

    index: ItemIndex
    joined: bytes
    begins: np.ndarray
    ends: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], counts: tuple[np.ndarray, np.ndarray]) -> Searcher:
        joined, begins, ends, words, owner = _hashed([t.lower().encode("utf-8", "replace") for t in texts])
        used, at = np.unique(owner, return_index=True)
        index = ItemIndex.build([ids[n] for n in used], np.split(words, at[1:]) if len(used) else [], counts)
        return cls(index, joined, begins, ends)

    def spelled(self, item: int) -> list[bytes]:
        own = slice(self.index.first[item], self.index.first[item] + self.index.size[item])
        return [self.joined[a:b] for a, b in zip(self.begins[own].tolist(), self.ends[own].tolist())]

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(position of the text, item, edits, first word) of every item in every text."""
        for start, group in _grouped(texts) if len(self.index.size) else ():
            joined, begins, ends, words, doc = _hashed(group)
            if not len(words):
                continue
            reach = np.searchsorted(doc, np.arange(len(group) + 1))
            low, high = reach[doc], reach[doc + 1]
            begin, item, inside = self.index.placed(words, low, high)
            near = self.index.colliding(words, begin, item, low[inside], high[inside], self.index.repetitions)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for at, n, here in zip(begin[near].tolist(), item[near].tolist(), inside[near].tolist()):
                key = (int(doc[here]), n)
                if best.get(key, (1, 0))[0] == 0:
                    continue
                size = int(self.index.size[n])
                slack = edits_allowed(size)
                a, b = max(int(low[here]), at - slack), min(int(high[here]), at + size + slack)
                edits = best_match(self.spelled(n), [joined[x:y] for x, y in zip(begins[a:b], ends[a:b])], slack)
                if edits is not None and (edits, at) < best.get(key, (1 << 30, 0)):
                    best[key] = (edits, at)
            for (d, n), (edits, at) in sorted(best.items()):
                yield start + d, n, edits, max(0, at - int(reach[d]))


def searchers(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> Iterator[Searcher]:
    """One searcher for each block of items of BLOCK_WORDS words; `docs` has the column text, whose words are counted."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = kept(items.filter(F.col("text").isNotNull()).distinct(), "benchmark-items")
    counts = _word_counts(docs.select("text"), items)
    if not len(counts[0]):
        return
    block, held = [], 0
    for row in chain(items.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator(), [None]):
        words = 0 if row is None else len(row["text"].split())
        if block and (row is None or held + words > BLOCK_WORDS):
            yield Searcher.build([r["item_id"] for r in block], [r["text"] for r in block], counts)
            block, held = [], 0
        if row is not None:
            block.append(row)
            held += words


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, edits, item_words, word_at): every benchmark item found in a document, once per document row.

    edits is the least number of word edits (at most a fifth of the item's words) between the item and a stretch of
    the document; word_at is about where it begins. Case and punctuation do not count. Items of fewer than five words
    match exactly; null items, items without words and null or blank texts match nothing. Of items with equal ids each
    text is searched for. Texts are read once to count words and once for each block of items. Other columns are not
    read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "edits", "item_words", "word_at"]
    schema = ", ".join(f"{n} long" for n in names)
    out = docs.sparkSession.createDataFrame([], schema)
    for searcher in searchers(rows, benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(searcher)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [
                    (ids[d], held.value.index.ids[n], edits, int(held.value.index.size[n]), at)
                    for d, n, edits, at in held.value.matches(batch.column("text").to_pylist())
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _marker(held):
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            marks = np.zeros(len(texts), dtype=bool)
            for d, *_ in held.value.matches(texts.to_pylist()):
                marks[d] = True
            yield pa.array(marks)

    return F.arrow_udf(found, "boolean")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found. Between blocks of items the rows that are left are
    written, so that a task holds one block at a time."""
    small_batches(docs.sparkSession)
    clean, several = docs, False
    for searcher in searchers(docs.select(F.col(text).alias("text")), benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(searcher)
        clean = (kept(clean, "decontaminated") if several else clean).filter(~_marker(held)(F.col(text).cast("string")))
        several = True
    return clean
