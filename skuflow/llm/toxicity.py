"""Toxicity by multiple-instance learning: labels of documents teach a classifier of sentences.

Each sentence has a logistic score over its words and their beginnings, if any of them is known to the model, else 0.
The document's score is their leaky noisy-or: one minus the product of the sentences' clean chances and of the chance
that a label has no cause in the text, which is one number for all documents. Training climbs the likelihood of the
document labels through the noisy-or, so weight gathers on the sentences that explain a label. Afterwards the same
model points at offending sentences.

Training sees at most ``rows`` labelled rows, those with the smallest hash of their key, and keeps the features whose
presence in a document goes with its label more than chance allows (likelihood ratio). The bound is a parameter; all else
covers every document. Counts are taken by Spark; the sample's few remaining features then fit in the driver.

Defined cases: null and empty texts are one empty sentence, whose score is the leak; a label or key that is null
teaches nothing; with labels of one kind only, or none, the score is that kind's share (0.0 without labels), and where no
word goes with the labels it is the share of toxic ones; of
several labels for a key the largest holds; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.textscan import LOWER, mix, slices, word_hashes, words
from skuflow.session import materialize

ROWS = 20_000
STEPS = 300
#: Words that are kept although chance could explain them, if they are the best there are.
BEST = 16
#: Lengths, in bytes, of the beginnings of longer words that are features beside the words themselves.
STEMS = (4, 5, 6)

_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLE_BITS = 20


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and row of each sentence of a run of texts; every text has at least one.

    A sentence ends after a full stop, exclamation mark, question mark or line end.
    """
    n = len(offsets) - 1
    after = np.flatnonzero(_ENDS[raw]) + 1
    owner = np.searchsorted(offsets, after, side="right") - 1
    inner = (after < len(raw)) & (offsets[np.minimum(owner, n - 1)] != after)
    begins = np.concatenate([offsets[:-1], after[inner]])
    row = np.concatenate([np.arange(n), owner[inner]])
    order = np.lexsort((begins, row))
    return begins[order], row[order]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and hash of each feature, and its row: lower-case words without punctuation, then their beginnings."""
    low = LOWER[raw]
    clean = np.where(_WORD[low], low, np.uint8(32))
    starts, ends, first = words(clean, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, hashes, rows = [starts], [word_hashes(clean, starts, ends)], [row]
    for n in STEMS:
        longer = np.flatnonzero(ends - starts > n)
        at.append(starts[longer])
        hashes.append(mix(word_hashes(clean, starts[longer], starts[longer] + n) + np.uint64(n)))
        rows.append(row[longer])
    return np.concatenate(at), np.concatenate(hashes), np.concatenate(rows)


def sentence_of(at: np.ndarray, owner: np.ndarray, begins: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sentence in which each byte of a row lies. Empty rows share their first byte with the next row, hence ``owner``."""
    place = np.searchsorted(begins, at, side="right") - 1
    return np.clip(place, np.searchsorted(row, owner), np.searchsorted(row, owner, side="right") - 1)


@dataclass
class Model:
    """Weights of feature hashes, the bias of a sentence that has any, and the leak (as a logit); ``fixed`` replaces the
    score where nothing could be learned."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float
    fixed: float | None = None
    table: np.ndarray | None = field(default=None, repr=False)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``h``, index of the word) of all known words."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.table is None:
            self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
            self.table[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        known = self.keys[slot] == h[at]
        return at[known], slot[known]

    def chances(self, n: int, sentence: np.ndarray, word: np.ndarray) -> np.ndarray:
        p = _sigmoid(np.bincount(sentence, weights=self.weights[word], minlength=n) + self.bias)
        return np.where(np.bincount(sentence, minlength=n) > 0, p, 0.0)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def all_clean(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Log of the chance that every sentence of a row is clean; the noisy-or is one minus its exponential."""
    return np.bincount(row, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column("label").to_numpy()
        for first, end, raw, bounds in slices(batch.column("text"), 1 << 21):
            _, h, row = features(raw, bounds)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
            h, row = h[new], row[new]
            cut = np.searchsorted(row, np.arange(end - first + 1))
            for i in range(end - first):
                own = h[cut[i] : cut[i + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), label[first + i], np.int32))], names=["word", "label"])


def _bags(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            for first, end, raw, bounds in slices(batch.column("text"), 1 << 21):
                begins, row = sentences(raw, bounds)
                starts, h, owner = features(raw, bounds)
                at, word = model.find(h)
                both = np.unique(sentence_of(starts[at], owner[at], begins, row) * len(model.keys) + word)
                sentence, word = both // len(model.keys), both % len(model.keys)
                low = np.searchsorted(row, np.arange(end - first + 1))
                per = np.searchsorted(sentence, low)
                names = ["label", "n", "sentence", "word"]
                for i in range(end - first):
                    own = slice(per[i], per[i + 1])
                    values = [[int(label[first + i])], [int(low[i + 1] - low[i])], [(sentence[own] - low[i]).tolist()], [word[own].tolist()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=names)

    return run


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = ROWS, steps: int = STEPS) -> Model:
    """Fit on labelled rows for which ``learn`` (an expression over the label table) holds, at most ``rows`` of them.

    Features are all words whose log-likelihood ratio against the labels exceeds twice the logarithm of the number of
    words: about what the best of so many words reaches by chance, at any number of labels. The BEST words need half.
    """
    known = labels.where(learn & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    body = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    sample = materialize(body.join(F.broadcast(chosen), "_key").select("label", "text"), "sample")  # at most ``rows`` small rows
    found = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    model = Model(np.zeros(0, np.uint64), np.zeros(0), -2.0, -4.0)
    if len(found) < 2:
        model.fixed = float(found.get(1, 0) > 0)
        return model
    yes, no = float(found[1]), float(found[0])
    seen = sample.mapInArrow(_word_sets, "word long, label int").groupBy("word").agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    cell = lambda seen_, of, m: F.when(seen_ > 0, 2 * seen_ * F.log(seen_ * (yes + no) / (of * m))).otherwise(0.0)
    ratio = cell(a, yes, a + b) + cell(b, no, a + b) + cell(yes - a, yes, yes + no - a - b) + cell(no - b, no, yes + no - a - b)
    tried = materialize(seen.select("word", ratio.alias("ratio")), "words")
    chance = float(np.log(max(2, tried.count())))
    sure = tried.where(F.col("ratio") > 2 * chance)
    best = sure.union(tried.where(F.col("ratio") > chance).orderBy(F.desc("ratio"), "word").limit(BEST)).select("word").distinct()
    model.keys = np.sort(best.select("word").toArrow()["word"].to_numpy().view(np.uint64))
    model.weights = np.zeros(len(model.keys))
    if not len(model.keys):
        model.fixed = yes / (yes + no)  # nothing tells them apart
        return model
    bags = sample.mapInArrow(_bags(model), "label int, n int, sentence array<int>, word array<int>").toArrow().combine_chunks()
    return _climb(model, bags, steps)


def _climb(model: Model, bags: pa.Table, steps: int) -> Model:
    """Adam on the log-likelihood of the labels under the noisy-or, with a small ridge."""
    y = bags["label"].to_numpy().astype(float)
    n = bags["n"].to_numpy().astype(np.int64)
    shift = np.concatenate([[0], np.cumsum(n)])
    entries = [bags[c].combine_chunks() for c in ("sentence", "word")]
    counts = np.diff(entries[0].offsets.to_numpy())
    sentence = entries[0].flatten().to_numpy() + np.repeat(shift[:-1], counts)
    # sentences without a known feature say nothing
    busy, sentence = np.unique(sentence, return_inverse=True)
    word = entries[1].flatten().to_numpy().astype(np.int64)
    row = np.searchsorted(shift, busy, side="right") - 1
    first, second = np.zeros(len(model.keys) + 2), np.zeros(len(model.keys) + 2)
    for t in range(1, steps + 1):
        p = model.chances(len(busy), sentence, word)
        leak = _sigmoid(model.leak)
        clean = all_clean(p, row, len(y)) + np.log1p(-leak)
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        # d log-likelihood / d z of a cause: its chance * (y * clean / toxic - (1 - y))
        of_row = y * np.exp(clean) / toxic - (1 - y)
        pull = p * of_row[row]
        g = np.concatenate([np.bincount(word, weights=pull[sentence], minlength=len(model.keys)), [pull.sum(), leak * of_row.sum()]]) / len(y)
        g[:-2] -= 1e-4 * model.weights
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8) * (1 if t < steps // 2 else 0.2)
        model.weights = model.weights + step[:-2]
        model.bias, model.leak = float(model.bias + step[-2]), float(model.leak + step[-1])
    return model


def _scored(model: Model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, bounds in slices(batch.column("text"), 1 << 21):
                n = end - first
                keys = [batch.column(c).slice(first, n) for c in ("doc_id", "row")]
                begins, row = sentences(raw, bounds)
                starts, h, owner = features(raw, bounds)
                at, word = model.find(h)
                width = max(1, len(model.keys))
                both = np.unique(sentence_of(starts[at], owner[at], begins, row) * width + word)
                p = model.chances(len(row), both // width, both % width)
                score = -np.expm1(all_clean(p, row, n) + np.log1p(-_sigmoid(model.leak)))
                if model.fixed is not None:
                    p, score = np.full(len(row), model.fixed), np.full(n, model.fixed)
                worst = np.lexsort((begins, -p, row))[np.searchsorted(row, np.arange(n))]  # the first of equals
                stop = np.where(np.append(row[1:] == row[:-1], False), np.append(begins[1:], 0), bounds[row + 1])
                arrays = [*keys, pa.array(score), pa.array(begins[worst] - bounds[:-1]), pa.array(stop[worst] - bounds[:-1]), pa.array(p[worst])]
                names = ["doc_id", "row", "score", "worst_start", "worst_end", "worst_score"]
                if spans:
                    bad = p >= 0.5
                    per = np.concatenate([[0], np.cumsum(np.bincount(row[bad], minlength=n))]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(per), pa.array(begins[bad] - bounds[row[bad]])))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", row: Column | None = None, spans: bool = True) -> DataFrame:
    """doc_id, row, score, and where the worst sentence lies (byte bounds in the UTF-8 text) with its own score.

    With ``spans`` also the first bytes of all sentences that score 0.5 or more alone. Only the text enters a score.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), (F.lit(0).cast("long") if row is None else row).alias("row"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id long, row {narrow.schema['row'].dataType.simpleString()}, score double, worst_start long, worst_end long, worst_score double" + (", offending array<long>" if spans else "")
    return narrow.mapInArrow(_scored(model, spans), schema)
