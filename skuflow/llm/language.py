"""Language identification with error-correcting output codes.

Every language has a codeword; every bit of the code has a binary classifier over byte n-grams that separates the
languages with that bit set from the others. A text is decoded to the codeword with the least loss, each bit weighted by
how well its classifier did in training, and the result is flagged as ambiguous when the runner-up is close.

The classifiers are log-odds of smoothed n-gram counts, so one pass of Spark counts per language trains them all. They
are fitted on all labelled rows given. Counts per language are a table of fixed size (languages x buckets).

Defined cases: text that is null or has no letter gives ``und`` with score 0; so does any text if nothing was learned,
and with a single learned language every other text gets that one; null languages teach nothing; repeated rows count
as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.llm.textscan import LOWER, SPACE, slices

BUCKETS = 1 << 15
UNKNOWN = "und"
#: Mean log-odds per n-gram are small numbers; this scales them before the loss.
SHARPNESS = 4.0
_GRAMS = (1, 2, 3, 4)
_SEEDS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def grams(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, first byte) of the n-grams of each width that lie inside one text and one word with its borders.

    Letters A to Z are lower-cased, white space becomes one kind of border; digits and the like stay as they are.
    """
    low = np.where(SPACE[raw], np.uint8(32), LOWER[raw])
    code = np.zeros(len(low), dtype=np.uint32)
    for width in _GRAMS:
        n = len(low) - width + 1
        if n <= 0:
            return
        code = code[:n] * np.uint32(257) + low[width - 1 :]
        ok = np.ones(n, dtype=bool)
        for k in range(1, width):
            cut = offsets[1:-1] - k
            ok[cut[(cut >= 0) & (cut < n)]] = False
        if width > 2:
            for k in range(1, width - 1):
                ok &= low[k : k + n] != 32
        at = np.flatnonzero(ok)
        h = (code[at] + np.uint32(width)) * _SEEDS[width - 1]
        yield ((h ^ (h >> np.uint32(15))) % np.uint32(buckets)).astype(np.int64), at


def codewords(languages: int) -> np.ndarray:
    """Codewords (+1 and -1) as rows. Up to 7 languages: all splits of them into two groups; more: seeded random
    columns, 4 times as many as binary counting needs and then some, of the draws that with the largest least distance."""
    if languages <= 1:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 7:
        n = (1 << (languages - 1)) - 1
        columns = [[1 if i == 0 or (k >> (i - 1)) & 1 else -1 for i in range(languages)] for k in range(n)]
        return np.array(columns, dtype=np.int8).T
    draw = np.random.default_rng(7)
    n = 15 + 4 * (languages - 1).bit_length()
    best, reach = None, -1
    for _ in range(200):
        words = draw.choice(np.array([-1, 1], dtype=np.int8), size=(languages, n))
        apart = (n - words.astype(int) @ words.T.astype(int)) // 2 + np.eye(languages, dtype=int) * n
        split = (np.abs(words.sum(axis=0)) < languages).all()
        if split and apart.min() > reach:
            best, reach = words, int(apart.min())
    return best


def _counted(buckets: int, languages: list[str]):
    code = {language: i for i, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), buckets), dtype=np.int64)
        for batch in batches:
            index = np.array([code[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, end, raw, bounds in slices(batch.column("text"), 1 << 21):
                owner = np.repeat(index[first:end], np.diff(bounds))
                for bucket, at in grams(raw, bounds, buckets):
                    total += np.bincount(owner[at] * buckets + bucket, minlength=total.size).reshape(total.shape)
        language, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[language, bucket])], names=["language", "bucket", "n"])

    return run


@dataclass
class Model:
    """Learned languages, their codewords, per bit a log-odds per bucket, and the bits' decoding weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of exp(-loss) and the lead over the runner-up, from mean log-odds per bit."""
        z = np.clip(margins * SHARPNESS, -30, 30)
        loss = np.stack([(np.logaddexp(0, -z * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        ranked = np.sort(share, axis=1)
        lead = ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0.0)
        return loss.argmin(axis=1), share.max(axis=1), lead


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Fit on the rows for which ``learn`` holds. The driver gets one count per language and bucket."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((0, buckets), np.float32), np.zeros(0))
    counts = rows.mapInArrow(_counted(buckets, languages), "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((len(languages), buckets))
    seen[counts["language"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    # every language weighs the same on its side of a bit, however many rows it has
    chance = (seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * buckets)
    odds, trust = [], []
    for bit in code.T:
        yes, no = chance[bit > 0], chance[bit < 0]
        log_odds = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0)) if len(no) else np.zeros(buckets)
        odds.append(np.clip(log_odds, -6, 6))
        # trust: the least mean margin of a language on its own side, so a bit that separates badly counts little
        trust.append(max(1e-3, float(min((chance[i] * odds[-1]).sum() * bit[i] for i in range(len(languages))))))
    trust_ = np.array(trust) / np.mean(trust)
    return Model(languages, code, np.array(odds, dtype=np.float32), trust_)


def _predicted(model: Model, ambiguous: float):
    table = np.ascontiguousarray(model.odds.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for first, end, raw, bounds in slices(batch.column("text"), 1 << 21):
                n = end - first
                bits = len(model.code.T) if model.languages else 0
                sums, seen = np.zeros((n, bits)), np.zeros(n)
                for bucket, at in grams(raw, bounds, table.shape[0]) if bits else ():
                    cuts = np.searchsorted(at, bounds)
                    for b in range(bits):
                        run_ = np.concatenate([[0.0], np.cumsum(table[:, b][bucket], dtype=np.float64)])
                        sums[:, b] += run_[cuts[1:]] - run_[cuts[:-1]]
                    seen += np.diff(cuts)
                known = letters[first:end] & bool(model.languages)
                best, share, lead = model.decode(sums / np.maximum(seen, 1)[:, None]) if bits else (np.zeros(n, int), np.zeros(n), np.zeros(n))
                names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                flags = known & (lead < ambiguous)
                keys = [batch.column(c).slice(first, n) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(names), pa.array(np.where(known, share, 0.0)), pa.array(flags)], names=["doc_id", "row", "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", ambiguous: float = 0.2, row: Column | None = None) -> DataFrame:
    """doc_id, row, lang_pred, score (0 to 1) and whether the lead over the runner-up is below ``ambiguous``.

    Only the text enters a prediction.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(_predicted(model, ambiguous), "doc_id long, row long, lang_pred string, score double, ambiguous boolean")
