"""Substring dedup over bytes: suffixes sorted by bucket-pointer refinement.

Repeats are sought where an anchor piece of their window repeats (see ``repeats``). In a shard the suffixes of all
contexts are put into initial q-gram buckets; a bucket is refined by sorting its members on the bucket identifiers they
have at a later offset, which doubles the depth of all identifiers, and the refined identifiers are the sort keys of
the next round. Members of a bucket that weighs less than two places cannot repeat and leave at once. After the round
that reaches the window's length, a bucket with two or more places is a repeated window.

Suffixes of different pieces, or at different places around their anchor, start in different buckets.

Defined cases: null and empty texts have no bytes (digest of the empty string); texts shorter than a window keep all;
repeated rows are repeats of each other; a text of any length is one row of one task, with memory in proportion to it;
an empty table gives an empty result. Buckets are told apart by 64-bit hashes of q-grams and contexts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from skuflow.llm.repeats import Bytes, by_groups, without_repeats
from skuflow.llm.textscan import BYTE_VALUE, Rolling, mix

WINDOW = 200
PIECE = 64
UNITS = 1 << 21


def _buckets(keys: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Identifiers of equal keys, from 0; -1 where the bucket weighs less than two."""
    order = np.argsort(keys)  # the order of equal keys tells nothing
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    heavy = np.add.reduceat(weight[order], np.flatnonzero(new)) >= 2
    name = np.where(heavy, np.cumsum(heavy) - 1, -1)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = name[np.cumsum(new) - 1]
    return out


def refine(window: int):
    """Index function: covered stretch around the anchor of every context."""

    def index(group: np.ndarray, weight: np.ndarray, left: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)  # a run is far shorter than 2^31
        offset = np.arange(len(content), dtype=np.int32) - (begin + left).astype(np.int32)[owner]
        end = (begin + size).astype(np.int32)[owner]
        depth = max(1, window // 8)
        before, after = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        at = np.flatnonzero(np.arange(len(content)) + depth <= end)
        grams = Rolling(BYTE_VALUE[content]).fixed(depth)[at]
        keys = mix(grams + (group[owner[at]].astype(np.int64) * (1 << 20) + offset[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        name = np.full(len(content), -1, dtype=np.int64)
        name[at] = _buckets(keys, weight[owner[at]])
        while depth < window:
            step = min(depth, window - depth)
            at = np.flatnonzero(name >= 0)
            at = at[at + step + depth <= end[at]]
            at = at[name[at + step] >= 0]
            if step + depth == window:
                at = at[offset[at] <= 0]
            if not len(at):
                return before, after
            refined = _buckets(name[at] * (name.max() + 1) + name[at + step], weight[owner[at]])
            name = np.full(len(content), -1, dtype=np.int64)
            name[at] = refined
            depth += step
        starts = np.flatnonzero(name >= 0)
        if len(starts):
            first = np.flatnonzero(np.concatenate([[True], owner[starts][1:] != owner[starts][:-1]]))
            last = np.append(first[1:], len(starts)) - 1
            before[owner[starts[first]]] = -offset[starts[first]]
            after[owner[starts[last]]] = offset[starts[last]] + window
        return before, after

    return index


def remove_repeats(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256: texts without the bytes of any repeated ``window``."""
    return without_repeats(docs, Bytes(window, piece), by_groups(refine(window), UNITS), key, text)
