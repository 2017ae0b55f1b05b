"""The two substring operators against counting every window."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from skuflow.llm import fmindex, repeats, suffixes


def removed(units, window: int, joiner: bytes | None):
    seen = Counter(tuple(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone, reach = [False] * len(u), 0
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] > 1:
                for j in range(max(i, reach), i + window):
                    gone[j] = True
                reach = i + window
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(u), sum(gone), spans, hashlib.sha256(bytes(kept) if joiner is None else joiner.join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("window,piece", [(35, 12), (12, 4), (7, 7)])
def test_words_against_all_windows(messy, window, piece):
    texts = [r["text"] or "" for r in messy.select("text").collect()]
    want = Counter(removed([t.encode().split() for t in texts], window, b" "))
    got = fmindex.remove_repeats(messy, window, piece).collect()
    assert Counter((r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@pytest.mark.parametrize("window,piece", [(200, 64), (41, 16)])
def test_bytes_against_all_windows(spark, tmp_path, messy, window, piece):
    short = messy.where("length(text) < 5000 or text is null")
    short.write.parquet(str(tmp_path / "d"))
    short = spark.read.parquet(str(tmp_path / "d"))
    texts = [r["text"] or "" for r in short.select("text").collect()]
    want = Counter(removed([t.encode() for t in texts], window, None))
    got = suffixes.remove_repeats(short, window, piece).collect()
    assert Counter((r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_keys_stay_with_their_texts(messy):
    want = {(r["doc_id"], len((r["text"] or "").encode())) for r in messy.select("doc_id", "text").collect()}
    assert {(r["doc_id"], r["n_units"]) for r in suffixes.remove_repeats(messy).collect()} == want


def test_empty(nothing):
    assert fmindex.remove_repeats(nothing).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0


def test_backward_search_counts_occurrences():
    draw = np.random.default_rng(1)
    text = np.concatenate([np.append(draw.integers(1, 6, n), 0) for n in (50, 1, 30, 200)])
    index = fmindex.FMIndex(text, 6)
    for _ in range(200):
        at = int(draw.integers(0, len(text) - 4))
        pattern = text[at : at + 4]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        assert high[0] - low[0] == sum((text[i : i + 4] == pattern).all() for i in range(len(text) - 3))


@pytest.mark.parametrize("window,piece,block", [(35, 12, 100), (35, 12, 1000), (200, 64, 512), (9, 9, 50)])
def test_anchors_do_not_depend_on_blocks(monkeypatch, window, piece, block):
    draw = np.random.default_rng(block)
    values = draw.integers(0, 4, 5000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values[1000:1600] = values[3000:3600]
    values[4000:4300] = 7
    cuts = np.array([0, 0, 20, 700, 2500, 2501, 4800, 5000])
    whole = repeats.anchors(values, cuts, window, piece)
    monkeypatch.setattr(repeats, "BLOCK", block)
    assert all((a == b).all() for a, b in zip(whole, repeats.anchors(values, cuts, window, piece), strict=True))
    row, place, _, _ = whole
    for r in range(len(cuts) - 1):  # every window holds an anchor
        at = np.sort(place[row == r])
        for s in range(int(cuts[r + 1] - cuts[r]) - window + 1):
            assert ((at >= s) & (at <= s + window - piece)).any()


@pytest.fixture
def other_splits(spark):
    """Call it to have Spark split tables differently from then on, as when an executor is lost or added."""
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    yield lambda: spark.conf.set(key, "2048")
    spark.conf.set(key, old)


def test_splits_that_change_between_readings(spark, tmp_path, messy, other_splits):
    path = str(tmp_path / "d")
    messy.where("length(text) < 5000 or text is null").repartition(2).write.option("parquet.block.size", 2048).parquet(path)
    docs = spark.read.parquet(path)
    units = [(r["text"] or "").encode().split() for r in docs.select("text").collect()]
    left = fmindex.remove_repeats(docs, 12, 4)
    before = docs.rdd.getNumPartitions()
    other_splits()
    assert spark.read.parquet(path).rdd.getNumPartitions() != before
    got = Counter((r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in left.collect())
    assert got == Counter(removed(units, 12, b" "))


def test_an_index_that_misses_what_it_was_promised_fails():
    import pyarrow as pa

    waiting = pa.table([pa.array([7]), pa.array([np.array([2, 4], np.uint64).tobytes()])], names=["part", "data"])
    head = np.array([[9], [2], [1], [0], [3]], np.uint64).tobytes() + b"abc"
    import zstandard

    sent = pa.table([pa.array([1]), pa.array([zstandard.ZstdCompressor().compress(head)])], names=["n", "data"])
    with pytest.raises(RuntimeError):
        repeats._indexed(lambda g, w, left, size, content: (left * 0, left * 0), np.uint8)(sent, waiting)


def test_a_table_that_is_no_scan_is_written_first(spark, messy):
    docs = messy.where("length(text) < 500").unionByName(messy.where("length(text) < 500"))
    units = [(r["text"] or "").encode().split() for r in docs.select("text").collect()]
    got = Counter((r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in fmindex.remove_repeats(docs, 12, 4).collect())
    assert got == Counter(removed(units, 12, b" "))


@pytest.mark.parametrize("kind,window,piece", [("words", 12, 4), ("words", 7, 7), ("bytes", 41, 16)])
def test_large_groups_never_reach_one_index(spark, tmp_path, kind, window, piece):
    """One passage in many surroundings: no index sees more of its contexts than ``large``."""
    draw = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(window + 6))
    texts = [f"a{i % 90} b{draw.integers(9)} {passage} c{draw.integers(4)} d{i % 70} e{draw.integers(999)}" for i in range(160)]
    texts += ["", passage, texts[0], f"x {passage}", *(" ".join(f"u{draw.integers(50)}" for _ in range(40)) for _ in range(20))]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    unit, inner = (repeats.Words(window, piece), fmindex.statistics(window, piece)) if kind == "words" else (repeats.Bytes(window, piece), suffixes.refine(window))
    large = 12

    def bounded(group, weight, left, size, content):
        assert np.bincount(group).max() <= large
        return inner(group, weight, left, size, content)

    got = repeats.without_repeats(spark.read.parquet(path), unit, repeats.by_groups(bounded, 1 << 20), large=large).collect()
    units = [t.encode().split() if kind == "words" else t.encode() for t in texts]
    want = Counter(removed(units, window, b" " if kind == "words" else None))
    assert Counter((r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_contents_are_put_in_order_without_places_of_all_units(monkeypatch):
    import tracemalloc

    draw = np.random.default_rng(3)
    size = draw.integers(0, 340, 40_000)
    content = draw.integers(0, 256, int(size.sum())).astype(np.uint8)
    begin = np.cumsum(size) - size
    order = draw.permutation(len(size))
    tracemalloc.start()
    got = repeats._in_order(content, begin[order], size[order])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tobytes() == b"".join(content[begin[i] : begin[i] + size[i]].tobytes() for i in order)
    assert peak < 5 * len(content)  # at once it takes 25 times the units
    assert len(repeats._in_order(content[:0], begin[:0], size[:0])) == 0
