from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.llm import decontaminate, topk, warc


def plain_top(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        query = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=False)), i) for i, v in usable if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("shard,few", [(4096, 96), (64, 4)])
def test_topk_against_all_pairs(spark, monkeypatch, shard, few):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "FEW", few)
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(i, [0.25] * 8) for i in range(400, 500)] + [(500, [0.0] * 8), (550, [1.0, -1.0])]  # ties, zeros, other lengths
    rows += [(600, None), (601, []), (602, [1.0, None]), (603, [float("nan")] * 8), (604, [float("inf")] * 8), (None, [1.0] * 8), (3, [0.5] * 8), (50, [0.1] * 8)]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(plain_top(rows, 5))


def test_topk_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 1, 131072), (0, 2, 2, -196608)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_leaks_against_all_pairs(spark, messy, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST", limit)
    texts = [r["text"] for r in messy.select("text").collect() if r["text"] and len(r["text"]) > 100]
    part = texts[0].split()
    items = [(0, " ".join(part[:40])), (1, " ".join(part[5:45]).upper()), (2, " ".join([*part[:30], "changed", "words", *part[32:60]])), (3, " ".join([*part[:10], *"now it is another text that goes on".split()]))]
    items += [(4, "two words"), (5, "two"), (6, None), (7, ""), (8, " ".join(part[:40])), (None, " ".join(part[:12])), (9, "w1 w1 w1 w1 w1 w1 w1")]
    items += [(100 + i, " ".join(t.split()[3 : 20 + i])) for i, t in enumerate(texts[:20])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, class string")
    want = Counter()
    for key, text in {(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()}:
        for i, t in items:
            mine = shingles(t)
            if mine and len(mine & shingles(text)) >= 0.8 * len(mine) - 1e-9:
                want[(key, i, len(mine & shingles(text)), len(mine))] += 1
    got = decontaminate.contained(messy, frame).collect()
    assert Counter((r["doc_id"], r["item_id"], r["found"], r["shingles"]) for r in got) == want
    assert len(want) > 30


def test_leaks_empty(spark, messy, nothing):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained(nothing, items).count() == 0
    assert decontaminate.contained(messy, items.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, hex string"


def page_rows():
    rows = [(i, f"http://h{i % 3}/p{i}", f"<p>{'é' * (i % 7)}{i % 9}</p>" * (i % 50), "c") for i in range(200)]
    rows += [(500, "u", None, None), (501, "u", "", None), (502, None, "\r\n\r\nWARC/1.1\r\n", None), (None, "n", "<p>0</p>" * 3, None), (None, None, None, None)]
    rows += [(7, "http://again", rows[7][2], None), rows[9], rows[9], (503, "line\nbreak", "x" * 300_000, None)]
    return rows


@pytest.mark.parametrize("limit,shards", [(32 << 20, 4), (2000, 1), (900, 9)])
def test_archive_round_trip(spark, tmp_path, limit, shards):
    rows = page_rows()
    folder = warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"), shards=shards, limit=limit)
    got = warc.read_archive(spark, folder, payloads=True).collect()
    first: dict[bytes, int | None] = {}
    for key, _, html, _ in rows:
        body = (html or "").encode()
        first[body] = min((x for x in (first.get(body), key) if x is not None), default=None)

    def base32(body: bytes) -> str:
        return base64.b32encode(hashlib.sha1(body).digest()).decode()

    want = Counter((key, len((html or "").encode()), base32((html or "").encode())) for key, _, html, _ in rows)
    assert Counter((r["key"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    assert Counter(r["payload_digest"] for r in got if r["record_type"] == "response") == Counter(base32(b) for b in first)
    for r in got:
        front = {base32(b): k for b, k in first.items()}[r["payload_digest"]]
        if r["record_type"] == "response":
            assert r["key"] == front and base32(r["payload"].encode()) == r["payload_digest"]
        else:
            assert r["refers_to"] == front
    assert len({r["record_id"] for r in got}) == len(rows)


def test_archive_is_the_same_again(spark, tmp_path):
    frame = spark.createDataFrame(page_rows(), PAGES)
    folders = [warc.write_archive(f, str(tmp_path / n), shards=3, limit=1500) for n, f in (("a", frame), ("b", frame.repartition(11)))]
    names = [sorted(n for n in os.listdir(f) if n.endswith(".warc.gz")) for f in folders]
    assert names[0] == names[1] and len(names[0]) > 3
    for n in names[0]:
        bodies = [open(f"{f}/{n}", "rb").read() for f in folders]
        assert bodies[0] == bodies[1]
        assert len(bodies[0]) <= 1500 or gzip.decompress(bodies[0]).count(b"WARC-Record-ID") == 1
    assert not [n for f in folders for n in os.listdir(f) if n.endswith(".tmp")]


def test_archive_of_nothing(spark, tmp_path):
    folder = warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "e"))
    assert warc.read_archive(spark, folder).count() == 0
