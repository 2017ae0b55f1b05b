from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from skuflow.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: list[int], budget: int) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(sorted(root), dtype=np.uint64)
    for x in values:
        for y in values[np.bitwise_count(values ^ x) <= budget]:
            a, b = find(int(x)), find(int(y))
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in root}


def test_fingerprints_and_groups(messy):
    rows = messy.select("doc_id", "text").collect()
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]
    roots = plain_groups([p for _, p in prints], 2)
    least: dict[int, int] = {}
    for key, p in prints:
        if key is not None:
            least[roots[p]] = min(key, least.get(roots[p], key))
    want = sorted(((k, f"{p:016x}", least.get(roots[p])) for k, p in prints), key=str)
    got = simhash.near_duplicates(messy).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want


def test_text_in_pieces_has_one_fingerprint(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000))
    monkeypatch.setattr(simhash, "_PIECE", 333)
    assert simhash.fingerprint(text.encode(), 3) == plain_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
@pytest.mark.parametrize("node", [4, 64, 100_000])
def test_trie_join_against_all_pairs(spark, monkeypatch, budget, node):
    """Random prints, dense balls around a few centres, and chains one bit apart."""
    monkeypatch.setattr(simhash, "NODE", node)
    monkeypatch.setattr(simhash, "_FRONT", 500)
    draw = random.Random(3)
    prints = {draw.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for centre in (0, draw.getrandbits(64)):
        for _ in range(300):
            prints.add(centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 4))) % (1 << 64))
    chain = draw.getrandbits(64)
    for b in range(40):
        prints.add(chain := chain ^ (1 << b))
    prints = {p % (1 << 64) for p in prints}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.trie_links(spark.createDataFrame(signed, "print long"), budget).collect()
    assert all((r["a"] ^ r["b"]) & ((1 << 64) - 1) in range(1 << 64) for r in links)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        a, b = find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))
        root[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == plain_groups(list(prints), budget)


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
