"""Whitening against a dense solver, runs against all periods, language-model scores against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skuflow.llm import queries, runs, trielm, whitening
from skuflow.llm.eliasfano import EliasFano

# --- whitening


def _vectors(spark, tmp_path, rows, label="v"):
    path = str(tmp_path / label)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, n int, vector int").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def _dense(rows, components):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    y = z.astype(float) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return (z * z).sum(axis=1), values, y @ vectors / np.sqrt(values), np.trace(cov)


@pytest.mark.parametrize("size,components", [(48, 16), (6, 32), (40, 32)])
def test_whitening_against_a_dense_solver(spark, tmp_path, size, components):
    draw = np.random.default_rng(size)
    data = (draw.standard_normal((300, size)) * np.linspace(0.2, 2, size)).astype(np.float32)
    bad = [None, [None] * size, [float("nan")] + [0.0] * (size - 1), [float("inf")] * size, [], [1.0]]
    rows = [(i, v.tolist(), None, None, None) for i, v in enumerate(data)] + [(1000 + i, v, "x", 1, 2) for i, v in enumerate(bad)] + [(None, data[0].tolist(), None, None, None), (5, data[5].tolist(), None, None, None)]
    fitted = whitening.Whitening(_vectors(spark, tmp_path, rows), components=components)
    got = fitted.rows().toPandas()
    used = [*data, data[0], data[5]]
    deviation, values, whitened, trace = _dense(used, components)
    k = min(size, components)
    assert len(got) == len(used) * k and set(got["n"]) == {len(used)}
    assert got["identity_error"].max() < 1e-10 and fitted.spectrum.residual < 1e-11
    one = got[got["key"] == 17].sort_values("component")
    assert set(one["deviation"]) == {deviation[17]}
    np.testing.assert_allclose(np.abs(one["whitened"]), np.abs(whitened[17]), rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(one["explained"], values / trace, rtol=1e-10)
    assert (got[got["key"].isna()]["deviation"] == deviation[0]).all()
    first = got[got["component"] == 1].dropna().sort_values("key").drop_duplicates("key")["whitened"].to_numpy()
    sign = np.sign(first[0] * whitened[0, 0])
    np.testing.assert_allclose(sign * first, whitened[:300, 0], rtol=1e-7, atol=1e-9)


def test_whitening_without_variance_and_without_rows(spark, tmp_path):
    same = _vectors(spark, tmp_path, [(i, [1.0, 2.0], None, None, None) for i in range(5)], "same")
    assert whitening.Whitening(same).rows().count() == 0
    nothing = _vectors(spark, tmp_path, [], "nothing")
    assert whitening.Whitening(nothing).rows().count() == 0
    flat = _vectors(spark, tmp_path, [(i, [float(i), 2.0, -float(i)], None, None, None) for i in range(9)], "flat")
    assert {r["component"] for r in whitening.Whitening(flat).rows().collect()} == {1}


def test_deviations_that_exceed_a_long_are_null(spark, tmp_path):
    rows = [(i, [1e9 * i, 1.0], None, None, None) for i in range(4)]
    got = whitening.Whitening(_vectors(spark, tmp_path, rows)).rows().collect()
    assert len(got) == 4 and all(r["deviation"] is None for r in got) and abs(got[0]["whitened"]) > 1


@pytest.mark.parametrize("spectrum", ["falling", "clusters", "flat"])
def test_filtered_subspaces_reach_the_leading_pairs(spectrum):
    draw = np.random.default_rng(4)
    q = np.linalg.qr(draw.standard_normal((200, 200)))[0]
    values = {"falling": 0.97 ** np.arange(200), "clusters": np.r_[np.full(20, 50.0), np.linspace(2, 1, 180)], "flat": np.linspace(1.2, 0.8, 200)}[spectrum]
    a = (q * values) @ q.T
    found, basis, residual = whitening.leading(200, 32, lambda b: a @ b)
    np.testing.assert_allclose(found, values[:32], rtol=1e-10)
    assert residual < 1e-11
    if spectrum != "clusters":
        np.testing.assert_allclose(np.abs((basis * q[:, :32]).sum(axis=0)), 1, atol=1e-8)


# --- runs


def _all_runs(w, least):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.add((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("least", [4, 12, 13])
def test_runs_against_all_periods(spark, least):
    draw = random.Random(least)
    texts = [None, "", " \n ", "a", "a " * 40, "é ü " * 30, " ".join("ab"[bin(i).count("1") % 2] for i in range(300))]
    for _ in range(150):
        n, k = draw.randrange(70), draw.choice([1, 2, 3, 9])
        w = [f"w{draw.randrange(k)}" for _ in range(n)]
        a, p = draw.randrange(n + 1), 1 + draw.randrange(8)
        texts.append("\t ".join(w[i] if i < a or draw.random() < 0.3 and a % 2 else w[min(n - 1, a + (i - a) % p)] for i in range(n)))
    texts += texts[-3:]
    rows = [(None if i % 50 == 3 else i, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int, key int").repartition(4)
    got = Counter((r["key"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in runs.collapse_runs(docs, least).collect())
    want: Counter = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = _all_runs(w, least)
        want[(i, len(w), tuple(found), " ".join(_collapsed(w, found)))] += 1
    assert got == want


def test_long_texts_of_one_word_and_of_no_period():
    n = 60_000
    assert [x.tolist() for x in runs.runs_of(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [0], [n], [1]]
    assert not len(runs.runs_of(np.arange(n), np.array([0, n]))[0])


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(runs, "word_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(50))])], names=["key", "text"])
    (out,) = runs._collapse(12)(iter([batch]))
    assert out.column("runs").to_pylist() == [[]] and out.column("n_words").to_pylist() == [50]


def test_query_of_runs_against_all_periods(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = got[d["doc_id"]]
        if n > 400 and h % 10:
            continue  # the plain search takes long, and few of these have runs
        found = _all_runs(w, 12) if n <= 400 else None
        if found is None:
            assert r["n_runs"] >= (1 if n - a >= 12 and (n - a) >= 2 * p else 0)
            continue
        seen += len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == ((len(found), *best) if best else (0, None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(_collapsed(w, found)).encode()).hexdigest()
    assert seen > 5


def test_runs_of_an_empty_table(nothing):
    assert runs.collapse_runs(nothing).count() == 0


# --- language model


def _model(rows, strength):
    """Scores by plain counting: rows are (key, text, teaches)."""

    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    one, two, heads = Counter(), Counter(), Counter()
    for _, t, teaches in rows:
        if teaches:
            seq = tokens(t)
            one.update(seq)
            two.update(zip([()] + seq[:-1], seq, strict=True))
            heads.update([()] + seq[:-1])
    n, v = sum(one.values()), len(one)
    out = []
    for key, t, _ in rows:
        seq = tokens(t)
        p1 = [(one[w] + 1) / (n + v + 1) for w in seq]
        p2 = [(two[(a, w)] + strength * p) / (heads[a] + strength) for a, w, p in zip([()] + seq[:-1], seq, p1, strict=True)]
        out.append((key, len(seq), sum(one[w] > 0 for w in seq), sum(map(math.log10, p1)), sum(map(math.log10, p2))))
    return out, n


def _check(model, rows, strength):
    want, n = _model(rows, strength)
    assert model.lexicon.n == n
    order = lambda r: (r[0] is None, r[0], r[1], r[2], round(r[3], 6))
    got = sorted(((r["key"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in model.scores().collect()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], abs=1e-6, rel=1e-9)
        assert abs(g[4] - w[4]) <= 0.002 * w[1] + 1e-9


@pytest.mark.parametrize("frequent,hot,per_shard", [(1, 1 << 20, 500), (1 << 14, 1 << 20, 1 << 22), (8, 20, 300)])
def test_scores_against_plain_counting(spark, messy, monkeypatch, frequent, hot, per_shard):
    monkeypatch.setattr(trielm, "HOT", hot)
    teaches = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    rows = [(r["doc_id"], r["text"], r["t"]) for r in messy.select("doc_id", "text", teaches.alias("t")).collect()]
    model = trielm.train(messy, teaches, strength=7.0, frequent=frequent, per_shard=per_shard)
    if per_shard < 1000:
        assert model.shards > 20
    _check(model, rows, 7.0)


def test_scores_when_nothing_teaches_and_of_an_empty_table(spark, messy, nothing):
    short = messy.where("length(text) < 300 or text is null")
    rows = [(r["doc_id"], r["text"], False) for r in short.select("doc_id", "text").collect()]
    _check(trielm.train(short, F.lit(False), strength=3.0), rows, 3.0)
    assert trielm.train(nothing, F.lit(True)).scores().count() == 0


def test_scores_do_not_depend_on_the_splits(spark, messy, tmp_path):
    path = str(tmp_path / "one")
    messy.coalesce(1).write.parquet(path)
    columns = ["key", "n_tokens", "n_known", "score"]
    one, other = (sorted(map(tuple, trielm.train(d, F.lit(True), frequent=2, per_shard=5000).scores().select(columns).collect()), key=str) for d in (messy, spark.read.parquet(path)))
    assert one == other


def test_distribution_over_successors_sums_to_one():
    """All known words and the unknown one, after any context, by the formula the tries store."""
    counts, pairs, strength = {"a": 5, "b": 2, None: 3}, {("a", "b"): 2, ("a", "a"): 1}, 4.0
    n, v, c = sum(counts.values()), len(counts), 5
    p1 = {w: (k + 1) / (n + v + 1) for w, k in counts.items()} | {"?": 1 / (n + v + 1)}
    total = sum((pairs.get(("a", w), 0) + strength * p) / (c + strength) for w, p in p1.items())
    assert total + (c - 3) / (c + strength) == pytest.approx(1)


# --- Elias-Fano


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], list(range(500)), [3, 3, 9, 1 << 40, 1 << 40, (1 << 40) + 1]])
def test_elias_fano_sequences(values):
    values = np.array(values, dtype=np.int64)
    made = EliasFano.of(values)
    buffer = b"pad-pad!" + b"".join(a.tobytes() for a in made.arrays())
    back, end = EliasFano.view(memoryview(buffer), 8)
    assert end == len(buffer)
    every = np.arange(len(values))
    assert back[every].tolist() == values.tolist()
    probes = np.unique(np.concatenate([values, values + 1, np.maximum(values - 1, 0), [0, 5, 1 << 41]]))
    for low, high in {(0, len(values)), (len(values) // 3, len(values) - len(values) // 4)}:
        place, found = back.successor(probes, np.full(len(probes), low), np.full(len(probes), high))
        for x, f in zip(probes.tolist(), found.tolist(), strict=True):
            assert f == (x in values[low:high].tolist())
        hit = np.flatnonzero(found)
        assert (values[place[hit]] == probes[hit]).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    draw = np.random.default_rng(2)
    pairs = np.unique(draw.integers(1, 400, (3000, 2)) * np.array([1, 7]), axis=0)
    steps = draw.integers(0, 60000, len(pairs))
    trie = trielm.Trie(trielm.Trie.build(pairs[:, 0], pairs[:, 1], steps))
    held = {tuple(p): int(s) for p, s in zip(pairs.tolist(), steps, strict=True)}
    asked = draw.integers(0, 3000, (5000, 2))
    asked[:3000] = pairs[draw.integers(0, len(pairs), 3000)]
    found, got = trie.find(asked[:, 0], asked[:, 1])
    assert [(f, int(s)) for f, s in zip(found.tolist(), got, strict=True)] == [(tuple(a) in held, held.get(tuple(a), 0)) for a in asked.tolist()]
