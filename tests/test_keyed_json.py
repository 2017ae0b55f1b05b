"""Keyed JSON objects cut into pieces, against the json module."""

import json
import random

import pytest

from skuflow.sources.keyed_json import read_keyed_json, write_keyed_json

TRICKY = {
    "plain": 1, "": "", 'quote " and \\ slash': '}{][,:" \\" \\\\', "deep": {"a": [1, {"b": "],}"}], "c": {}}, "none": None, "list": [],
    "é€😀": "ü\n\t", "back\\\\": "\\", "long": "x," * 700 + '"{' * 300, "slashes": "\\" * 501 + '"', "true": True, "nested": {"deep": {}},
}


def rows_of(df):
    return sorted((r.key, r.value) for r in df.collect())


def expected(*objects):
    return sorted((k, json.dumps(v)) for o in objects for k, v in o.items())


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_any_cut_gives_the_same_entries(spark, tmp_path, style):
    (tmp_path / "o.json").write_text(json.dumps(TRICKY, **style), encoding="utf-8")
    for size in (17, 64, 1 << 20):
        got = read_keyed_json(spark, str(tmp_path / "o.json"), piece_bytes=size)
        assert sorted((r.key, json.dumps(json.loads(r.value))) for r in got.collect()) == expected(TRICKY), size


def test_pieces_begin_anywhere_in_escapes(spark, tmp_path):
    text = json.dumps({"a\\": "\\\\\"\\", "b": ["\\\"", "{"]})
    (tmp_path / "o.json").write_text(text)
    for size in range(1, 9):
        got = read_keyed_json(spark, str(tmp_path), piece_bytes=size)
        assert {r.key: json.loads(r.value) for r in got.collect()} == json.loads(text), size


def test_empty_repeated_and_several(spark, tmp_path):
    for name, text in {"a": "", "b": " \n", "c": "{}", "d": '{"k": 1, "k": 2}', "e": '﻿{"x": {"y": 1}}\n{"z": null}', "_skip": "no"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert rows_of(read_keyed_json(spark, str(tmp_path), piece_bytes=5)) == [("k", "1"), ("k", "2"), ("x", '{"y": 1}'), ("z", "null")]
    got = read_keyed_json(spark, str(tmp_path / "e"), "y int").collect()
    assert sorted((r.key, r.value and r.value.y) for r in got) == [("x", 1), ("z", None)]
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert read_keyed_json(spark, str(empty)).collect() == []


@pytest.mark.parametrize("text", ["[1, 2]", "3", '{"a": 1', '{"a": "b}', "{} [1]", '{"a": 1, b}'])
def test_what_is_no_object_is_an_error(spark, tmp_path, text):
    (tmp_path / "o.json").write_text(text)
    with pytest.raises(Exception, match="JSON|no key"):
        read_keyed_json(spark, str(tmp_path), piece_bytes=4).collect()


def test_round_trip_of_many_keys(spark, tmp_path):
    draw = random.Random(7)
    n = 100_000
    made = {f"sku-{i}": {"p": draw.random(), "q": {"name": f'n"{i}\\'}, "none": None} for i in range(n)}
    path = tmp_path / "one.json"
    path.write_text(json.dumps(made))
    schema = "p double, q struct<name: string>, none int"
    one = read_keyed_json(spark, str(path), schema, piece_bytes=1 << 18)
    assert one.rdd.getNumPartitions() > 20
    assert {r.key: (r.value.p, r.value.q.name) for r in one.collect()} == {k: (v["p"], v["q"]["name"]) for k, v in made.items()}

    flat = one.select("key", "value.*")
    write_keyed_json(flat, str(tmp_path / "back"), "key")
    back = read_keyed_json(spark, str(tmp_path / "back"), schema, piece_bytes=1 << 18).select("key", "value.*")
    assert back.count() == n and back.exceptAll(flat).count() == 0


def test_written_files_are_objects(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, None), (2, None, "a\nb"), (3, 5, '"')], "id int, a int, b string").repartition(2)
    write_keyed_json(df, str(tmp_path / "w"), "id")
    got = {}
    for f in (tmp_path / "w").glob("part-*"):
        got |= json.loads(f.read_text())
    assert got == {"null": {"a": 1, "b": None}, "2": {"a": None, "b": "a\nb"}, "3": {"a": 5, "b": '"'}}


def test_a_piece_is_looked_at_in_blocks(tmp_path, monkeypatch):
    import tracemalloc

    from skuflow.sources import keyed_json as K

    text = json.dumps({f"sku-{i}": {"names": {"a": 'x"\\' * (i % 7), "b": [i, "],}"]}} for i in range(60_000)}).encode()
    (tmp_path / "o.json").write_bytes(text)
    with open(tmp_path / "o.json", "rb") as file:
        tracemalloc.start()
        n = sum(1 for _ in K._piece_entries(file, 0, len(text), False, 0))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert n == 60_000
    assert peak < 4 * len(text) + 40 * K.BLOCK  # as a whole it took over 25 times the piece


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_begin_anywhere(spark, tmp_path, monkeypatch, block):
    from skuflow.sources import keyed_json as K

    monkeypatch.setattr(K, "BLOCK", block)
    text = json.dumps(TRICKY).encode()
    (tmp_path / "o.json").write_bytes(text)
    with open(tmp_path / "o.json", "rb") as file:
        got = b"{" + b",".join(K._piece_entries(file, 0, len(text), False, 0)) + b"}"
    assert json.loads(got) == TRICKY
