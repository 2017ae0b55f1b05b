from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, size string, shard string, part string, h string"


def _text(draw: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def messy_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies and shared passages."""
    draw = random.Random(5)
    passage = _text(draw, 70, 5000)
    long = _text(draw, 30_000, 900)
    texts = [None, "", "   \n\t ", "one", "two words", "a b c", passage, passage, f"x {passage} y", f"{passage} tail end here", long, long + " more", "aaaa " * 90, "é" * 300, "ÀÉ ñandú œuvre " * 40]
    texts += [_text(draw, draw.randrange(1, 120), 40) for _ in range(40)]
    texts += [texts[-1], texts[-2], texts[-2]]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "ß"][i % 4], len(t or ""), None, "l", "s", "h", "p", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0]]  # repeated rows
    rows += [(None, "no key", None, None, None, 1, None, None, None, None, "c"), (None, None, None, None, None, None, None, None, None, None, None), (None, passage, "en", "s1", 3, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "docs")
    spark.createDataFrame(messy_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing") / "docs")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)
