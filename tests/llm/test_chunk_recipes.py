"""Exact duplicates by chunk recipes against plain comparison."""

import hashlib

import numpy as np
import pytest

from tidewell.llm import chunk_recipes, queries


def _texts():
    rng = np.random.default_rng(2)
    long = "".join(chr(int(c)) for c in rng.integers(97, 123, 300_000))
    some = ["".join(chr(int(c)) for c in rng.integers(97, 103, int(n))) for n in rng.integers(1, 6000, 60)]
    return [*some, *some[:20], *some[:5], long, long, long[:-1] + "é", long + " ", "", None, "", None, " ", "ABC", "abc", "ＡＢＣ", "x" * 50_000, "x" * 50_000, "x" * 50_001]


def _want(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    low = lambda i: -1 if i is None else i
    return sorted((low(i), low(max(groups[t or ""], key=low)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), sum(1 for _ in groups)


def test_chunks_join_to_the_text_and_follow_content():
    rng = np.random.default_rng(3)
    for n in (0, 1, 15, 16, 17, 256, 257, 5000, 200_000):
        text = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        parts = chunk_recipes.chunks(text)
        assert b"".join(parts) == text and all(len(p) <= 8192 for p in parts) and all(len(p) >= 256 for p in parts[:-1])
    moved = chunk_recipes.chunks(b"new head, " + text)
    assert len(set(moved) & set(parts)) > 0.95 * len(parts)
    assert 600 < n / len(parts) < 2000
    assert {len(p) for p in chunk_recipes.chunks(b"x" * 50_000)} == {8192, 50_000 % 8192}


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_query_equals_comparison(spark, tmp_path, limit):
    rows = [(i if i != 9 else None, t) for i, t in enumerate(_texts())] + [(3, _texts()[3])] * 2
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, recipe string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, n = _want(rows)
    low = lambda i: -1 if i is None else i
    got = queries.op12_chunk_recipes(spark, str(tmp_path)).collect()
    assert sorted((low(r["doc_id"]), low(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == n and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    some = chunk_recipes.groups(docs, broadcast_bytes=limit)
    assert some.where("kept").count() == n
    stay = chunk_recipes.clean(docs)
    assert stay.columns == docs.columns and stay.count() == n and {r["text"] or "" for r in stay.collect()} == {t or "" for _, t in rows}


def test_identifiers_that_meet_are_replaced(spark):
    """A hash of one byte stands for many contents; a broken first function must not make different texts equal."""
    weak = lambda x: hashlib.md5(x).digest()[:1]
    strong = lambda x: hashlib.md5(x).digest()
    rows = [(i, f"text number {i}") for i in range(600)] + [(900, "text number 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert not chunk_recipes.verified(docs.select(docs.text.cast("binary")), weak, (1024, 256, 8192))
    got = chunk_recipes.groups(docs, identifiers=(weak, strong)).collect()
    assert {r["row"]["doc_id"]: r["keep_id"] for r in got} == {i: 900 if i == 7 else i for i, _ in rows}
    with pytest.raises(ValueError):
        chunk_recipes.groups(docs, identifiers=(weak,))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_recipes.groups(docs).collect() == []
