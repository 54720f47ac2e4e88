import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import chunking


def _sizes(spark, total):
    words = F.split(F.lit(" ".join(map(str, range(total)))), " ")
    pieces = spark.range(1).select(chunking.pieces(words).alias("p")).first()["p"]
    return [(int(p.split()[0]), len(p.split())) for p in pieces]


@pytest.mark.parametrize(
    ("total", "want"),
    [
        (201, [(0, 116), (86, 115)]),
        (370, [(0, 200), (170, 200)]),
        (371, [(0, 144), (114, 144), (228, 143)]),
        (968, [(0, 187), (157, 187), (314, 186), (470, 186), (626, 186), (782, 186)]),
    ],
)
def test_balanced_pieces(spark, total, want):
    assert _sizes(spark, total) == want


def test_greedy_groups(spark):
    counts = [50, 60, 40, 100, 150, 60, 10]
    page = "\n\n".join(" ".join(["w"] * n) for n in counts)
    rows = spark.createDataFrame([(1, "t", page)], "page_id long, title string, content string")
    got = chunking.chunk_pages(rows).orderBy("chunk_id").collect()
    assert [(r["paragraph_index"], len(r["chunk_text"].split())) for r in got] == [(0, 150), (3, 100), (4, 150), (5, 70)]


def test_fold_equals_stream_and_numbers_have_no_gap(spark):
    rng = random.Random(3)
    pages = [(i, rng.choice(["", "A  title"]), "\n\n".join(" ".join(["x"] * rng.choice([1, 30, 90, 139, 140, 141, 200, 201, 640])) for _ in range(rng.randint(0, 9)))) for i in range(40)]
    pages += [(40, "only title", " \n\n "), (41, None, None)]
    rows = spark.createDataFrame(pages, "page_id long, title string, content string").repartition(5)
    one = chunking.chunk_pages(rows).collect()
    assert sorted(one) == sorted(chunking.chunk_pages_in_python(rows).collect())
    assert {r["page_id"] for r in one} == set(range(42))
    numbered = chunking.chunks_in_order(rows).orderBy("page_id", "chunk_id").collect()
    assert [r["chunk_idx"] for r in numbered] == list(range(len(one)))
    assert chunking.chunks_in_order(rows.limit(0)).count() == 0
