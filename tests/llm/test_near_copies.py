"""The pipeline's near-dedup against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from tidewell.llm import near_copies, simhash


def _near_copies(rng, n_groups=40):
    """Copies of texts with words exchanged, of about every similarity above 0.6."""
    word = lambda: f"w{rng.integers(5000)}"
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range((60, 200, 600)[g % 3])]
        texts.append(" ".join(base))
        for _ in range(4):
            copy, share = list(base), rng.uniform(0.001, 0.05)
            for i in np.flatnonzero(rng.random(len(copy)) < share):
                copy[i] = word()
            texts.append(" ".join(copy))
    return texts


def _brute(texts, shingle, similarity, bits):
    sets = [set(simhash.shingle_hashes((t or "").encode(), shingle).tolist()) for t in texts]
    fps = [simhash.fingerprint((t or "").encode(), shingle) for t in texts]
    root, alike, close = list(range(len(texts))), 0, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = not (sets[i] | sets[j]) or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
            alike, close = alike + near, close + (near and (fps[i] ^ fps[j]).bit_count() <= bits)
            if near or (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in range(len(texts))}, alike, close


def test_near_dedup_keeps_one_of_each_similar_group(spark):
    texts = [*_near_copies(np.random.default_rng(7)), "", None, " \n", "One two", "one  TWO", "one three"]
    want, alike, close = _brute(texts, 5, 0.8, 4)
    assert alike > 2 * close  # four bits alone find under half of the pairs
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
    assert near_copies.links(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1000, 3])
def test_links_connect_all_pairs_that_share_a_band(spark, most):
    """Chains, groups and stray texts in the same buckets, which one row a band makes large."""
    rng, bands = np.random.default_rng(4), near_copies.Bands(bands=4, rows=1)
    texts = []
    for _ in range(6):
        now = [f"w{rng.integers(400)}" for _ in range(60)]
        for _ in range(14):
            at = int(rng.integers(60))
            now = now[:at] + [f"w{rng.integers(400)}"] + now[at + 1 :]
            texts.append(" ".join(now))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = near_copies.links(docs, shingle=1, bands=bands, most=most).collect()
    hashes = [r["h"] for r in docs.orderBy("doc_id").selectExpr("xxhash64(text) h").collect()]
    sets = [near_copies.shingle_set(t.encode(), 1) for t in texts]
    keys = [bands.keys(s) for s in sets]
    number = {h: i for i, h in enumerate(hashes)}
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    got, want = list(range(len(texts))), list(range(len(texts)))

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    for r in found:
        i, j = number[r["a"]], number[r["b"]]
        assert alike(i, j)
        got[find(got, i)] = find(got, j)
    for i in range(len(texts)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and alike(i, j):
                want[find(want, i)] = find(want, j)
    for i in range(len(texts)):
        for j in range(i):
            assert (find(got, i) == find(got, j)) == (find(want, i) == find(want, j))
    assert len(found) < len(texts) * 4


def test_recall_of_bands():
    """Share of pairs of similarity just above 0.8 that share a band."""
    rng, bands, met = np.random.default_rng(1), near_copies.Bands(), 0
    for _ in range(600):
        both = rng.integers(0, 1 << 64, 160, dtype=np.uint64)
        one, two = (np.concatenate([both, rng.integers(0, 1 << 64, 20, dtype=np.uint64)]) for _ in range(2))
        met += bool((bands.keys(one) == bands.keys(two)).any())
    assert met >= 597
