"""The log-bilinear model against plain loops, its normalisation, and its gain over unigrams."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import logbilinear as lb
from tidewell.llm.common import kept_names

LONG = " ".join(f"word{i}" for i in range(60_000))
TEXTS = [None, "", " \n\t", "one two three ONE two", "one two three ONE two", LONG, "Été à Noël où ça\x0bune fois", "!!! 123 one", "a" * 5000, "x " + "a" * 5000, "z" * 64 + " " + "z" * 65]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "own") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[0], (None, None, None)], "doc_id long, text string, score string").repartition(3)


def _tokens(text):
    return [w if len(w) <= 64 else b" " + xxhash.xxh3_128_digest(w) for w in (x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))] + [b""]


def _log_softmax(x, at):
    return x[at] - np.log(np.exp(x - x.max()).sum()) - x.max()


@pytest.mark.parametrize("head", [200_000, 9])
def test_scores_by_loops(docs, head):
    shape = lb.Shape(vectors=40, min_count=2, endings=5, head=head, dim=6, batch=64)
    train = docs.where("doc_id is null or doc_id % 5 != 1")
    counts, lex, model = lb.fit(train, shape=shape)
    c = Counter(w for r in train.collect() for w in _tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    assert (model["tokens"], model["distinct"]) == (n, v)
    assert {bytes(r["token"]): r["n"] for r in counts.collect()} == c
    words = lex.words.to_pylist()
    vectors = {w: lex.unit_of_word[i] for i, w in enumerate(words[: lex.n_vectors])}
    assert lex.n_vectors == min(sum(x >= 2 for x in c.values()), 40, len(words))
    group = lambda w: int(lex.ending(pa.array([w], pa.binary()))[0])
    m = lb.LogBilinear(lex, shape.dim)
    m.rows = model["rows"].astype(float)
    r, q, g, a, b = m.parts()
    tails = Counter()
    for w in c:
        if w not in vectors:
            tails[group(w), "n"] += c[w]
            tails[group(w), "v"] += 1
    got = lb.score(docs, counts, lex, model, ["doc_id", "text", "score"])
    assert got.columns == ["doc_id", "text", "own_score", "n_tokens", "n_known", "base_score", "score"]
    got = got.collect()
    assert len(got) == docs.count()
    for row in got:
        own = _tokens(row["text"])
        assert (row["n_tokens"], row["n_known"]) == (len(own), sum(c[w] > 0 for w in own))
        assert abs(row["base_score"] - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 * len(own)
        if len(own) > 1000:
            continue
        units = [vectors[w] if w in vectors else lex.unit_of_ending[group(w)] for w in own]
        before, score = [vectors[b""]] * 2 + units, 0.0
        for i, (w, u) in enumerate(zip(own, units)):
            h, k = r[before[i]] @ b + r[before[i + 1]] @ a, lex.class_of[u]
            lo, hi = lex.starts[k], lex.starts[k + 1]
            score += (_log_softmax(g[:, :-1] @ h + g[:, -1], k) + _log_softmax(q[lo:hi, :-1] @ h + q[lo:hi, -1], u - lo)) / np.log(10)
            if w not in vectors:
                score += np.log10((c[w] + 1) / (tails[group(w), "n"] + tails[group(w), "v"] + 1))
        assert abs(row["score"] - score) < 1e-4 * len(own)


def test_empty(docs):
    nothing = lb.fit(docs.limit(0))
    assert lb.score(docs.limit(0), *nothing, ["doc_id"]).count() == 0
    assert lb.score(docs, *nothing, ["doc_id"]).where("isnan(score) or score is null or n_known > 0").count() == 0


def test_probabilities_sum_to_one_and_beat_unigrams(spark):
    rng = np.random.default_rng(1)
    words = [[f"{k}{i}" for i in range(300)] for k in "ab"]
    share = 1 / np.arange(1, 301)
    rows = [(i, " ".join(rng.choice(words[i % 2], 80, p=share / share.sum()))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts, lex, model = lb.fit(docs.where("doc_id % 6 <> 5"))
    m = lb.LogBilinear(lex, model["dim"])
    m.rows = model["rows"]
    units = np.arange(len(lex.sizes))
    for far, near in rng.integers(0, len(units), (20, 2)):
        p = 10 ** lb.log10_units(lex, m, np.full(len(units), far), np.full(len(units), near), units)
        assert abs(p.sum() - 1) < 1e-4
    held = lb.score(docs.where("doc_id % 6 = 5"), counts, lex, model, ["doc_id"]).agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.2  # of log10(2) that the language alone is worth


def test_steps_follow_the_objective():
    """A step's gradient by finite differences of the noise-contrastive objective."""
    rng = np.random.default_rng(3)
    sizes = np.array([50, 30, 20, 10, 5, 5, 2, 1])
    lex = lb.Lexicon(pa.array([], pa.binary()), sizes, 8, 0, np.arange(8), np.zeros(0, int), sizes, np.array([0, 1, 3, 5, 8]), np.zeros(0))
    shape = lb.Shape(dim=3, noise=5, inner=2, rate=1.0)
    far, near, unit = rng.integers(0, 8, (3, 40))

    def model():
        m = lb.LogBilinear(lex, 3)
        m.rows = np.random.default_rng(5).normal(0, 0.5, m.rows.shape).astype(np.float32)
        m.rows[:8, 3] = 0
        m.squares[:] = 1e8  # so that all steps have one size
        return m

    def objective(m):
        t = lb.Trainer(m, lex, shape, 9)
        r, q, g, a, b = (x.astype(float) for x in m.parts())
        h = r[near] @ a + r[far] @ b
        c = t.class_of[unit]
        noise = np.searchsorted(t.cum, t.rng.random(5))
        s = lambda x: np.log(1 / (1 + np.exp(-x)))
        total = s((h * g[c, :3]).sum(1) + g[c, 3] - t.log_noise[c]).sum() + s(-(h @ g[noise, :3].T + g[noise, 3] - t.log_noise[noise])).sum()
        many = np.flatnonzero(t.widths[c] > 1)
        for j in range(3):
            cm = c[many]
            at = unit[many] if j == 0 else t.starts[cm] + (t.rng.random(len(many), np.float32) * t.widths[cm]).astype(int)
            x = (h[many] * q[at, :3]).sum(1) + q[at, 3] - t.log_inner[cm]
            total += s(x if j == 0 else -x).sum()
        return total

    before, after = model(), model()
    lb.Trainer(after, lex, shape, 9).step(far, near, unit)
    moved = (after.rows - before.rows).astype(float)
    n = 2 * 8 + 4
    for row, column in [(0, 0), (3, 2), (8 + 1, 1), (8 + 4, 3), (8 + 6, 0), (16, 3), (18, 2)]:
        low, high = model(), model()
        low.rows[row, column] -= 1e-2
        high.rows[row, column] += 1e-2
        want = (objective(high) - objective(low)) / 2e-2
        assert abs(1e4 * moved[row, column] - want) < 0.02 * abs(want) + 0.05, (row, column)
    assert after.met[n:].tolist() == [40] * 6


def test_kept_names():
    assert kept_names(["a", "score", "own_score"], ["score"]) == ["a", "own_score", "own_own_score"]


def test_warm_sample_is_drawn_by_all_tasks_and_once_for_each_text(spark):
    copies = spark.range(0, 100_000, 1, 6).select(F.lit("the same text again").alias("text"), F.lit(1).alias("other"))
    some = spark.range(500).select(F.concat(F.lit("text number "), "id").alias("text"), F.lit(1).alias("other"))
    sample = lb.warm_sample(copies.union(some), "text", 1.0)
    assert sample.columns == ["text"] and sample.count() == 501 and sample.rdd.getNumPartitions() == 1
    assert [r["text"] for r in sample.collect()] == [r["text"] for r in lb.warm_sample(some.union(copies), "text", 1.0).collect()]
    assert "Coalesce 1" not in sample._jdf.queryExecution().toString()
    assert 100 < lb.warm_sample(copies.union(some), "text", 0.5).count() < 400
