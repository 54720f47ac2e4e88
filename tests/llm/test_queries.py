"""Every registered query of the operators, and all stages of the pipeline, on a small table against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import queries, simhash
from tidewell.llm.line_quality import LineLimits

WORDS = {"en": "the of and house river stone over under light north".split(), "fr": "les des une maison rivière pierre sur sous lumière nord".split()}
FOOTER = "All rights reserved by the owners of this site and its pages"


def _texts():
    rng, out = np.random.default_rng(11), []

    def prose(lang, n):
        made = [str(rng.choice(WORDS[lang])) + (f"{rng.integers(900)}" if rng.random() < 0.6 else "") for _ in range(n)]
        return "\n".join(" ".join(made[i : i + 12]) for i in range(0, n, 12))

    passage = prose("en", 70)
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = prose(lang, int(rng.integers(60, 160)))
        if i % 9 == 0:
            text += "\n" + passage
        if i % 4 != 2:
            text += "\n" + FOOTER
        if i % 11 == 3:
            text += "\nReleased under the MIT License, GNU  General public LICENSE"
        out.append((text, lang))
    words = out[5][0].split(" ")
    out += [out[5], out[5], (" ".join(["Changed", *words[1:]]), "en"), (None, "en"), ("", None), (" \n", "fr"), ("!! 12", None), ("tiny text", "en"), (" ".join(["a b c"] * 60), "en"), (prose("fr", 9000), "fr")]
    return out


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i if i != 7 else None, t, lang, (None, "x", "y", "z")[i % 4], None if t is None else len(t)) for i, (t, lang) in enumerate(_texts())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8))
    vectors[101:105] = vectors[100]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(450, None, 0), (500, [0.0] * 8, 0)], "vec_id long, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(0, "http://a.net/x", "")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, rows, vectors


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _crc(i, n):
    return i is not None and zlib.crc32(str(i).encode()) % n == 2


def _got(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf[0]).collect()
    assert len(rows) == len(sf[1])
    return {r["doc_id"]: r for r in rows}


def test_op1(spark, sf):
    got = _got(spark, sf, "op1_line_quality")
    want, _ = _quality(sf[1])
    assert {i: r["kept"] for i, r in got.items()} == {i: k for i, (k, _) in want.items()}


def _quality(rows, limits=LineLimits()):
    """By id: kept, and the text that is left."""
    normal = lambda line: " ".join(_words(line)).lower()
    holding, sizes = Counter(), Counter()
    for source, text in {(r[3], r[1]) for r in rows if r[1] is not None}:
        sizes[source] += 1
        holding.update({(source, normal(x)) for x in text.split("\n")})
    out = {}
    for i, text, _, source, _ in rows:
        lines = (text or "").split("\n")
        left = "\n".join(x for x in lines if not normal(x) or holding[source, normal(x)] <= max(limits.host_docs, limits.host_share * sizes[source]))
        words, n = _words(text), len(_words(left))
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        repeated = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
        bad = len(words) < 50 or 2 * len(repeated) > len(words)
        out[i] = (not bad and n >= 50 and 100 * n >= 30 * len(words), left)
    return out, None


def test_op2(spark, sf):
    got = _got(spark, sf, "op2_cross_parsing")
    for i, text, lang, _, _ in sf[1]:
        assert got[i]["held_out"] == _crc(i, 4) and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == ("und" if not any(c.isalpha() for c in text or "") else lang) or len(text) < 20 or "a b c" in text


def _fingerprint(text, shingle):
    words = _words(_low(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(items, linked):
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(items))]


def test_op3(spark, sf):
    got = _got(spark, sf, "op3_simhash")
    fps = [_fingerprint(r[1], 4) for r in sf[1]]
    classes = _classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for k, (row, fp) in enumerate(zip(sf[1], fps)):
        assert got[row[0]]["fingerprint"] == f"{fp:016x}"
        assert got[row[0]]["component_id"] == min((r[0] for r, c in zip(sf[1], classes) if c == classes[k] and r[0] is not None), default=None)


def _without(texts, length=200):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        yield bytes(c for c, g in zip(t, gone) if not g), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0


def test_op4(spark, sf):
    got = _got(spark, sf, "op4_suffix_index")
    removed = 0
    for row, (kept, n, spans) in zip(sf[1], _without([(r[1] or "").encode() for r in sf[1]])):
        r = got[row[0]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len((row[1] or "").encode()), n, spans, hashlib.sha256(kept).hexdigest())
        removed += n
    assert removed > 3000


def test_op5(spark, sf):
    got = _got(spark, sf, "op5_mixing")
    for r in sf[1]:
        assert got[r[0]]["size"] == len(_words(r[1])) and got[r[0]]["taken"] % max(got[r[0]]["size"], 1) == 0 <= got[r[0]]["taken"] <= 2 * got[r[0]]["size"]


def test_op6(spark, sf):
    assert [tuple(r) for r in queries.op6_url_rules(spark, sf[0]).select("page_id", "host", "path", "rule", "verdict").collect()] == [(0, "a.net", "/x", "net/", "block")]


def test_op7(spark, sf):
    got, hits = {}, 0
    for r in queries.op7_anisotropic(spark, sf[0]).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = sf[2] / np.linalg.norm(sf[2], axis=1, keepdims=True)
    assert sorted(got) == list(range(0, 400, 50))
    for q, own in got.items():
        own.sort()
        scores = unit @ unit[q]
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s - scores[v]) < 1e-12 and v != q for _, v, s in own)
        scores[q] = -2
        hits += len({v for _, v, _ in own} & set(np.lexsort((np.arange(400), -np.round(scores, 12)))[:5].tolist()))
    assert hits >= 0.9 * 40


def test_op8(spark, sf):
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op8_packing(spark, sf[0]).collect()
    want = {r[0]: [*ids.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in sf[1]}
    at, sequences = Counter(), {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        own = want[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {i: len(x) for i, x in want.items()}
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024


def test_op9(spark, sf):
    got = _got(spark, sf, "op9_license_scan")
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for row in sf[1]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(row[1]))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[row[0]]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted({label for _, label in places} | ({"mit-notice"} if "Released under" in (row[1] or "") else set())))


def test_op10(spark, sf):
    got = _got(spark, sf, "op10_logbilinear")
    tokens = lambda t: [*_words(_low(t)), ""]
    counts = Counter(w for r in sf[1] if not _crc(r[0], 7) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    for row in sf[1]:
        own, r = tokens(row[1]), got[row[0]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (_crc(row[0], 7), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


def test_pipeline_stages(spark, sf):
    """Each stage on what the one before kept, against brute force."""
    docs, stages = spark.read.parquet(f"{sf[0]}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "packing"]

    def after(name):
        out = stages[name](spark, docs, sf[0])
        assert out.columns == docs.columns
        return out.cache()

    one = after("quality rules")
    rows = [tuple(r) for r in one.collect()]
    want = {i: left for i, (kept, left) in _quality(sf[1])[0].items() if kept}
    assert {r[0]: r[1] for r in rows} == want and all(r[4] == len(r[1]) for r in rows) and 60 < len(rows) < len(sf[1])

    docs = one
    two = after("SimHash near-dedup")
    sets = [(set(simhash.shingle_hashes(r[1].encode(), 5).tolist()), _fingerprint(r[1], 5)) for r in rows]
    classes = _classes(sets, lambda a, b: len(a[0] & b[0]) >= 0.8 * len(a[0] | b[0]) or (a[1] ^ b[1]).bit_count() <= 4)
    ids = [r[0] for r in rows]
    first = {min((i for i, c in zip(ids, classes) if c == k and i is not None), default=None) for k in set(classes)}
    rows2 = [tuple(r) for r in two.collect()]
    assert Counter(r[0] for r in rows2) == Counter(first) and {r[0]: r for r in rows2} == {r[0]: r for r in rows if r[0] in first}

    docs = two
    three = after("suffix-array dedup")
    want = {r[0]: kept.decode("utf-8", "ignore") for r, (kept, _, _) in zip(rows2, _without([r[1].encode() for r in rows2]))}
    rows3 = [tuple(r) for r in three.collect()]
    assert {r[0]: (r[1], r[4]) for r in rows3} == {i: (t, len(t)) for i, t in want.items()} and sum(map(len, want.values())) < sum(len(r[1]) for r in rows2) - 1000

    docs = three
    four = after("mixing sources")
    plan = {r["doc_id"]: r["copies"] for r in queries.mixing.plan_mix(three).select("row.doc_id", "copies").collect()}
    rows4 = [tuple(r) for r in four.collect()]
    assert Counter(r[0] for r in rows4) == Counter({i: n for i, n in plan.items() if n}) and set(rows4) <= set(rows3)

    docs = four
    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, docs, sf[0]).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows4)
    whole = corpus_pipeline.run(spark, sf[0]).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    have = Counter()
    for r in packed:
        have[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["n"] for r in whole} == have
