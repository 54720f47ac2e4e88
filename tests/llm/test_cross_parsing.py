"""References of languages that consist of copies, and of large alphabets."""

import re

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import cross_parsing


def test_copies_leave_a_language_its_reference(spark):
    """Six languages of 3,000 copies of three texts: every different text is in the sample."""
    row = spark.range(18_000).select((F.col("id") % 6).alias("k"), (F.floor(F.col("id") / 6) % 3).alias("t"))
    word = F.concat(F.element_at(F.array(*map(F.lit, ("kal", "mor", "vis", "tun", "ped", "zog"))), (F.col("k") + 1).cast("int")), F.lit("a "))
    docs = row.select(F.concat(F.lit("l"), "k").alias("lang"), F.concat(F.repeat(word, 5), F.element_at(F.array(*map(F.lit, "xyw")), (F.col("t") + 1).cast("int"))).alias("text"))
    parser = cross_parsing.fit(docs)
    assert parser.languages == [f"l{k}" for k in range(6)]
    got = cross_parsing.identify(docs.distinct(), parser, ["lang"]).collect()
    assert len(got) == 18 and all(r["lang_pred"] == r["lang"] for r in got)
    # All three texts of 26 characters, with a space between them.
    assert all(round(2**b) == 80 for b in parser.bits)


def test_large_alphabets_get_their_language(spark):
    """Beside two Latin languages, two of 400 letters each, of which half are common to both."""
    rng = np.random.default_rng(2)
    words = {
        "de": ["der", "und", "haus", "wasser", "schiff", "regen"],
        "en": ["the", "and", "house", "water", "ship", "rain"],
        "ko": ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 400, 3))) for _ in range(600)],
        "zh": ["".join(map(chr, rng.integers(0x4E00 + 200, 0x4E00 + 600, 3))) for _ in range(600)],
    }
    rows = [(i, k, " ".join(rng.choice(w, 60))) for k, w in words.items() for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = cross_parsing.identify(docs.where("doc_id >= 40"), cross_parsing.fit(docs.where("doc_id < 40")), ["lang"]).collect()
    assert len(got) == 80 and all(r["lang_pred"] == r["lang"] and r["score"] > 0 for r in got)


def _squeeze(text):
    return re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).lstrip()


def _phrases(ref, text):
    """By the strings themselves."""
    n, now = bool(text), ""
    for c in text:
        now += c
        if now not in ref:
            n, now = n + 1, c if c in ref else ""
    return n


def test_letters_beyond_the_table_parse_alike():
    rng, signs = np.random.default_rng(9), list("abcdefgh \u4e00\u4e01\uac00")
    refs = {k: "".join(rng.choice(signs[i:], 120)) for i, k in enumerate("abc")}
    texts = ["".join(rng.choice([*signs, "z"], rng.integers(1, 60))) for _ in range(200)]
    want = [[_phrases(_squeeze(refs[k]), _squeeze(t)) for k in "abc"] for t in texts]
    for alphabet, few in ((60, 24), (2, 24), (2, 500)):
        parser = cross_parsing.Parser(refs, alphabet, few=few)
        assert parser.phrases([parser.symbols(t) for t in texts]).tolist() == want


def test_predictions_against_brute_force(spark):
    """Four languages with words in common, texts of a word to some thousands, by the costs of plain string searches."""
    rng, common = np.random.default_rng(6), ["in", "es", "la", "on", "1", "?!"]
    words = {k: common + ["".join(rng.choice(list("aeiounrstlk" + x), rng.integers(2, 8))) for _ in range(40)] for k, x in zip("abcd", "ãbcd")}
    rows = [(i, k, " ".join(rng.choice(words[k], rng.integers(1, 90) if i % 40 else 3000))) for i, k in enumerate(rng.choice(list("abcd"), 240))]
    docs = spark.createDataFrame([*rows, (900, "a", None), (901, None, "12 !")], "doc_id long, lang string, text string").repartition(3)
    sample = cross_parsing.Sample(reference=2000, long_text=400)
    parser = cross_parsing.fit(docs.where("doc_id % 4 <> 1"), sample=sample)
    # References are whole texts by hash, the long ones last.
    hashes = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 1073741824) h").collect()}
    refs = {}
    for k in "abcd":
        own = sorted({(len(t) > 400, hashes[i], t) for i, lang, t in rows if lang == k and i % 4 != 1})
        refs[k] = _squeeze(" ".join(t for _, _, t in own)[:2000])
    costs = {t: [_phrases(refs[k], _squeeze(t)) * np.log2(len(refs[k])) / max(len(_squeeze(t)), 1) for k in "abcd"] for _, _, t in rows}
    got = cross_parsing.identify(docs, parser, ["doc_id", "text"]).collect()
    assert len(got) == 242
    right = 0
    for r in got:
        if not _squeeze(r["text"] or "").strip():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cost = costs[r["text"]]
        first, second = sorted(cost)[:2]
        assert r["lang_pred"] == "abcd"[int(np.argmin(cost))] and abs(r["score"] - (second - first) / second) < 1e-9
        right += r["lang_pred"] == rows[r["doc_id"]][1]
    assert right > 0.9 * len(rows)


def test_noisy_labels_stop_nothing(spark):
    """More labels than are learned: those of the most different texts are, and the table stays within its bytes."""
    words = {lang: [f"{lang}{a}{b}" for a in "aeiou" for b in "rstln"] for lang in ("xa", "yb", "zc")}
    rng = np.random.default_rng(3)
    rows = [(" ".join(rng.choice(words[lang], 30)), lang) for lang in words for _ in range(20)] + [(f"noise {i}", f"label{i}") for i in range(300)] + [("xa copies", "copied")] * 200
    docs = spark.createDataFrame(rows, "text string, lang string")
    sample = cross_parsing.Sample(max_languages=3, table_bytes=1 << 18)
    parser = cross_parsing.fit(docs, sample=sample)
    assert parser.languages == ["xa", "yb", "zc"] and parser.table.nbytes <= 1 << 18
    got = cross_parsing.identify(docs.where("lang in ('xa', 'yb', 'zc')"), parser, ["lang"]).collect()
    assert len(got) == 60 and all(r["lang"] == r["lang_pred"] for r in got)
    every = cross_parsing.fit(docs)
    assert len(every.languages) == 200
