"""Many notices in one document, against every start of every template."""

import itertools

import numpy as np

from tidewell.llm import license_scan
from tidewell.llm.license_scan import TEMPLATES, words_of

#: How many of 10,000 documents hold a word: plain words are frequent, the others as rare as they are long.
COMMON = dict.fromkeys(b"the of and to or in is for any this under a with that are use".split(), 6000)


def _index():
    index = license_scan.Index(TEMPLATES, license_scan.PHRASES)
    return index.weigh({w: COMMON.get(w, 400 // len(w)) for w in index.vocabulary}, 10_000)


def _brute(index, words):
    """Labels of the templates that hold at some start, looked for at all of them."""
    found = set()
    for (label, template, _), keys in zip(index.templates, index.keys):
        total = sum(index.idf[w] for w in template)
        for start in range(-len(template), len(words)):
            near = all(any(i >= 0 and words[i : i + len(k)] == k for i in range(start + q - 3, start + q + 4)) for k, q in keys)
            held = sum(index.idf[w] for q, w in enumerate(template) if any(0 <= i < len(words) and words[i] == w for i in range(start + q - 3, start + q + 4)))
            if near and held >= 0.3 * total - 1e-9:
                found.add(label)
    return found


def test_every_notice_of_a_document_is_found():
    index = _index()
    for chosen in [*itertools.combinations(TEMPLATES, 3), TEMPLATES]:
        spans = index.spans(words_of("\n".join(t.text for t in chosen).encode()))
        assert {s["label"] for s in spans if not s["base"]} >= {t.label for t in chosen}
        assert max(s["score"] for s in spans) == 1


def test_rarer_words_hide_no_notice():
    index = _index()
    filler = sorted(index.vocabulary, key=lambda w: -index.idf[w])
    words = words_of(b" ".join(filler[::-1] * 3) + b" Released under the MIT License " + b" ".join(filler))
    assert "mit-notice" in {s["label"] for s in index.spans(words)}


def test_against_all_starts():
    index, rng = _index(), np.random.default_rng(6)
    for _ in range(150):
        words = []
        for t in rng.choice(len(TEMPLATES), rng.integers(1, 6)):
            notice = words_of(TEMPLATES[t].text.encode())
            words += [w for w in notice if rng.random() > 0.06]
            words += rng.choice(sorted(index.vocabulary), rng.integers(0, 20)).tolist()
        assert {s["label"] for s in index.spans(words) if not s["base"]} == _brute(index, words)


def test_a_key_phrase_alone_is_no_notice():
    index = _index()
    for text in (b"We will ship this and any later version soon", b"all of it in compliance with the license"):
        assert [s["label"] for s in index.spans(words_of(text)) if not s["base"]] == []


def test_rarity_decides():
    """The same half of a notice holds where its words are rare and its other words are common, and not the other way round."""
    one = (license_scan.Template("one", "alpha beta gamma delta the of and to", ("alpha beta",)),)
    half, rest = "alpha beta gamma delta".split(), "the of and to".split()
    for common, want in ((rest, ["one"]), (half, [])):
        index = license_scan.Index(one, (), share=0.6).weigh({w.encode(): 9000 if w in common else 1 for w in half + rest}, 10_000)
        assert [s["label"] for s in index.spans(words_of(b"x alpha beta gamma delta x y"))] == want
        # Without the key phrase nothing holds; far from their places words don't vote.
        assert index.spans(words_of(b"beta alpha gamma delta the of and to")) == []
        assert index.spans(words_of(b"alpha beta x x x x x x x x gamma x x x x x x x delta")) == []


def test_votes_miss_no_start():
    """Random weights: the postings of rare words lead to every start that holds."""
    rng = np.random.default_rng(9)
    for _ in range(60):
        index = license_scan.Index(TEMPLATES, license_scan.PHRASES)
        index.weigh({w: int(10 ** rng.uniform(0, 4)) for w in index.vocabulary}, 10_000)
        words = []
        for t in rng.choice(len(TEMPLATES), 3):
            notice = words_of(TEMPLATES[t].text.encode())
            words += [w for w in notice if rng.random() > rng.choice([0.0, 0.2, 0.5])] + rng.choice(sorted(index.vocabulary), 5).tolist()
        assert {s["label"] for s in index.spans(words) if not s["base"]} == _brute(index, words)
