"""Parts that need no Spark, against plain versions."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stackloom.llm import decontaminate, langid, licenses, lm, ngram_join, pieces, repeats, spotsigs, substrings, toxicity
from stackloom.llm.columnar import WORD_BY_ALNUM, WORD_BY_SPACE, Texts, Words, slices

SPACED, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def texts(*values):
    return Texts(pa.array(values, pa.string()))


ODD = ["Hello wOrld é", None, "", " \t\n", "a b", "hello  World a b\n", "x" * 5000, "日本 語 x", "A-b_c 1.2"]


@pytest.mark.parametrize(("mask", "pattern"), [(WORD_BY_SPACE, SPACED), (WORD_BY_ALNUM, ALNUM)])
def test_words(mask, pattern):
    t = texts(*ODD)
    w = Words(t, mask, True)
    found = [[t.bytes[a:b].tobytes().decode() for a, b in zip(w.starts[w.at[i] : w.at[i + 1]], w.ends[w.at[i] : w.at[i + 1]], strict=True)] for i in range(len(t))]
    assert [[lower(x) for x in ws] for ws in found] == [pattern.findall(lower(v or "")) for v in ODD]
    flat, h = [lower(x) for ws in found for x in ws], w.hashes()
    assert len(set(flat)) == len(set(h.tolist())) and all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))
    assert t.n_chars().tolist() == [len(v or "") for v in ODD]
    starts, own = w.windows(h, 2)
    doc = w.doc
    assert starts.tolist() == [i for i in range(len(h) - 1) if doc[i] == doc[i + 1]]
    assert len(set(own.tolist())) == len({(flat[i], flat[i + 1]) for i in starts})


def test_slices_keep_every_row():
    batch = pa.record_batch({"text": pa.array(ODD, pa.string()), "i": list(range(len(ODD)))})
    parts = list(slices([batch], most=10))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(ODD))) and len(parts) > 3


def test_difference_covers():
    for period, cover in substrings.COVERS:
        assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


def test_repeats_within_a_group():
    table = repeats.probes(3, 4, np.array([7, 7, 9], np.uint64), np.zeros(3, np.uint32), np.array([0, 5, 6]))
    found = [p for b in repeats._report(table.sort_by("bucket").to_batches()) for x in b.column("at").to_pylist() for p in repeats.places(x).tolist()]
    assert found == [0, 5]


def test_shingles_and_threshold():
    t = texts("a b c d e a b c d", "x", None, "a B", "a b c d")
    w = Words(t, WORD_BY_SPACE, True)
    doc, _ = ngram_join.shingles(w, 4)
    assert np.bincount(doc, minlength=5).tolist() == [5, 1, 0, 1, 1]
    th = ngram_join.Threshold(85, 100)
    for n in range(1, 40):
        for m in range(1, 40):
            for shared in range(min(n, m) + 1):
                linked = 100 * shared >= 85 * (n + m - shared)
                assert bool(th.linked(shared, n, m)) == linked
                assert not linked or (shared >= th.overlap(np.array(n), np.array(m)) and shared > n - th.prefix(np.array(n)))


def test_blocks_of_posting_lists(monkeypatch):
    """Crossing blocks finds what comparing all of a posting list finds, in lists below and above the block size."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    r, t = np.random.default_rng(3), ngram_join.Threshold(80, 100)
    lists = [np.stack((r.permutation(500)[:m], r.integers(20, 60, m), r.integers(0, 9, m), r.integers(0, 4, m)), 1).astype(np.int64) for m in (1, 5, 16, 17, 90)]
    h = np.repeat(np.arange(len(lists)).astype(np.uint64), [len(x) for x in lists])
    got = set()
    for x, y, whole in ngram_join._blocks(h, np.concatenate(lists), t):
        assert whole == (len(x) == len(y) and bool((x == y).all()) and len(x) in (5, 16)) or not whole
        got |= {tuple(p) for p in ngram_join._cross(x, y, t).tolist()}
    want = {(max(a[0], b[0]), min(a[0], b[0])) for own in lists for a in own.tolist() for b in own.tolist() if a[3] != b[3] and t.possible(np.int64(a[1]), a[2], b[1], b[2])}
    assert got == {(int(a), int(b)) for a, b in want}


def test_bands_of_set_lengths():
    for least, of in ((80, 100), (85, 100), (50, 100)):
        t = ngram_join.Threshold(least, of)
        cuts = t.bands(400)
        for n in range(1, 400):
            for m in range(n, 400):
                if of * n >= least * m:
                    assert np.searchsorted(cuts, m, "right") - np.searchsorted(cuts, n, "right") in (0, 1)


def test_suffix_search_against_windows():
    r = random.Random(1)
    for _ in range(150):
        v = ["a", "B", "cé", "d,", "e"][: r.randint(1, 5)]
        make = lambda n: " ".join(r.choice(v) for _ in range(n))  # noqa: B023, E731
        docs = [None if r.random() < 0.05 else make(r.randint(0, 40)) for _ in range(r.randint(0, 8))]
        items = [(str(i), None if r.random() < 0.1 else make(r.randint(0, 9))) for i in range(r.randint(0, 4))]
        k = r.randint(1, 5)
        test = decontaminate.TestSuffixes.of([(i, Words(texts(t), WORD_BY_ALNUM, True).hashes()) for i, t in items], k)
        wins: dict = {}
        for i, t in items:
            w = ALNUM.findall(lower(t or ""))
            m = min(k, len(w))
            for a in range(len(w) - m + 1 if w else 0):
                wins.setdefault(tuple(w[a : a + m]), set()).add(i)
        want = []
        for t in docs:
            w, hit, its = ALNUM.findall(lower(t or "")), set(), set()
            for m in {len(x) for x in wins}:
                for a in range(len(w) - m + 1):
                    if (x := tuple(w[a : a + m])) in wins:
                        hit.update(range(a, a + m))
                        its |= wins[x]
            want.append((len(w), len(hit), sorted(its)))
        got = []
        for part in slices([pa.record_batch({"text": pa.array(docs, pa.string())})]):
            n, spans, its, longest = (x.to_pylist() for x in decontaminate._digest(part, test))
            got += [(a, sum(s["last"] - s["first"] + 1 for s in b), c) for a, b, c in zip(n, spans, its, strict=True)]
            assert all(x["n_words"] >= 1 for row in longest for x in row)
        assert got == want


def test_viterbi_against_all_paths():
    r = random.Random(2)
    for _ in range(60):
        names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(8)})
        scores = np.array([-r.random() * 9 for _ in names], np.float32)
        voc = pieces.Pieces.of(names, list(range(len(names))), scores, np.full(256, -1, np.int32), [n.encode() for n in names], True, 0)
        word = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
        chars = np.array([ord(c) for c in word], np.uint32)
        table = pieces.substring_table(voc, chars, np.arange(len(word), 0, -1))
        ((_, cuts),) = pieces.viterbi(table, voc.scores, np.array([0]), len(word), -50.0)
        score = dict(zip(names, scores.tolist(), strict=True))
        value = lambda cs: sum(score.get(word[a:b], -50.0 if b - a == 1 else -1e9) for a, b in zip(cs, cs[1:], strict=False))  # noqa: B023, E731
        best = [0.0] + [-1e9] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max(best[s] + value((s, end)) for s in range(end))
        assert value(cuts[0].tolist()) == pytest.approx(best[-1], abs=1e-4)


def test_pieces_against_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pieces.default_model()
    voc, model = pieces.Pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(0)
    values = ["", None, " ", "  a  b ", "\n\n", "▁x", "héllo \x00 😀 日本語", "a" * 700 + " " + "ab" * 300, "<0x0A> <s> </s>", "x y\t\tz", "日" * 300]
    values += ["".join(r.choice("ab c▁é\n😀th e.") for _ in range(r.randint(0, 30))) for _ in range(200)]
    ids, at = pieces.encode(voc, texts(*values))
    data, ends = pieces.decode(voc, ids, at)
    for i, v in enumerate(values):
        assert ids[at[i] : at[i + 1]].tolist() == model.encode(v or "")
        assert data[ends[i] : ends[i + 1]].tobytes().decode() == (v or "").replace("▁", " ")


def test_class_table_is_normalised():
    r = np.random.default_rng(0)
    counts = np.zeros(lm._CELLS, np.int64)
    counts[r.integers(0, lm._CELLS, 5000)] = r.integers(1, 50, 5000)
    table = lm.train(counts, steps=60)
    assert np.allclose((10.0 ** table.reshape(-1, lm.CLASSES).astype(np.float64)).sum(1), 1, atol=1e-4)
    assert np.isfinite(lm.train(np.zeros(lm._CELLS, np.int64))).all()


def test_member_table_is_normalised():
    """Within each suffix class and context, the words with vectors and the rest make up one; contexts are told apart."""
    r = np.random.default_rng(2)
    kinds = np.concatenate((r.integers(0, lm.SUFFIXES, 300), np.arange(lm.SUFFIXES)))
    counts = r.integers(0, 9, (lm.CONTEXTS, len(kinds)))
    counts[5, 7], counts[6, 7] = 900, 0
    table = lm.train_members(counts, kinds)
    total = np.zeros((lm.CONTEXTS, lm.SUFFIXES))
    np.add.at(total.T, kinds, (10.0 ** table.astype(np.float64)).T)
    assert np.allclose(total, 1, atol=1e-4) and table[5, 7] > table[6, 7] + 0.3
    assert np.isfinite(lm.train_members(np.zeros_like(counts), kinds)).all()


def test_class_table_weighs_every_counted_token():
    """A hundred of a billion tokens, moved from one context to another, are learned from."""
    r = np.random.default_rng(1)
    counts = np.zeros((lm.CONTEXTS**2, lm.CLASSES), np.int64)
    counts[np.repeat(np.arange(50), 20), r.integers(0, lm.CLASSES, 1000)] = 1_000_000
    moved = counts.copy()
    counts[10, 5], counts[11, 5], moved[10, 5], moved[11, 5] = 100, 1, 1, 100
    a, b = (lm.train(c.ravel(), steps=60).reshape(-1, lm.CLASSES) for c in (counts, moved))
    assert b[11, 5] - b[10, 5] > a[11, 5] - a[10, 5]


def test_signatures():
    t = texts("the red fox of the north", "THE red fox of the north", "", None, "!!!", "red fox")
    sigs, at = spotsigs.signatures(t)
    own = [sigs[at[i] : at[i + 1]] for i in range(len(t))]
    assert own[0].tolist() == own[1].tolist() and len(own[2]) == len(own[3]) == 0 and len(own[4]) == 1 and len(own[5])
    assert spotsigs.read(spotsigs.written(own[0])).tolist() == own[0].tolist()
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5], np.uint32)
    assert spotsigs.likeness(a, b) == 2 / 5 and spotsigs.likeness(a, a) == 1 and spotsigs.likeness(a, a[:0]) == 0 and spotsigs.likeness(a[:0], a[:0]) == 1
    assert spotsigs.likeness(a[:1], b, least=0.5) == 0


def test_signatures_without_common_words():
    """Texts of other languages and lists are known by all their words, not by the first two."""
    words = [f"w{i}" for i in range(60)]
    edited, other = ["first", *words[1:]], [*words[:2], *(f"x{i}" for i in range(58))]
    mixed = ["the", "red", "fox", *words, "of", "north"]
    t = texts(*(" ".join(w) for w in (words, edited, other, words[:40], mixed, [*mixed[:30], "new", *mixed[31:]], words[:7])))
    sigs, at = spotsigs.signatures(t)
    own = [sigs[at[i] : at[i + 1]] for i in range(len(t))]
    assert len(own[0]) >= 60 and spotsigs.likeness(own[0], own[1]) > 0.9 and spotsigs.likeness(own[0], own[2]) < 0.1
    assert 0.55 < spotsigs.likeness(own[0], own[3]) < 0.7 and 0.85 < spotsigs.likeness(own[4], own[5]) < 1
    alone = [spotsigs.signatures(t.rows(i, i + 1))[0] for i in range(len(t))]
    assert all(a.tolist() == b.tolist() for a, b in zip(own, alone, strict=True))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("GNU General Public License v3", {"gpl-3.0"}),
        ("GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
        ("SPDX-License-Identifier: MIT OR BSD-3-Clause", {"mit", "bsd-3-clause"}),
        ("see creativecommons.org/licenses/by-sa/4.0", {"cc-by-sa"}),
        ("All rights reserved", {"proprietary"}),
        ("nothing here", set()),
    ],
)
def test_license_rules(text, labels):
    assert {d.label for d in licenses.scan(text.lower().encode())} == labels
    assert len(licenses.rules()) > 500


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("GNU General\nPublic License, version 3", {"gpl-3.0"}),
        ("GNU Free\n  Documentation-Licence", {"gfdl"}),
        ("Permission is hereby\ngranted, free of charge, to any person obtaining a copy", {"mit"}),
        ("Redistribution\nand use in source and binary forms", {"bsd"}),
        ("Licence: MIT", {"mit"}),
        ("under GPL-2.0+", {"gpl"}),
        ("LGPL 3", {"lgpl"}),
        ("AGPL-3.0", {"agpl-3.0"}),
        ("Creative-Commons Attribution", {"cc-by"}),
        ("# GNU Lesser\n# General Public License, version 2.1", {"lgpl-2.1"}),
        (" * Mozilla Public\n * License 2.0", {"mpl-2.0"}),
        ("// Unless required by applicable\n// law or agreed to in writing, software", {"apache-2.0"}),
        ("may not use\n    this file; you may not use\n    this file except in compliance with the License", {"apache-2.0"}),
    ],
)
def test_license_rules_on_wrapped_and_british_forms(text, labels):
    assert {d.label for d in licenses.scan(text.lower().encode())} == labels


def example(items, r, space):
    """A random string that a parsed pattern matches, its white space and hyphens given by `space`."""
    out = ""
    for op, arg in items:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            chosen, what = r.choice(arg)
            spaced = any(str(k) == "CATEGORY" and "SPACE" in str(v) for k, v in arg)
            out += space if spaced else chr(what) if str(chosen) == "LITERAL" else chr(what[0]) if str(chosen) == "RANGE" else "a"
        elif kind == "MAX_REPEAT":
            out += "".join(example(arg[2], r, space) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 1))))
        elif kind == "SUBPATTERN":
            out += example(arg[-1], r, space)
        elif kind == "BRANCH":
            out += example(r.choice(arg[1]), r, space)
    return out


def test_license_keywords_follow_from_the_patterns():
    """Every rule finds the same with the keyword filter as without, on all forms that its pattern allows."""
    r, tried = random.Random(7), 0
    for rule in licenses.rules():
        for space in (" ", "\n", "-", "\n\t ") * 2:
            text = example(re._parser.parse(rule.pattern.pattern), r, space).encode()
            tried += rule.pattern.search(text) is not None
            assert licenses.scan(text) == licenses.scan(text, filtered=False), (rule.label, text)
    assert tried > 3000


def test_license_suppression():
    d = licenses.Detection
    kept = licenses.settle([d("a", 0, 10, 50, 1), d("b", 2, 8, 90, 1), d("c", 3, 5, 40, 1), d("a", 0, 10, 50, 1)])
    assert [(x.label, x.start) for x in kept] == [("a", 0), ("b", 2)]
    r = random.Random(5)
    for _ in range(300):
        found = [d(r.choice("xyz"), a := r.randint(0, 30), a + r.randint(1, 12), r.randint(1, 4), 1) for _ in range(r.randint(0, 25))]
        want = []
        for x in sorted(set(found), key=lambda x: (-x.priority, x.start - x.end, x.start, x.label)):
            if not any(k.start <= x.start and x.end <= k.end for k in want):
                want.append(x)
        assert licenses.settle(found) == sorted(want, key=lambda x: (x.start, x.end, x.label))


def test_anchors_of_many_texts():
    """One walk over all texts finds in each what a search of it alone finds, and nothing across texts."""
    r = random.Random(4)
    words = list(licenses.anchored())
    rows = ["".join(r.choice([*map(bytes.decode, r.sample(words, 4)), "x", " ", "é", "li"]) for _ in range(r.randint(0, 9))) for _ in range(300)] + ["spdx-license-", "identifier:"]
    t = texts(*rows)
    found = licenses.anchor_texts(t.bytes.tobytes(), t.offsets)
    assert [found.get(i, set()) for i in range(len(rows))] == [{k for k in words if k in row.encode()} for row in rows]


def test_many_license_notices():
    """A long text of notices takes time in proportion."""
    text = ("mit license\nall rights reserved\n" * 50_000).encode()
    assert len(licenses.scan(text)) == 100_000


def test_base_phrases_by_brute_force():
    r = random.Random(8)
    vocabulary = ["GNU", "general", "Public", "license", "apache", "cc", "BY", "mit", "licence", "x", "é", "by4"]
    rows = [None, "", "mit license", "MIT-License", "mit licensé"]
    rows += ["".join(r.choice(vocabulary) + r.choice([" ", "-", "\n * ", ", "]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    batch = pa.record_batch({"text": pa.array(rows, pa.string())})
    got = [x for b in licenses._scan_batches([batch]) for x in b.to_pylist()]
    assert len(got) == len(rows)
    for t, x in zip(rows, got, strict=True):
        w = ALNUM.findall(lower(t or ""))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None)), t
        assert x["base_labels"] == ",".join(sorted({b for _, b in at})) and {b for _, b in at} <= set(x["labels"].split(",")) | {""}
        assert 0 <= x["score"] <= 1 and (x["score"] == 1 or not at) and x["labels"] == ",".join(sorted({b for _, b in at} | {d["label"] for d in x["detections"]}))


def test_language_mixture():
    voc = {"xx": ["alpha", "beta", "gamma"], "yy": ["rokit", "zufim", "wolta"]}
    r = random.Random(4)
    make = lambda lang, n: " ".join(r.choice(voc[lang]) for _ in range(n))
    names = sorted(voc)
    table = np.full((1 << langid.BITS, 2), langid.SMOOTHING)
    for i, lang in enumerate(names):
        grams, _ = langid.trigrams(Words(texts(make(lang, 300)), langid.WORD_BY_LETTER))
        table[:, i] += np.bincount(grams, minlength=1 << langid.BITS)
    model = langid.Languages(names, np.log(table / table.sum(0)).astype(np.float32))
    docs = [make("xx", 40), make("yy", 40), make("xx", 30) + " " + make("yy", 10), "123", None]
    own, share = langid.mixtures(model, Words(texts(*docs), langid.WORD_BY_LETTER))
    assert own.tolist() == [0, 1, 2]
    assert share[0].tolist() == [1, 0] and share[1].tolist() == [0, 1] and share[2] == pytest.approx([0.75, 0.25], abs=0.03)


def test_language_sets_by_brute_force():
    """Six languages in one text are all found; the chosen set is as likely, less its penalty, as any other set."""
    r = random.Random(11)
    voc = {f"l{i}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(8)] for i in range(7)}
    make = lambda lang, n: " ".join(r.choice(voc[lang]) for _ in range(n))
    table = np.full((1 << langid.BITS, len(voc)), langid.SMOOTHING)
    for i, lang in enumerate(voc):
        grams, _ = langid.trigrams(Words(texts(make(lang, 300)), langid.WORD_BY_LETTER))
        table[:, i] += np.bincount(grams, minlength=1 << langid.BITS)
    model = langid.Languages(list(voc), np.log(table / table.sum(0)).astype(np.float32))
    parts = [["l3"], ["l0", "l5"], ["l1", "l2", "l6"], ["l0", "l1", "l2", "l3", "l4", "l5"], list(voc)]
    docs = [" ".join(make(lang, 40) for lang in own) for own in parts]
    w = Words(texts(*docs), langid.WORD_BY_LETTER)
    own, share = langid.mixtures(model, w)
    assert [[f"l{j}" for j in np.flatnonzero(row)] for row in share] == parts
    grams, at = langid.trigrams(w)
    score = np.add.reduceat(model.log_p[grams], at[:-1], axis=0)
    likely = np.maximum(np.exp(score - score.max(1, keepdims=True)), 1e-9)
    for i, row in enumerate(share[:4]):
        x = likely[w.at[i] : w.at[i + 1]].astype(float)

        def value(chosen, rounds=200):
            p = np.full(len(chosen), 1 / len(chosen))
            for _ in range(rounds):
                q = p * x[:, chosen]  # noqa: B023
                p = (q / q.sum(1, keepdims=True)).mean(0)
            return np.log((x[:, chosen] * p).sum(1)).sum() - langid.PENALTY * (len(chosen) - 1) * np.log(len(x) + 1)  # noqa: B023

        best = max(value(list(c)) for size in range(1, 8) for c in itertools.combinations(range(7), size))
        assert value(np.flatnonzero(row).tolist()) == pytest.approx(best, abs=1e-6)


def test_network_gradients():
    r, net = np.random.default_rng(0), toxicity.Network(1)
    inputs = toxicity.Inputs(texts("hello big wörld x", "bad idiot you are no", "", "q"))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, first, size = inputs.windows()
    y = np.array([0, 1, 0, 1.0])

    def loss():
        x, mask, _ = net.window_inputs(inputs, first, size)
        p = toxicity._sigmoid(net.logits(x.astype(np.float64), mask))
        return -np.sum(np.log(np.where(y > 0.5, p, 1 - p)))

    cache: dict = {}
    x, mask, _ = net.window_inputs(inputs, first, size)
    g, _ = net.gradients(cache, toxicity._sigmoid(net.logits(x, mask, cache)) - y)
    for k in g:
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        old, d = net.p[k][at], 1e-3
        net.p[k][at] = old + d
        up = loss()
        net.p[k][at] = old - d
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2 / d, abs=3e-3)


def test_network_against_loops():
    """The batched forward pass, word by word and state by state."""
    net = toxicity.Network(3)
    t = texts("Some words here, and bad ones too", "x", "", " ".join(f"w{i}" for i in range(50)))
    inputs = toxicity.Inputs(t)
    text, first, size = inputs.windows()
    assert text.tolist() == [0, 1, 2, 3, 3, 3] and size.tolist() == [7, 1, 0, 32, 32, 18] and (first[3:] - first[3]).tolist() == [0, 16, 32]
    got = net.score_windows(inputs, first, size)
    sig = lambda v: 1 / (1 + np.exp(-v))
    d, h, p = toxicity.DIM, toxicity.HIDDEN, {k: v.astype(float) for k, v in net.p.items()}
    for row, (a, n) in enumerate(zip(first, size, strict=True)):
        x = [np.concatenate((p["word"][inputs.word[i]], p["gram"][inputs.gram[inputs.gram_at[i] : inputs.gram_at[i + 1]]].mean(0))) for i in range(a, a + n)]
        states = []
        for way in "fb":
            s, out = np.zeros(h), []
            for v in x if way == "f" else x[::-1]:
                px, hu = v @ p[f"x{way}"] + p[f"c{way}"], s @ p[f"u{way}"]
                z, r = sig(px[:h] + hu[:h]), sig(px[h : 2 * h] + hu[h : 2 * h])
                new = np.tanh(px[2 * h :] + r * hu[2 * h :])
                s = (1 - z) * new + z * s
                out.append(s)
            states.append(out if way == "f" else out[::-1])
        both = [np.concatenate(v) for v in zip(*states, strict=True)]
        e = np.array([np.tanh(v @ p["wa"] + p["ba"]) @ p["va"] for v in both])
        w = np.exp(e - e.max(initial=0)) if n else e
        pooled = sum((v * k for v, k in zip(both, w / w.sum(), strict=True)), np.zeros(2 * h)) if n else np.zeros(2 * h)
        assert got[row] == pytest.approx(float(pooled @ p["wo"] + p["bo"][0]), abs=1e-5) and len(x) == n and d


def test_toxicity_learns_words():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    make = lambda bad: " ".join(r.choice(words) if not bad or r.random() > 0.1 else "vejul" + r.choice(["a", "ist", "on"]) for _ in range(60))
    rows = [(make(i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    net = toxicity.fit([t for t, _ in rows], [y for _, y in rows], steps=150)
    new = [(make(i % 2), i % 2) for i in range(60)]
    score = toxicity.score_texts(net, texts(*[t for t, _ in new], None, ""))
    assert np.mean((score[:60] >= 0.5) == np.array([y for _, y in new])) > 0.95 and ((0 <= score) & (score <= 1)).all()
    assert toxicity.fit([], []) == 0 and toxicity.fit(["a"], [1]) == 1
    assert toxicity.threshold(np.array([0.0, 1, 5, 6]), np.array([0, 0, 1, 1])) == pytest.approx(1 + 4 * toxicity.MARGIN)


def test_inputs_of_many_texts_stay_small():
    """Pieces give the same as the whole; what the driver holds for the network is at most ten bytes a byte of text."""
    odd = texts("", "A b", None, "x" * 50, "日本 Text, a-b", " ", "one two three four", "")
    whole, cut = toxicity.Inputs(odd), toxicity.Inputs.of_many(odd, most=4)
    assert all(np.array_equal(getattr(whole, k), getattr(cut, k)) for k in ("at", "word", "gram", "gram_at"))
    r = np.random.default_rng(5)
    some = texts(*[" ".join(f"w{x}" for x in r.integers(0, 10**6, 500)) for _ in range(2400)])
    tracemalloc.start()
    try:
        toxicity.Inputs.of_many(some)
        assert tracemalloc.get_traced_memory()[1] < 10 * len(some.bytes)
    finally:
        tracemalloc.stop()
