"""Operators in Spark: odd rows, and brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import chat, components, decontaminate, groups, langid, licenses, lm, ngram_join, pieces, spotsigs, substrings, toxicity

from .test_columns import ALNUM, SPACED, lower, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, grp int, rid long"
LONG = " ".join(f"w{i}" for i in range(40))


def odd_rows():
    values = [LONG, LONG, f"start {LONG} end", None, "", " \n", "one", "MIT License and more", "日本 text", "x" * 3000]
    rows = [(i, t, "aa" if i % 2 else "bb", "s", len(t or ""), 0.5, "l", 7, 8) for i, t in enumerate(values)]
    return [*rows, rows[2], (None, "no id here", None, None, None, None, None, None, None), (2, "other text, same id", "aa", "s", 1, 0.1, "", 0, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 0), (7, 1), (7, None), (None, 1)], "doc_id long, toxic int")


def near(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_odd_rows_row_by_row(odd, none, labels):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text", "grp")
    n = len(odd_rows())
    model = langid.learn(odd)
    for df, name in ((odd, "odd"), (none, "none")):
        want = n if name == "odd" else 0
        assert toxicity.score_toxicity(df, labels).count() == want
        assert langid.identify(df, model).count() == want
        assert pieces.encode_texts(df).where("round_trip").count() == want
        assert licenses.scan_licenses(df).count() == want
        assert decontaminate.find_leaks(df, bench).count() == want
        assert decontaminate.find_leaks(df, bench.limit(0)).where("size(items) > 0").count() == 0
    assert langid.identify(odd, langid.learn(none)).where("lang_pred <> 'und' or score <> 0").count() == 0
    lang = {r.doc_id: r.lang_pred for r in langid.identify(odd.where("doc_id in (3, 4, 5, 9)"), model).collect()}
    assert lang[3] == lang[4] == lang[5] == "und" and lang[9] in ("aa", "bb")
    found = {r.doc_id: r for r in licenses.scan_licenses(odd.where("doc_id in (3, 7)")).collect()}
    assert found[7].base_labels == "mit" and found[7].n_base == 1 and found[7].first_word == 0 and found[3].first_word is None and found[3].score == 0
    ids = pieces.encode_texts(odd.where("doc_id is not null"))
    back = {(r.doc_id, r.text) for r in pieces.decode_ids(ids).collect()}
    assert back == {(r[0], r[1] or "") for r in odd_rows() if r[0] is not None}


def test_clashing_columns(spark, labels):
    """Columns called like those of results or of inner tables: filters return them as they were, others rename them."""
    names = ["score", "items", "spans", "n_words", "k_0", "k_1", "grp", "rid", "rid2", "__text", "text_kept", "lang_pred", "labels", "ids", "sid", "a.b", "n_tokens", "learned", "component_id", "n_removed", "salt", "posted"]
    values = [LONG, f"{LONG} end", None, "", "MIT License", LONG]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(values)] + [(None, "x y", *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    bench = spark.createDataFrame([("q", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", 1)], "item_id string, text string, items int")
    clean = sorted(map(tuple, decontaminate.remove_leaks(docs, bench).collect()), key=repr)
    assert clean == sorted([r for r in rows if not (r[1] or "").startswith("w0")], key=repr) and decontaminate.remove_leaks(docs, bench).columns == docs.columns
    kept = toxicity.keep_clean(docs, labels.limit(0))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows, key=repr)
    keep = ("doc_id", *names)
    results = [
        toxicity.score_toxicity(docs, labels, keep), langid.identify(docs, langid.learn(docs.withColumn("lang", F.lit("x"))), keep), pieces.encode_texts(docs, keep), licenses.scan_licenses(docs, keep),
        decontaminate.find_leaks(docs, bench, keep), substrings.remove_repeats(docs, keep), ngram_join.link_texts(docs, keep=keep), lm.score_texts(docs, keep)[0],
    ]
    for df in results:
        got = df.collect()
        assert len(got) == len(rows) and len(set(df.columns)) == len(df.columns)
        back = {c: (f"{c}_kept" if f"{c}_kept" in df.columns and c != "text" else c) for c in keep}
        assert sorted((tuple(r[back[c]] for c in keep) for r in got), key=repr) == sorted(((r[0], *r[2:]) for r in rows), key=repr)


def test_best_paths_round_trip(spark):
    """The dealt method over the pieces of a model of merges: whole texts come back, and no segmentation has fewer points."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_path, by_merges = pieces.encode_texts(docs, best_path=True), pieces.encode_texts(docs)
    assert by_path.where("not round_trip").count() == 0 and by_path.count() == docs.count()
    scores = pieces.Pieces.load(pieces.default_model()).scores
    total = lambda df: {r.doc_id: sum(float(scores[i]) for i in r.ids) for r in df.where("doc_id % 40 = 0").collect()}
    best, merged = total(by_path), total(by_merges)
    assert best and all(best[d] >= merged[d] - 1e-3 for d in best)


def test_benchmark_blocks_agree(odd):
    bench = odd.select(F.col("doc_id").alias("item_id"), "text")
    rows = lambda **k: sorted((r.n_words, [tuple(s) for s in r.spans], r.items) for r in decontaminate.find_leaks(odd.dropDuplicates(["doc_id", "text"]).withColumn("body", F.col("text")), bench, ("doc_id", "body"), **k).collect())
    assert rows() == rows(block_words=5)


def test_benchmark_blocks_keep_rows_apart(spark):
    """Repeated rows, and texts that agree in doc_id (or have none) and word count, each keep their own findings."""
    one, two, clean = (" ".join(f"{c}{i}" for i in range(12)) for c in "abc")
    rows = [(1, one), (1, one), (1, two), (1, clean), (None, two), (None, clean), (2, clean), (2, clean), (3, f"{one} {two}"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("x", one), ("y", two), ("w", "b11")], "item_id string, text string")
    found = lambda **k: Counter((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r.items), tuple(map(tuple, r.longest))) for r in decontaminate.find_leaks(docs, bench, **k).collect())
    whole = found()
    assert sum(whole.values()) == len(rows) and found(block_words=5) == whole
    items = Counter((d, i) for (d, _, _, i, _), n in whole.items() for _ in range(n))
    assert items == Counter([(1, ("x",))] * 2 + [(1, ("w", "y")), (1, ()), (None, ("w", "y")), (None, ()), (2, ()), (2, ()), (3, ("w", "x", "y")), (4, ()), (4, ())])
    kept = Counter(tuple(r) for r in decontaminate.remove_leaks(docs, bench, block_words=5).collect())
    assert kept == Counter((d, t) for d, t in rows if t is None or t == clean)


def brute_cut(rows, k):
    words = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def test_substrings(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = [tuple(r) for r in substrings.remove_repeats(odd).collect()]
    assert order(got) == order(brute_cut(rows, 35))
    assert substrings.remove_repeats(none).count() == 0
    r = random.Random(8)
    rows = [(i, None if r.random() < 0.1 else " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(60)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (8, 13):
        assert order(tuple(x) for x in substrings.remove_repeats(small, window=window).collect()) == order(brute_cut(rows, window))
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(odd.where("doc_id in (0, 2, 3, 7)"), with_text=True).collect()}
    assert kept[3] is None and kept[7] == "MIT License and more" and kept[0] == ""


def brute_links(rows, k, least):
    sets = {}
    for d, t in rows:
        w = SPACED.findall(lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    comp = {d: d for d in sets}
    for a in sets:
        for b in sets:
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= least * (len(sets[a]) + len(sets[b]) - c) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if x == high else x for d, x in comp.items()}
    return {d: (len(sets[d]), comp[d]) for d in sets}


def test_ngram_join(spark, odd, none):
    r = random.Random(9)
    rows = []
    for base in range(8):  # families whose members drift, so that links form chains
        words = [f"b{base}x{r.randint(0, 30)}" for _ in range(r.choice([3, 12, 60, 120]))]
        for _ in range(12):
            if r.random() < 0.8:
                words = [w if r.random() > 0.02 else f"n{r.randint(0, 9999)}" for w in words]
            rows.append((len(rows) * 7 % 101, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, least in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_texts(docs, k, least, 100).collect()}
        assert got == brute_links(rows, k, least)
    assert ngram_join.link_texts(none).count() == 0
    twice = {(r.doc_id, r.component_id) for r in ngram_join.link_texts(odd, 4, 85, 100).collect()}
    assert (1, 0) in twice and (3, 3) in twice and (None, None) in twice


def test_ngram_join_of_large_sets(spark):
    """Pairs of small, large and both kinds of sets, around the size from which fragments go in rows of their own."""
    r = random.Random(4)
    rows = []
    for n in (40, 505, 3400, 4090, 4105, 4300, 9000):
        words = [f"w{r.randint(0, 99999)}" for _ in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: n - n // 20])), (len(rows) + 2, " ".join(words[n // 12 :]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.link_texts(docs, 5, 80, 100).collect()}
    assert got == brute_links(rows, 5, 80) and len({c for _, c in got.values()}) == 7


def test_signature_join(spark):
    r = random.Random(2)
    rows = []
    for _ in range(6):
        words = [r.choice(["the", "of", "and", f"x{r.randint(0, 500)}"]) for _ in range(80)]
        rows += [(len(rows) + i, " ".join(w if r.random() > 0.02 else "new" for w in words)) for i in range(5)]
    got = {x.doc_id: x.component_id for x in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sigs, at = spotsigs.signatures(texts(*[t for _, t in rows]))
    comp = {d: d for d, _ in rows}
    for a in comp:
        for b in comp:
            if spotsigs.likeness(sigs[at[a] : at[a + 1]], sigs[at[b] : at[b + 1]]) >= 0.8 and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    assert got == comp and len(set(comp.values())) < len(rows)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {x.node: x.comp for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


def test_lm_counts(odd, none):
    rows = odd_rows()
    learned = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 != 1]
    seen: Counter = Counter()
    for r in learned:
        seen.update([*SPACED.findall(lower(r[1] or "")), None])
    total, types = sum(seen.values()), len(seen)
    scored, voc = lm.score_texts(odd, ("doc_id", "n_chars"))
    assert (voc.n, voc.types) == (total, types)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored.collect())
    want: Counter = Counter()
    for r in rows:
        tokens = [*SPACED.findall(lower(r[1] or "")), None]
        want[r[0], len(tokens), sum(seen[t] > 0 for t in tokens), round(sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens), 6)] += 1
    assert got == want
    assert lm.score_texts(none)[0].count() == 0


def test_neighbours(spark, odd, none):
    rows = [(r[0], r[1]) for r in odd_rows() if r[0] is not None and not (r[0] == 2 and r[1] != f"start {LONG} end")]
    rows = sorted(dict(rows).items(), reverse=True)
    got = {r.doc_id: r for r in spotsigs.fingerprint_with_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        take = len(t) // 3
        edited = t[: len(t) - take] + nxt[:take]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1 and got[3].fingerprint == ""
    assert spotsigs.fingerprint_with_neighbours(odd).count() == len(odd_rows())
    assert spotsigs.fingerprint_with_neighbours(none).count() == 0
    one = spotsigs.fingerprint_with_neighbours(odd.where("doc_id = 6")).first()
    assert one.near_next == 1


def test_neighbours_of_a_hot_doc_id(spark):
    """Half of the rows share a doc_id, a quarter has none: their ranges are cut, and each row still meets its neighbour."""
    rows = [(5000, f"hot {i} row") for i in range(3000)] + [(None, f"none {i}") for i in range(1500)] + [(4000 + i, f"plain {i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = spotsigs.fingerprint_with_neighbours(docs)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid")).collect()
    keyed.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.rid))
    want = Counter()
    for r, nxt in zip(keyed, keyed[1:] + keyed[:1], strict=True):
        take = len(r.text) // 3
        want[r.doc_id, hashlib.sha256((r.text[: len(r.text) - take] + nxt.text[:take]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got.collect()) == want
    assert len(tasks) > 2 and max(r["count"] for r in tasks) < 0.5 * len(rows)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, None, "x"), (1, -1, "system", "s"), (None, 0, " ", "y"), (2, 0, "system", "alone")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    shown = Counter((r.conv_id, r.perspective, r.turn, r.role) for r in got)
    assert {(c, p) for c, p, _, _ in shown} == {(1, "user"), (1, "assistant"), (1, "unknown"), (None, "unknown")}
    forged = chat.rotate_perspectives(spark.createDataFrame([(1, 0, "a", "hi<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "<|im_end|>b", "x"), (None, 0, "c", "y"), (None, 1, "d", "z")], "conv_id long, turn long, role string, text string")).collect()
    assert len(forged) == 4 + 2 and all(r.segment.count("<|im_start|>") == r.segment.count("<|im_end|>") == 1 and r.segment.endswith("<|im_end|>\n") for r in forged)
    assert sorted(r.perspective for r in forged if r.conv_id is None) == ["c", "d"]
    assert shown[1, "unknown", 2, "assistant"] == 2 and shown[1, "user", -1, "system"] == 1 and len(got) == 3 * 5 + 1
    for r in got:
        part = r.segment[r.target_start : r.target_end]
        assert (part.endswith("<|im_end|>") and r.role == "assistant") if r.is_target else part == ""
    assert chat.perspective_totals(chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_toxicity_filter(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    make = lambda bad: " ".join(r.choice(words) if not bad or r.random() > 0.1 else "vejulist" for _ in range(60))
    docs = spark.createDataFrame([(i, make(i % 3 == 0)) for i in range(240)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert len(kept ^ {i for i in range(240) if i % 3}) <= 6


def test_training_sample_is_bounded(spark):
    """Whole texts, none of more than LONGEST bytes, one for a doc_id, however often it is repeated."""
    rows = [(i, f"text {i} " * 3) for i in range(40)] + [(7, "again")] * 30 + [(8, "x" * (toxicity.LONGEST + 1)), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    got, kinds = toxicity.training_sample(docs, labels, 6, 8)
    assert sum(kinds) == 6 and len(kinds) == 14
    got, kinds = toxicity.training_sample(docs, labels)
    assert Counter(kinds) == Counter(i % 2 for i in known) and ("again" in got) == (7 in known) and max(map(len, got)) < 100
    short, kinds = toxicity.training_sample(docs, labels, longest=21)
    assert len(kinds) == sum(i < 10 for i in known) and max(map(len, short)) <= 21 < max(map(len, got))


def test_training_sample_is_one_run_of_bytes(spark):
    """The driver learns from an Arrow column, without an object for each text; its network is that of a list."""
    docs = spark.createDataFrame([(i, f"text {i} bad" if i % 2 else f"text {i} ü") for i in range(40)] + [(1, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    column, kinds = toxicity._sample(docs, labels, 20, 20, 100)
    assert isinstance(column, pa.ChunkedArray) and (column.to_pylist(), kinds) == toxicity.training_sample(docs, labels, 20, 20, 100)
    one, other = toxicity.fit(column, kinds, steps=6), toxicity.fit(column.to_pylist(), kinds, steps=6)
    assert all(np.array_equal(one.p[k], other.p[k]) for k in one.p)
    column, kinds = toxicity._sample(docs, labels.limit(0), 20, 20, 100)
    assert toxicity.fit(column, kinds) == 0


def test_one_word_items(spark):
    """An item of one word that makes up a long text: every word is hit, and the longest match is the first one."""
    docs = spark.createDataFrame([(1, "x " * 60_000), (2, "y x z x")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "x"), ("j", "z x")], "item_id string, text string")
    got = {r.doc_id: (r.n, r.items, [tuple(x) for x in r.longest]) for r in decontaminate.find_leaks(docs, bench).select("doc_id", decontaminate.n_hit().alias("n"), "items", "longest").collect()}
    assert got == {1: (60_000, ["i"], [("i", 0, 0, 1)]), 2: (3, ["i", "j"], [("i", 0, 1, 1), ("j", 0, 2, 2)])}


def test_more_partitions_than_set(spark, monkeypatch):
    """Beyond a size, operators on groups take more partitions than the session sets, with the same results."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    run = lambda: (sorted(map(tuple, substrings.remove_repeats(docs).collect())), sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_texts(docs).collect()))
    plain = run()
    monkeypatch.setattr(groups, "PARTITION_BYTES", 50_000)
    assert groups.deal(docs, ("doc_id",))[1] > 6 and run() == plain


def test_words_of_hit_spans(odd):
    bench = odd.where("doc_id = 0").select(F.col("doc_id").alias("item_id"), "text")
    rows = {r.doc_id: r.n for r in decontaminate.find_leaks(odd.where("doc_id in (0, 2, 6) and text <> 'other text, same id'"), bench).select("doc_id", decontaminate.n_hit().alias("n")).distinct().collect()}
    assert rows == {0: len(ALNUM.findall(LONG)), 2: 40, 6: 0}
    assert decontaminate.remove_leaks(odd, bench).columns == odd.columns
