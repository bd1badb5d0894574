"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_planted_cases(spark, tmp_path):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 7))) for _ in range(3000)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, item = make(60), make(30)
    docs: dict[int, list[str]] = {i: make(120) for i in range(150)}
    labels = [(i, 0) for i in range(150)]
    for i in range(150, 210):  # toxic
        docs[i] = [w if r.random() > 0.12 else "vejulist" for w in make(100)]
        labels.append((i, 1))
    docs[300], docs[301] = docs[0].copy(), [*docs[1][:60], "changed", *docs[1][61:]]  # copies
    for i in (310, 311):  # a passage that repeats
        docs[i] = make(50) + passage + make(50)
    docs[320] = make(40) + item[5:20] + make(40)  # a leak
    docs[330] = []
    rows = [(i, "\n".join([" ".join(w[:70]), " ".join(w[70:])]) if w else None, "aa", 3) for i, w in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, rid string, n_chars long").coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {300, 301, 320} & out.keys() and {0, 1, 310, 311, 330} <= out.keys()
    toxic = set(range(150, 210))
    assert len(toxic & out.keys()) <= 2 and len(set(range(150)) - out.keys()) <= 3
    assert all(" ".join(passage[20:30]) not in out[i].text.replace("\n", " ") and out[i].n_chars == len(out[i].text) for i in (310, 311))
    before = {x[0]: x[1] for x in rows}
    assert all(out[i].text == before[i] for i in range(150) if i in out) and out[330].ids == []
    assert out[0].__fields__ == ["doc_id", "text", "rid", "n_chars", "ids", "n_tokens"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows and clashing columns."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a", "s"), (1, text, "a", "s"), (None, text, "b", "t"), (None, None, "c", "u"), (None, None, "c", "u"), (2, "", "d", "v"), (3, "short text", "e", "w"), (3, "other short text", "e", "w")]
    schema = "doc_id long, text string, score string, items string"
    for name, docs in (("some", rows), ("none", [])):
        spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    got = sorted((repr(r.doc_id), repr(r.text), r.score, r.items) for r in out.collect())
    # Of the three equal texts the one with the smallest id stays; rows without words are all kept.
    assert got == sorted((repr(d), repr(t), a, b) for d, t, a, b in [rows[0], *rows[3:]])
    assert out.columns == ["doc_id", "text", "score", "items", "ids", "n_tokens"]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
