"""Each stage on a small input."""

import random

import corpus_pipeline as cp


def test_stages(spark, tmp_path):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    good, bad = [prose(90) for _ in range(60)], [" ".join(w.upper() + "!!" for w in prose(90).split()) for _ in range(60)]
    near = good[0].rsplit(" ", 1)[0] + " changed"
    texts = [t for pair in zip(good, bad, strict=True) for t in pair] + [near, "mail me@home.org " + prose(80), None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, (k + 1) % 2) for k in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = cp.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect() if x.doc_id < 120} == set(range(0, 120, 2))
    one = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert {x.doc_id for x in one.collect()} == set(range(123)) - {120}
    hidden = {x.doc_id: x for x in cp.mask_personal_data(spark, docs, str(tmp_path)).collect()}
    assert hidden[121].text.startswith("mail <EMAIL> ")
    assert hidden[121].n_chars == len(hidden[121].text)
    assert hidden[0].text == texts[0]
    assert cp.drop_repeated_lines(spark, docs, str(tmp_path)).columns == docs.columns
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} <= {*range(0, 120, 2), 121, 122}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    for stage in (cp.drop_repeated_lines, cp.drop_near_duplicates, cp.mask_personal_data, cp.pack_windows):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_hard_rows(spark, tmp_path):
    prose = " ".join(f"w{k}" for k in range(40))
    rows = [(1, prose, "a"), (1, prose, "a"), (1, "other text of the same id", "b"), (2, prose + " z", "c"), (None, prose, "d"), (None, None, "e"), (3, None, "f"), (4, "", "g")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, _score double")
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in kept.collect()) == [("1", "a"), ("1", "b"), ("3", "f"), ("4", "g"), ("None", "d"), ("None", "e")]
    spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    judged = cp.keep_quality(spark, docs, str(tmp_path))
    assert judged.columns == docs.columns
    assert {r._score for r in judged.collect()} <= {0.5}
    assert cp.keep_quality(spark, docs.limit(0), str(tmp_path)).count() == 0
