"""The pipeline's stages on a small corpus, against what each must keep."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(20)
    texts, labels = {}, []
    for i in range(300):
        own = prose(60).split()
        if i % 6 == 0:
            for _ in range(8):
                own.insert(rng.randrange(len(own)), "zzvil" + word())
        texts[i] = " ".join(own)
        labels.append((i, int(i % 6 == 0)))
    texts[301] = texts[1] + " tail"
    texts[302] = prose(30) + " " + item + " " + prose(30)
    texts[303] = "reach bob7@mail.example.com " + prose(30)
    texts[304] = None
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i in range(300) if i % 6}
    assert len(kept[0] & set(range(0, 300, 6))) <= 3 and clean | {301, 302, 303, 304} <= kept[0]
    assert kept[1] == kept[0] - {301} and kept[2] == kept[1] - {302} and kept[3] == kept[4] == kept[2]
    after = {r.doc_id: r for r in spark.read.parquet(f"{sf}/3").collect()}
    assert "bob7@" not in after[303].text and re.search(r"[a-z]{3}\d@[a-z]{4}\.example\.com", after[303].text) and after[303].n_chars == len(after[303].text)
    assert all(after[i].text == texts[i] for i in clean) and after[304].text is None
