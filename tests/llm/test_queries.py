"""The registered queries on a small folder of tables: their columns, and their rows against plain versions."""

import hashlib
import random
import zlib

import pytest

from heliotrace.llm import queries, url_filter
from tests.llm.test_corpus_operators import classes, contamination, judge, lm_reference

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(12)) for i in range(6)]
    texts = [prose(rng.randint(0, 60)) for _ in range(40)]
    texts += [texts[3], texts[5] + " tail", prose(20) + " " + items[1][1] + " " + items[2][1], "a " * 900, "", None, "Straße  ÉÉ", "strasse éé"]
    ids = rng.sample(range(1_000), len(texts))
    return list(zip(ids, texts, strict=True)), items


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    docs, items = corpus
    path = str(tmp_path_factory.mktemp("sf"))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")
    save("documents", [(i, t, "en", "s", len(t or ""), 1) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    save("benchmark", items, "item_id bigint, text string")
    save("labels", [(i, 0, int(k % 5 == 0)) for k, (i, _) in enumerate(docs)], "doc_id bigint, quality int, toxic int")
    save("pages", [(k, u, "") for k, u in enumerate(["http://www.example.com/en/x", "http://a.net/es/", "http://b.org/", None, "x"])], "page_id bigint, url string, html string")
    save("conversations", [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "other")], "conv_id bigint, turn int, role string, text string")
    return path


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder)


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


def test_sentencepiece(spark, folder, corpus):
    rows = by_id(run(spark, folder, "op1_sentencepiece"))
    assert len(rows) == len(corpus[0]) and all(r.round_trip for r in rows.values())


def test_toxicity(spark, folder, corpus):
    rows = by_id(run(spark, folder, "op2_toxicity"))
    assert set(rows) == {i for i, _ in corpus[0]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())


def test_urls(spark, folder):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run(spark, folder, "op3_url_filters").collect()} == {k: judge(u, url_filter.RULES) for k, u in pages.items()}


def test_fingerprints(spark, folder, corpus):
    rows, order = by_id(run(spark, folder, "op4_fingerprints")), sorted((i, t or "") for i, t in corpus[0])
    by_text = {}
    for (i, text), (j, following) in zip(order, order[1:] + order[:1], strict=True):
        r, k = rows[i], len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == float(r.fingerprint == rows[j].fingerprint) and r.near_edited == float(r.fingerprint == r.edited_fingerprint)
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
    assert by_text["Straße  ÉÉ"] == by_text["strasse éé"] and len(set(by_text.values())) == len(by_text) - 1


def test_pii(spark, folder, corpus):
    assert {i: r.text for i, r in by_id(run(spark, folder, "op5_pii")).items()} == dict(corpus[0])


def test_decontamination(spark, folder, corpus):
    docs, items = corpus
    rows = by_id(run(spark, folder, "op6_decontamination"))
    for (i, _), (n_words, n_hit, found) in zip(docs, contamination([t for _, t in docs], items), strict=True):
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n_words, n_hit, len(found), len(found) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert any(r.contaminated for r in rows.values())


def test_token_counts(spark, folder, corpus):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = by_id(run(spark, folder, "op7_token_counts"))
    for i, text in corpus[0]:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((text or "").encode()), n, n > 1024)


def test_lm_scores(spark, folder, corpus):
    rows = by_id(run(spark, folder, "op8_lm_scoring"))
    for (i, _), (held, n, known, total, base, _) in zip(corpus[0], lm_reference(corpus[0], 3, {2: (1.0, 0.7), 3: (1.0, 0.7)}), strict=True):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and r.base_score == pytest.approx(base) and r.score < 0


def test_chats(spark, folder):
    assert {r.conv_id for r in run(spark, folder, "op9_chat_formatting").collect()} == {2, 3}


def test_jaccard(spark, folder, corpus):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, folder, "op10_jaccard_join").collect()) == sorted(classes(corpus[0]))
