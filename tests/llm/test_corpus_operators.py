"""URL filters, decontamination, LM scoring, chat formatting and the Jaccard join against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heliotrace.llm import chat_format, common, decontamination, jaccard_join, lm_scoring, url_filter


def test_payloads_and_word_hashes():
    arrays = [np.arange(5, dtype=np.uint64), np.array([], np.int32), np.array([-1.5, 2.0]), np.array([7], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True))
    rng, seen = random.Random(1), {}
    for _ in range(300):
        texts = ["".join(rng.choice("abAB \n\t\x0b\x1cé日") for _ in range(rng.randint(0, 12))) if rng.random() > 0.1 else None for _ in range(rng.randint(0, 6))]
        hashes, counts = common.word_hashes(texts)
        words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        for word, h in zip(itertools.chain(*words), hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


# URL filters ------------------------------------------------------------------------------------


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?q#f", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://example.com", "http://example.com/", "http://notexample.com/en/", "x://a.net/es/1", "x://a.net/fr", "x://net/fr/", "http://a.org/es/", "http://com?x=/en/", "http://u@b.example.com:80/en/", "http://" + "a." * 2000 + "net/es/", "http://é.com/EN/"] * 2
    df = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = url_filter.filter_urls(df, "page_id", "url", rules).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in rows) == sorted((str(i if i else None), *judge(u, url_filter.RULES)) for i, u in enumerate(urls))
    none = url_filter.filter_urls(df.limit(0), "page_id", "url", rules)
    assert none.count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, "page_id", "url", rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    listed, universe = [f"l{i}" for i in range(300)], [f"u{i}" for i in range(5_000)]
    as_table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = url_filter.build_cascade(as_table(listed), as_table(universe + universe[:100] + listed))
    assert len(cascade.levels) >= 2
    hashed = as_table(listed + universe).select("key", *[h.alias(n) for h, n in zip(url_filter._hashes(url_filter.F.col("key")), ("a", "b"), strict=True)]).toPandas()
    got = cascade.listed(hashed["a"].to_numpy(), hashed["b"].to_numpy())
    assert dict(zip(hashed["key"], got.tolist(), strict=True)) == {k: k.startswith("l") for k in listed + universe}


def test_long_lists_are_dealt_into_shards(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FILTER_BYTES", 40)
    monkeypatch.setattr(url_filter, "PASS_SHARDS", 2)
    rng = random.Random(12)
    hosts = [f"h{i}.org" for i in range(60)]
    rules = [(h, f"/{rng.choice('ab')}", rng.choice(["allow", "block"])) for h in rng.sample(hosts, 30)] + [("org", "/", "block"), ("h1.org", "/a", "allow"), ("h1.org", "/a", "block")]
    assert url_filter.shards_of(len(rules)) > 2
    df = spark.createDataFrame([(i, f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice('abc')}x") for i in range(300)] + [(300, None)], "page_id bigint, url string")
    rows = url_filter.filter_urls(df, "page_id", "url", spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    urls = {r.page_id: r.url for r in df.collect()}
    by_verdict = sorted(set(rules), key=lambda r: r[2])  # listed both ways blocks: judge() takes the last of equals
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id < 300) == sorted((i, *judge(u, by_verdict)) for i, u in urls.items() if i < 300)


# decontamination --------------------------------------------------------------------------------


def contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        own = words(text)
        for i in range(max(1, len(own) - 7) if own else 0):
            windows.setdefault(tuple(own[i : i + 8]), set()).add(str(item))
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for w, owners in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= owners
        out.append((len(own), len(hit), sorted(found)))
    return out


def test_contamination(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 100)
    rng = random.Random(2)
    draw = lambda n: " ".join(rng.choice(["a", "b", "C", "dé", "7"]) for _ in range(n))
    items = [(i, draw(rng.choice([3, 8, 9, 14]))) for i in range(25)] + [(100, None), (101, "!"), (102, "a"), (3, "zz yy")]
    texts = [draw(rng.randint(0, 120)) for _ in range(60)] + [None, "", "zz, YY. zz", "x " * 5_000 + items[0][1]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    bench = spark.createDataFrame([*items, (None, "a b")], "item_id bigint, text string")
    rows = sorted(decontamination.contamination(df, bench).collect())
    assert [(r.n_words, r.n_hit, r.items) for r in rows] == contamination(texts, items)
    assert decontamination.contamination(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.contamination(df, bench.limit(0)).collect()} == {0}
    kept = decontamination.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, c in enumerate(contamination(texts, items)) if not c[2]}


def test_segments_and_proximity(spark):
    texts = ["a b c x y a", "c b a q q q q a", "b c"]
    index = decontamination.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), segment_words=1_000).read().collect()
    (row,) = index
    s = decontamination.Segment(bytes(row.terms), bytes(row.postings))
    number = lambda t: s.numbers([w.encode() for w in t.split()])
    assert s.phrase(number("b c")).tolist() == [1, 14] and s.phrase(number("a")).tolist() == [0, 5, 8, 13]
    assert s.phrase(number("a c")).tolist() == []  # a document's end parts words
    assert s.doc_of(s.near(number("a b c"), 3)).tolist() == [0, 1]
    small = decontamination.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), segment_words=5).read()
    assert small.count() == 3 or small.count() == 2


def test_near_items(spark, monkeypatch):
    rng = random.Random(13)
    draw = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    texts = [(i, draw(rng.randint(0, 40))) for i in range(60)] + [(None, "a b c d"), (60, None)]
    items = [(i, draw(rng.randint(1, 6))) for i in range(12)] + [(20, "zz a"), (21, ""), (22, None), (None, "a")]
    span = 5
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = decontamination.near_items(df, spark.createDataFrame(items, "item_id bigint, text string"), span).collect()

    def near(text, item):
        own, want = (text or "").split(), set((item or "").split())
        return bool(want) and len(want) <= span and any(want <= set(own[i : i + span]) for i in range(len(own)))

    want = [(str(d), sorted(str(i) for i, item in items if i is not None and near(t, item))) for d, t in texts]
    assert sorted((str(r.doc_id), r["items"]) for r in rows) == sorted(want)


def test_contaminated_rows_go_by_id_and_text(spark):
    item = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, f"x {item} y"), (None, "clean"), (1, item), (1, "clean too"), (2, None)], "doc_id bigint, text string")
    kept = decontamination.drop_contaminated(df, spark.createDataFrame([(0, item)], "item_id bigint, text string"))
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "clean too"), ("2", "None"), ("None", "clean")]


# LM scoring -------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 10), (1, 1), (50, 60), (500, 1 << 44), (300, 1 << 20)):
        values = np.sort(rng.choice(min(universe, 1 << 45), n, replace=universe < n)).astype(np.uint64) if n else np.array([], np.uint64)
        low, high, bits = lm_scoring.EliasFano.parts(values, universe)
        ef = lm_scoring.EliasFano(low, high, n, bits)
        assert (ef.get(np.arange(n)) == values).all()
        probes = np.concatenate([values, rng.integers(0, universe, 200).astype(np.uint64)])
        at = ef.find(probes, np.zeros(probes.size, np.int64), np.full(probes.size, n))
        known = set(values.tolist())
        assert all((k >= 0) == (v in known) and (k < 0 or values[k] == v) for v, k in zip(probes.tolist(), at.tolist(), strict=True))
        assert (ef.find(values, np.arange(n) + 1, np.full(n, n))[values != np.append(values[1:], np.uint64(1 << 50))] == -1).all() if n else True


def test_elias_fano_selects_in_all_groups():
    rng = np.random.default_rng(5)
    for n, universe in ((0, 1), (3, 1 << 20), (5000, 6000), (5000, 1 << 40), (200, 200_000)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        low, high, bits = lm_scoring.EliasFano.parts(values, universe)
        ef, plain = lm_scoring.EliasFano(low, high, n, bits), np.unpackbits(high)
        for one in (True, False):
            places = np.flatnonzero(plain == one)
            k = rng.permutation(places.size)
            assert (ef._select(k, one) == places[k]).all()


def test_a_contexts_range_is_looked_up_once(monkeypatch):
    rng = np.random.default_rng(6)
    contexts, rank = np.sort(rng.integers(0, 1 << 60, 20).astype(np.uint64)), np.repeat(np.arange(20), 50)
    code = np.concatenate([np.sort(rng.choice(1 << 30, 50, replace=False)) for _ in range(20)]).astype(np.uint64)
    log_p = -rng.random(1000)
    trie = lm_scoring.Trie(lm_scoring.Trie.packed(contexts, np.zeros(20), rank, code, log_p, 32))
    asked = []
    monkeypatch.setattr(trie.pointers, "_select", lambda k, one, select=trie.pointers._select: asked.append(k.size) or select(k, one))
    got = trie.log10(contexts[rank], code, np.zeros(1000))
    assert np.abs(got - log_p).max() < 0.05 and sum(asked) == 2 * 20
    mixed = rng.permutation(1000)
    assert (trie.log10(contexts[rank[mixed]], code[mixed], np.zeros(1000)) == got[mixed]).all()


def lm_reference(texts, order, fits):
    words = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").encode().lower().decode()) + ["\0"] for _, t in texts]
    held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts]
    grams, starts = Counter(), 0
    for own, h in zip(words, held, strict=True):
        if h is False:
            marked = ["\1", *own]
            grams.update((w,) for w in own)
            for k in (2, 3):
                grams.update(tuple(marked[i : i + k]) for i in range(len(marked) - k + 1))
            starts += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    grams["\1",] = starts

    def p(gram):
        if len(gram) == 1:
            return (grams[gram] + 0.5) / (n + 0.5 * (v + 1))
        c, (a, b) = grams[gram[:-1]], fits[len(gram)]
        m = a * c**b if c else 1.0
        return (grams[gram] + m * p(gram[1:])) / (c + m)

    out = []
    for own, h in zip(words, held, strict=True):
        marked = ["\1", *own]
        score = sum(math.log10(p(tuple(marked[max(0, i + 1 - order) : i + 1]))) for i in range(1, len(marked)))
        out.append((h, len(own), sum(grams[w,] > 0 for w in own), n, sum(math.log10(p((w,))) for w in own), score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores(spark, monkeypatch, order):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(80, None), (81, ""), (None, "a b c"), (5, "a b"), (82, "new words only"), (83, "ab " * 3_000)]
    texts += [(90 + i, texts[i][1]) for i in range(20)]  # copies, so that trigrams occur again
    df = spark.createDataFrame([(i, t, 2) for i, t in texts], "doc_id bigint, text string, score int")
    fits = {}
    monkeypatch.setattr(lm_scoring, "_answers", lambda x, n, v, starts, a, b, run=lm_scoring._answers: fits.update({2: (a, b)}) or run(x, n, v, starts, a, b))
    monkeypatch.setattr(lm_scoring, "_score_shards", lambda x, n, v, a, b, run=lm_scoring._score_shards: fits.update({3: (a, b)}) or run(x, n, v, a, b))
    rows = lm_scoring.lm_scores(df.repartition(3), order=order).collect()
    want = lm_reference(texts, order, fits)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    got = sorted(((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4])
        assert g[5] == pytest.approx(w[5], rel=0.02, abs=0.2)  # quantised probabilities
    assert lm_scoring.lm_scores(df.limit(0)).count() == 0
    assert {r.n_known for r in lm_scoring.lm_scores(df.where("doc_id is null")).collect()} == {0}
    with pytest.raises(ValueError):
        lm_scoring.lm_scores(df, order=4)


# chats ------------------------------------------------------------------------------------------


def test_snapshots_collapse(spark):
    rng, talks = random.Random(5), {}
    for c in range(60):
        talks[c] = [(rng.choice(["user", "assistant"]), rng.choice("xyz")) for _ in range(rng.randint(1, 4))]
    rows = [(c, t, r, x, 0) for c, own in talks.items() for t, (r, x) in enumerate(own)] + [(None, 0, "user", "x", 0)] * 2 + [(None, 1, None, None, 0), (70, 0, None, None, 0), (71, 5, "user", "", 0), (71, 5, "user", "", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, position int")
    whole = {**{c: tuple(own) for c, own in talks.items()}, 70: (("user", ""),), 71: (("user", ""), ("user", ""))}
    kept = {c for c, own in whole.items() if not any((len(o) > len(own) and o[: len(own)] == own) or (o == own and d < c) for d, o in whole.items() if d != c)}
    out = chat_format.format_chats(df).collect()
    assert {r.conv_id for r in out} == kept | {None}
    alone = ["<|im_start|>user\n<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n"]
    assert sorted(r.text for r in out if r.conv_id is None) == alone and {r.n_turns for r in out if r.conv_id is None} == {1}
    one = next(r for r in out if r.conv_id == 71)
    assert one.text == "<|im_start|>user\n<|im_end|>\n" * 2 and one.n_turns == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


# Jaccard join -----------------------------------------------------------------------------------


def classes(texts):
    sets = []
    for _, t in texts:
        own = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(texts)]


def corpus(rng, n_groups=12, copies=14):
    """Near copies with a few edits, some at the edge of the threshold, and a passage that many share."""
    word = lambda: "w" + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    texts = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 6, 24, 60, 150]))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += passage
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(rng.randint(1, 6))] + passage) for _ in range(40)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    # small limits: all repeated tokens combined, keys split by set, many blocks and units
    limits = jaccard_join.Limits(block_shingles=500, combine=1, split=4, cluster_block=7, star=3) if seed == 2 else jaccard_join.Limits()
    rng = random.Random(seed)
    own = corpus(rng) + ["", None, "  ", "A b", "a B", "one two three four", "x " * 4_000]
    ids = rng.sample(range(10_000), len(own))
    texts = list(zip(ids, own, strict=True))
    df = spark.createDataFrame([(i, t, 3) for i, t in texts], "doc_id bigint, text string, n int")
    rows = jaccard_join.jaccard_classes(df.repartition(3), limits=limits).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(classes(texts))


def test_parts_of_a_key_meet_at_every_size(spark):
    """Sets of sizes 100 and 150 and none between share all frequent tokens, so 150 is never the first of a split key's part."""
    rng = random.Random(9)
    ring = [f"w{i}" for i in range(150)] * 3
    own = [" ".join(ring[i : i + 104]) for i in range(0, 150, 2)]
    for k in range(6):
        words = ring[:154]
        words[rng.randrange(10, 140)] = f"x{k}"
        own.append(" ".join(words))
    texts = list(enumerate(own))
    rows = jaccard_join.jaccard_classes(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), limits=jaccard_join.Limits(split=16)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(classes(texts))


def test_large_sets_of_a_hot_key_keep_their_links(spark):
    """Eight long sets link with each other among 8,520 short ones of the same passage, at the limits of production."""
    ring = [f"w{i}" for i in range(150)]
    long = []
    for k in range(8):
        words = ring + [f"t{j}" for j in range(4)]
        words[140 - k] = f"x{k}"  # five shingles of 150 differ
        long.append(" ".join(words))
    short = [" ".join([*ring[:100], f"s{i}", f"u{i}", f"v{i}"]) for i in range(0, 8_520)]
    texts = [(i, t) for i, t in enumerate(short + long)]
    rows = jaccard_join.jaccard_classes(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert {found[i] for i in range(8_520, 8_528)} == {8_520} and {found[i] for i in range(8_520)} == {0}


def test_parts_are_joined_wherever_sets_may_link():
    """All comparable members of a key are connected by its parts' stars and the chain of their runs."""
    rng = np.random.default_rng(10)
    for _ in range(400):
        n, parts = int(rng.integers(2, 30)), int(rng.integers(2, 5))
        sizes, part = np.sort(rng.integers(10, rng.choice([30, 60, 300]), n)), rng.integers(0, parts, n)
        edges, runs = [], []
        for p in range(parts):
            own = np.flatnonzero(part == p)
            if own.size:
                edges += [(int(own[x]), int(own[y])) for x, y in jaccard_join._stars(own, sizes[own])]
                runs += [(int(sizes[own[x]]), int(own[x]), int(sizes[own[y]])) for x, y in jaccard_join._runs(sizes[own])]
        label = list(range(n))
        for x, y in edges + jaccard_join._chain(runs):
            label = [label[x] if c == label[y] else c for c in label]
        assert all(label[x] == label[y] for x, y in itertools.combinations(range(n), 2) if 75 * sizes[y] <= 100 * sizes[x])


def test_jaccard_edges(spark):
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (None, "q"), (0, "a b c d e f"), (7, near), (7, "other text of six words here"), (None, near + " x"), (None, near + " y"), (8, near + " z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    rows = jaccard_join.jaccard_classes(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in rows if r.n_shingles == 2 and r.component_id != 7) == [("0", 2, 0), ("1", 2, 0), ("1", 2, 0), ("None", 2, 0)]
    assert {(r.doc_id, r.component_id) for r in rows if r.n_shingles > 10} == {(7, 7), (8, 7), (None, 7)}
    assert [(r.component_id, r.n_shingles) for r in rows if r.doc_id == 7] in ([(7, 36), (7, 2)], [(7, 2), (7, 36)])
    assert jaccard_join.jaccard_classes(df.limit(0)).count() == 0
    kept = jaccard_join.one_of_each_class(df)  # rows without an id stay only in classes without one
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("0", "a b c d e f"), ("None", "q"), ("None", "q"), ("7", near), ("7", "other text of six words here")])


def test_text_hash(spark):
    texts = [None, "", "a", "Zażółć gęślą jaźń", "x" * 100, "日本語" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", "xxhash64(text) AS h").collect()
    assert {r.i: r.h for r in rows} == {i: common.text_hash(t) for i, t in enumerate(texts)}


def test_prefix_keys_meet():
    """Every linked pair shares a key, whatever the tokens' frequencies."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(2, 200))
        universe = np.unique(rng.integers(0, 1 << 62, 3 * n).astype(np.uint64))
        level = dict(zip(universe.tolist(), rng.choice([0, 1, 3, 6, 8], universe.size, p=rng.dirichlet([1] * 5)).tolist(), strict=True))
        x = np.sort(rng.choice(universe, n, replace=False))
        drop = int(rng.integers(0, max(1, n // 5)))
        y = np.unique(np.concatenate([rng.permutation(x)[: n - drop], rng.choice(universe, int(rng.integers(0, max(1, n // 6))), replace=False)]))
        both = np.intersect1d(x, y).size
        if 100 * both < 75 * (x.size + y.size - both) or np.array_equal(x, y):
            continue
        keys = [set(jaccard_join.prefix_keys(s, np.array([level[t] for t in s.tolist()], np.uint8))[0].tolist()) for s in (x, y)]
        assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert all(got.get(i, i) == find(i) for e in edges for i in e)


def test_item_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
