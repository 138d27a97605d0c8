"""The training-data operators against brute force on small fixtures, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from terrafringe.llm import compact_windows, language_id, ngram_join, packing, quality, sentencepiece_bpe, sharding, suffix_dedup, suffix_sort, url_filter, vector_join
from terrafringe.llm.components import components

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta,", "gamma.", "delta", "épsilon", "zeta!!", "eta\n"]) + str(rng.randrange(300)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 40, 120, 200, 300, 90, 150)]
    words = base[4].split(" ")
    near = " ".join(words[:20] + ["changed"] + words[21:])
    passage = prose(rng, 70)
    return [None, "", " \n", "one two", "one two", *base, base[2], base[3], near, near.upper(), prose(rng, 30) + " " + passage + " " + prose(rng, 40), passage + " " + prose(rng, 60), "ab" * 400, "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else ("en", "de")[i % 2], "s", 0, 0) for i, t in enumerate(texts)]
    rows.append(rows[8])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_sentencepiece(spark, docs, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(docs, PIECES, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert found[i].ids == ids and found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_sentencepiece_odd_texts():
    import sentencepiece

    lib, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_bpe.Codec(PIECES), random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("aaab  \n\t▁ é中😀the<s></s>�\x00ın  ER") for _ in range(rng.randrange(25)))
        ids = lib.encode(t)
        assert codec.encode([t])[0].tolist() == ids
        full = np.array([1, *ids, 2])
        assert codec.decode(full).decode() == lib.decode(full.tolist())


def test_word_ids():
    from terrafringe.llm.word_bpe import tokenizer

    own, rng = tokenizer(WORDS), random.Random(2)
    parts = ["a", "S", "the", "'s", " ", "\n", "é", "É", "é", "J̌", ".", ",", "!!", "23", "Σ", "中", "<|endoftext|>", "\x1c", "ß", "µ", "_", "thint"]
    for _ in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert own([t])[0].tolist() == own.lib.encode(t, add_special_tokens=False).ids


def test_fullest_against_all_subsets():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 80)
        best = max(s for m in range(1 << len(items)) if (s := sum(x for k, x in enumerate(items) if m >> k & 1)) <= room)
        used = packing.fullest(Counter(items), room)
        assert sum(n * k for n, k in used.items()) == best and not Counter(used) - Counter(items)


def test_packing(spark, docs, texts, empty):
    rows = packing.pack_documents(docs, WORDS, capacity=64, keep_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (at & (at - 1) == 0)
    for i, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens * (2 if i == 8 else 1)
    assert packing.pack_documents(empty, WORDS).count() == 0


def shingle_sets(texts):
    out = {}
    for i, t in enumerate(texts):
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def joined(pairs, n):
    up = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_ngram_join(spark, docs, texts, empty):
    sets = shingle_sets(texts)
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = joined(pairs, len(texts))
    rows = ngram_join.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id]) for r in rows)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_prefix_tree_against_all_pairs():
    from terrafringe.llm.prefix_tree import Forest, PrefixTree

    rng = np.random.default_rng(4)
    for _ in range(60):
        core = np.unique(rng.integers(0, 60, 30))
        sets = [np.unique(np.concatenate([rng.choice(core, rng.integers(1, len(core)), replace=False), rng.integers(60, 90, rng.integers(0, 4))])) for _ in range(12)]
        exact = joined([(i, j) for i in range(12) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))], 12)
        assert joined(PrefixTree(sets).link(Forest(np.arange(12)), 60), 12) == exact


def test_suffix_dedup(spark, docs, texts, empty):
    seen, expected = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        expected[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    rows = suffix_dedup.remove_repeats(docs, keep_text=True).collect()
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in rows)
    assert sum(e[1] for e in expected.values()) > 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_counted_windows_agree_with_sorted_ones(spark, docs, texts, monkeypatch):
    plain = sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "TASK", 1)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == plain
    # All anchors that occur twice are hot.
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == plain


def test_equal_windows_against_a_dictionary():
    rng = np.random.default_rng(6)
    data = np.concatenate([np.tile(rng.integers(97, 99, 150, np.uint8), 3), rng.integers(97, 100, 900, np.uint8)])
    pos = rng.permutation(len(data) - 100)
    first, seen = suffix_sort.equal_windows(data, pos, np.zeros(len(pos), np.int64), 100), {}
    for k, p in enumerate(pos):
        assert first[k] == seen.setdefault(data[p : p + 100].tobytes(), k)


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), [float(x) for x in base[i % 12] + rng.normal(size=8) * (0.15 * (i // 12))]) for i in range(48)]
    rows += [(100, rows[3][1]), (101, None), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [1.0, None] * 4), (105, [1.0] * 3), (106, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.array(v) for i, v in rows if i < 101 or i > 104}
    links = {i: [j for j in good if j != i and len(good[j]) == len(good[i]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.95] for i in good}
    comp = dict(zip(range(107), joined([(i, j) for i in links for j in links[i]], 107), strict=True))
    for r in vector_join.near_vectors(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, [])), comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    assert vector_join.near_vectors(df.filter("false")).count() == 0


def test_vectors_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vector_join, "BLOCK", 20)
    test_vectors(spark)


def test_quality(spark, docs, texts, empty):
    for r in quality.judge(docs).collect():
        t = texts[r.doc_id] or ""
        w, lines = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.passed(quality.judge(docs), ["doc_id"]).count() == quality.judge(docs).filter("kept").count()
    assert quality.judge(empty).count() == 0


def test_language_id(spark, empty):
    rng = random.Random(9)
    words = {"en": "the of and with house water green".split(), "de": "der die und mit haus wasser grün".split(), "es": "el la y con casa agua verde".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i in range(150) for lang in [("en", "de", "es")[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "12 !", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df.filter("doc_id < 120"))
    found = {r.doc_id: r for r in language_id.identify(df.drop("lang"), model).collect()}
    assert np.mean([found[i].lang_pred == lang for i, _, lang in rows if i >= 120]) > 0.95
    assert found[900].lang_pred == found[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in found.values())
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    code = language_id.codewords(9)
    assert min((code[a] != code[b]).sum() for a in range(9) for b in range(a)) >= 8


def test_urls(spark):
    rows = [(1, "https://WWW.Example.com/en/a?x", None), (2, "http://a.example.com/en/b#c", ""), (3, "http://x.net/es/1", '<a href="http://bad.org/q">'), (4, "http://x.net/de/1", None), (5, None, None), (6, "nothing", None), (7, "http://y.org", '<a href="http://x.net/es/">'), (8, "http://com", None), (8, "http://com", None)]
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("a.example.com", "/en/b", "example.com/en/", "block"), 3: ("x.net", "/es/1", "net/es/", "block"), 4: ("x.net", "/de/1", None, found[4][3]), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("y.org", "", None, found[7][3]), 8: ("com", "", None, "allow")}


def test_pagerank_against_matrices(spark):
    hosts = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0), ("c", 0.0, 0.0)], "host string, good double, bad double")
    links = spark.createDataFrame([("a", "c", 3), ("c", "b", 1), ("c", "d", 1)], "src string, dst string, n long")
    found = {r.host: (r.trust, r.distrust) for r in url_filter.spread(hosts, links, rounds=60, settled=1e-12).collect()}
    w, v = np.zeros((4, 4)), np.zeros((4, 4))
    for s, t, n in ((0, 2, 3), (2, 1, 1), (2, 3, 1)):
        w[t, s], v[s, t] = n, n
    w, v = w / np.maximum(w.sum(0), 1), v / np.maximum(v.sum(0), 1)
    trust, distrust = (0.15 * np.linalg.solve(np.eye(4) - 0.85 * m, s) for m, s in ((w, [1, 0, 0, 0]), (v, [0, 1, 0, 0])))
    for k, h in enumerate("abcd"):
        assert found[h] == pytest.approx((trust[k], distrust[k]), abs=1e-9)


def test_pagerank_that_does_not_settle_is_an_error(spark):
    hosts = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, good double, bad double")
    links = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(4)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        url_filter.spread(hosts, links, rounds=2)


def test_links_without_protocol(spark):
    pages = spark.createDataFrame([("a.org", '<a href="//B.org/x"> <a href=//c.org> <a href="/d.org"> <a href="https://b.org/">')], "host string, html string")
    assert sorted(map(tuple, url_filter.host_links(pages).collect())) == [("a.org", "b.org", 2), ("a.org", "c.org", 1)]


def test_passages(spark, docs, texts, empty):
    rows = compact_windows.near_passages(docs).collect()
    n = len(texts)
    pairs = {(r.doc_id, r.match_id) for r in rows}
    assert (n - 3, n - 4) in pairs and all(r.similarity >= 0.8 for r in rows)
    assert {r.doc_id for r in rows} >= {12, 13, 14}
    assert not {r.doc_id for r in rows} & {0, 1, 2, 3, 4}
    assert compact_windows.near_passages(empty).count() == 0


def test_rolling_jaccard_against_sets():
    rng = np.random.default_rng(1)
    for least in range(1, 9):
        x, y = rng.integers(0, 12, 40).astype(np.uint64), rng.integers(0, 12, 30).astype(np.uint64)
        parts = [(s, max(0, s), min(40 - least, 30 - least + s)) for s in (-7, 0, 3, 12)]
        shift, first, last = np.array(parts).T
        windows = [(set(x[i : i + least]), set(y[i - s : i - s + least])) for s, a, b in parts for i in range(a, b + 1)]
        assert compact_windows.rolling_jaccard(x, y, first, last, shift, least) == pytest.approx([len(a & b) / len(a | b) for a, b in windows])


def near_words(a, b, least=46):
    """Words of shingle sequence `a` that lie in a window of similarity 0.8 to one of `b`, by brute force."""
    of_b, out = [set(b[j : j + least]) for j in range(len(b) - least + 1)], set()
    for i in range(len(a) - least + 1):
        own = set(a[i : i + least])
        if any(10 * len(own & s) >= 8 * len(own | s) for s in of_b):
            out |= set(range(i, i + least + 4))
    return out


def shingle_sequences(texts):
    return [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (t.lower().split() for t in texts)]


def found_words(rows):
    out = {}
    for r in rows:
        out.setdefault((r.doc_id, r.match_id), set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


def test_passages_behind_frequent_shingles(spark):
    # Exact 50-word passages of pairs of documents, 20 of whose 46 shingles are boilerplate of all documents.
    rng = random.Random(21)
    word = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    boiler, texts = word(24), []
    for _ in range(20):
        own = word(26)
        texts += [f"{word(60)} {boiler} {own} {word(60)}" for _ in range(2)]
    texts = texts[::2] + texts[1::2]
    rows = compact_windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seqs, found = shingle_sequences(texts), found_words(rows)
    for k in range(20):
        assert found.get((20 + k, k), set()) >= near_words(seqs[20 + k], seqs[k]) != set()


def test_passages_behind_frequent_keys(spark):
    # As before, but 34 of 46 shingles are boilerplate, so that most keys are in over `LIST` pages and too few others are left.
    rng = random.Random(23)
    word = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    boiler, texts = word(38), []
    for _ in range(60):
        own = word(12)
        texts += [f"{word(60)} {boiler} {own} {word(60)}" for _ in range(2)]
    texts = texts[::2] + texts[1::2]
    assert len(texts) > compact_windows.LIST
    rows = compact_windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seqs, found = shingle_sequences(texts), found_words(rows)
    for k in range(60):
        assert found.get((60 + k, k), set()) >= near_words(seqs[60 + k], seqs[k]) != set()
    assert {(r.doc_id, r.class_id) for r in rows} == {(k, k % 60) for k in range(120)}


def test_classes_of_passages_that_have_other_partners(spark):
    # The first two are near to each other, the last two equal; the second is near to the last two, the first is not.
    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    groups = []
    for _ in range(12):
        base, before = fresh(50), fresh(60)
        first, last = (base[:k] + fresh(1) + base[k + 1 :] for k in (15, 33))
        groups.append([fresh(30) + x + fresh(30) for x in (first, base, before + last, before + last)])
    texts = [" ".join(x) for side in zip(*groups, strict=True) for x in side]
    rows = compact_windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    classes = {r.doc_id: r.class_id for r in rows}
    assert all(c % 12 == d % 12 for d, c in classes.items())
    assert sum({classes.get(d) for d in range(g, 48, 12)} == {g} for g in range(12)) >= 10


def test_passages_inside_looser_runs(spark):
    # Near passages within long spans that are not near as a whole, and one held at two places of the other document.
    rng = random.Random(22)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    spoilt = lambda ws, step: [fresh(1)[0] if k % step == step // 2 else w for k, w in enumerate(ws)]
    pairs = []
    for _ in range(12):
        a, b, c = fresh(60), fresh(53), fresh(60)
        pairs.append((fresh(30) + a + b + c, spoilt(a, 16) + b + spoilt(c, 16) + fresh(20)))
    twice = fresh(60)
    pairs.append((fresh(20) + twice + fresh(80) + spoilt(twice, 59), fresh(30) + twice + fresh(30)))
    texts = [" ".join(x) for side in zip(*pairs, strict=True) for x in side]
    rows = compact_windows.near_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seqs, found = shingle_sequences(texts), found_words(rows)
    n = len(pairs)
    for k in range(n):
        need = near_words(seqs[n + k], seqs[k])
        assert need and len(found.get((n + k, k), set()) & need) >= 0.95 * len(need)
        assert found[n + k, k] <= need
    # Both places are passages of the document that holds them.
    assert sorted(r.start_word >= 100 for r in rows if r.doc_id == n - 1) == [False, True]


@pytest.mark.parametrize(("length", "changed", "copies", "around"), [(50, 1, 2, 40), (55, 1, 2, 10), (55, 1, 30, 10), (60, 0, 2, 40)])
def test_passage_recall(spark, length, changed, copies, around):
    # Of the copies that brute force finds near to another one, nine tenths at least have a row for most of the passage.
    rng = random.Random(length + copies + around)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, at = [], []
    for _ in range(60 // copies):
        base = fresh(length)
        for c in range(copies):
            own = list(base)
            for k in rng.sample(range(length), changed if c else 0):
                own[k] = fresh(1)[0]
            texts.append(fresh(around) + own + fresh(around))
            at.append(set(range(around, around + length)))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = spark.createDataFrame([(k, " ".join(texts[i])) for k, i in enumerate(order)], "doc_id long, text string")
    found = {}
    for r in compact_windows.near_passages(docs).collect():
        found.setdefault(order[r.doc_id], set()).update(range(r.start_word, r.start_word + r.n_words))
    seqs = shingle_sequences([" ".join(t) for t in texts])
    hit = total = 0
    for g in range(0, len(texts), copies):
        for i in range(g, g + copies):
            need = set().union(*(near_words(seqs[i], seqs[j]) for j in range(g, g + copies) if j != i))
            if need & at[i]:
                total += 1
                hit += len(found.get(i, set()) & need) >= 0.8 * len(need)
    assert total >= 20 and hit >= 0.9 * total, (hit, total)
    assert all(any(set(seqs[i]) & set(seqs[j]) for j in range(len(seqs)) if j != i) for i in list(found)[:20])


def test_pairs_of_pages_are_dealt_in_blocks(spark):
    # All pairs of 100 pages and one page with 300 partners: each pair is in one block that holds both pages, and a page is in few blocks.
    wanted = [(i, 0, j, 0) for i in range(100) for j in range(i)] + [(1000, 1, 200 + j, 2) for j in range(300)]
    rows = compact_windows.dealt_pairs(spark.createDataFrame(wanted, "node long, page int, other long, other_page int")).collect()
    there = {(r.block, r.node, r.page) for r in rows}
    assert len(there) == len(rows) < 2000 < len(wanted)
    dealt = [(r.block, r.node, r.page, *p) for r in rows for p in r.partners]
    assert sorted(d[1:] for d in dealt) == sorted(wanted)
    assert all((d[0], *d[3:]) in there for d in dealt)


def test_compact_windows_cover_every_span():
    rng = np.random.default_rng(11)
    h = rng.integers(0, 40, 90).astype(np.uint64)
    offsets = np.array([0, 50, 55, 90])
    value, row, lo, mid, hi = compact_windows.compact_windows(h, offsets, 8, 3)
    keys = compact_windows.mix(h ^ np.uint64((3 * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1))
    for r in range(3):
        for i in range(offsets[r], offsets[r + 1]):
            for j in range(i + 7, offsets[r + 1]):
                c = [k for k in range(len(mid)) if row[k] == r and lo[k] <= i <= mid[k] <= j <= hi[k]]
                assert len(c) == 1 and value[c[0]] == keys[i : j + 1].min()


def test_shards(spark, docs, tmp_path):
    store = sharding.shard_table(spark, f"file://{tmp_path}/s", [docs.filter(F.col("doc_id") % 3 == k).repartition(5) for k in range(3)] + [docs.filter("false")], target=1 << 20)
    assert store.version() >= 5 and len(store.shards()) < 15
    back = store.read().drop("shard", "generation")
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select(*back.columns).collect()))
    assert sum(s.rows for s in store.shards()) == docs.count()
    # A writer that is late takes up the newer version.
    version = store.version()
    assert not store._commit(version - 1, [])
    assert store.version() == version
    assert sharding.ShardStore(spark, f"file://{tmp_path}/e").read() is None


def test_compaction_writes_without_a_shuffle(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/c")
    for _ in range(3):
        store.append(docs.repartition(4))
    done = spark._jsparkSession.sharedState().statusStore()
    before = done.executionsCount()
    store.compact(1 << 20, 2)
    plans = done.executionsList(before, 1000)
    writes = [p for p in (plans.apply(k).physicalPlanDescription() for k in range(plans.size())) if "InsertIntoHadoopFs" in p]
    assert writes and not any("Exchange" in p for p in writes)
    assert len(store.shards()) < 12 and sorted(map(str, store.read().drop("shard", "generation").collect())) == sorted(map(str, docs.select(*docs.columns).collect() * 3))


def test_vacuum_leaves_what_is_not_committed_yet(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/v")
    store.append(docs)
    docs.write.parquet(f"{store.root}/data/late")
    late = store._written("data/late", 0)
    store.append(docs)
    store.compact(1 << 20, 2)
    store.vacuum()
    assert store._present(late) and store.read().count() == 2 * docs.count()
    version = store.version()
    assert store._commit(version, store.shards() + late) and store.read().count() == 3 * docs.count()
    store.vacuum(min_age_s=-60)
    assert store.read().count() == 3 * docs.count() and len(list((tmp_path / "v" / "manifests").glob("v*"))) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[101] == 100


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != "packing":
            assert after.columns == docs.columns and 0 < after.count() <= docs.count()
            assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs, before = after, docs
    assert set(docs.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert docs.select("doc_id").distinct().count() == before.count()


@pytest.fixture(scope="module")
def stage_rows(texts):
    """Repeated rows, null ids, several texts of one id, near and exact copies, shared passages."""
    rows = [(i, t, "en", f"s{i}", len(t)) for i, t in enumerate(texts) if t]
    rng = random.Random(31)
    alone, first, second = prose(rng, 80), prose(rng, 90), prose(rng, 90)
    rows += [rows[4], rows[4], (None, alone, "de", "x", 1), (None, alone, "de", "y", 1), (60, second, "en", "b", 2), (60, first, "en", "a", 1), (61, first + " more words than before", "en", "c", 3)]
    shared = prose(rng, 25)
    return rows + [(70, shared + " " + prose(rng, 60), "en", "d", 4), (71, prose(rng, 50) + " " + shared, "en", "e", 5), (71, prose(rng, 50) + " " + shared, "en", "f", 5)]


def stage_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(rows):
    return sorted(map(tuple, rows), key=str)


def test_pipeline_near_duplicates_against_all_pairs(spark, stage_rows):
    import corpus_pipeline

    sets = list(shingle_sets([r[1] for r in stage_rows]).values())
    named = [k for k, r in enumerate(stage_rows) if r[0] is not None]
    pairs = {(stage_rows[a][0], stage_rows[b][0]) for a in named for b in named if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    least = joined(pairs, 100)
    heads = {r[0] for r in stage_rows if r[0] is not None and least[r[0]] == r[0]}
    expected = [min((r for r in stage_rows if r[0] == i), key=lambda r: r[1].encode()) for i in heads] + [r for r in stage_rows if r[0] is None]
    found = corpus_pipeline.near_duplicate_join(spark, stage_frame(spark, stage_rows), "").collect()
    assert [r[:2] for r in by_id(found)] == [r[:2] for r in by_id(expected)]
    assert len(found) == len(heads) + 2 and {tuple(r) for r in found} <= set(stage_rows)


def test_pipeline_repeats_against_brute_force(spark, stage_rows):
    import corpus_pipeline

    rows = [r for k, r in enumerate(stage_rows) if r[0] is None or r[0] < 60 or r[0] == 70] + [stage_rows[-2]] * 2
    seen, kept, gone_of = {}, [], {}
    for node, text in sorted({r[:2] for r in rows if r[0] is not None}):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if seen.setdefault(b[p : p + 100], (node, p)) != (node, p):
                gone[p : p + 100] = True
        gone_of[node] = gone
    for node, text, lang, source, _ in rows:
        gone = gone_of.get(node, np.zeros(len(text.encode()), bool))
        left = bytes(np.frombuffer(text.encode(), np.uint8)[~gone]).decode(errors="ignore")
        if not gone.any() or left.strip(" "):
            kept.append((node, left, lang, source, len(left)))
    assert by_id(corpus_pipeline.repeated_passages(spark, stage_frame(spark, rows), "").collect()) == by_id(kept)


def test_pipeline_quality_and_language_rows(spark, stage_rows):
    import corpus_pipeline

    docs = stage_frame(spark, stage_rows)
    flags = quality.judge(docs).filter("kept").select(*docs.columns).collect()
    assert by_id(corpus_pipeline.quality(spark, docs, "").collect()) == by_id(flags)
    model = language_id.fit(docs.filter(~language_id.held_out()))
    told = {r.text: r.lang_pred for r in language_id.identify(docs, model).collect() if not r.ambiguous}
    expected = [(r[0], r[1], told[r[1]], r[3], r[4]) for r in stage_rows if r[1] in told]
    assert by_id(corpus_pipeline.language(spark, docs, "").collect()) == by_id(expected)
