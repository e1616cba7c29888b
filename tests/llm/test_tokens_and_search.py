"""Token counts, alignment and ranked search against the libraries and plain Python, on awkward rows."""

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadloom.llm import alignment, lexical, token_counts  # noqa: E402
from leadloom.llm.entries import tokenizer_path  # noqa: E402

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, kept string, n_tokens int, pair int, row int, score string, places int"
ODD = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "1", "2²", "'s", "'ll", "!", "...", "<|endoftext|>", "<s>", "<0x0A>",
       "<unk>", "中", "　", " ", "aaaa", "\x1c", "🙂", "ﬁ", "é", "The", "İ"]


def odd_texts(n, most=30, more=()):
    rng = random.Random(11)
    return ["".join(rng.choice([*ODD, *more]) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts(300, more=["▁"] * 2) + ["a" * 5000, "ab" * 900 + "abc" * 800, " " * 900 + "x y", "the " * 9000, "same text here", "same text here"]
    return [*enumerate(texts), (5, "another text under an id"), (None, "text without id"), (None, None), (900, None), (901, ""), (902, " ")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, "s", 4) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(A)


def test_counts_are_the_librarys(library):
    texts = odd_texts(5000) + ["a" * 3000, "abcde" * 700, "".join(random.Random(2).choice("abcdefgh") for _ in range(9000)), "\n" * 700]
    few = token_counts.UnitCounts(A, most=50)  # tables that are emptied again and again
    many = token_counts.UnitCounts(A)
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert many.totals(texts) == wanted
    assert [n for k in range(0, len(texts), 100) for n in few.totals(texts[k:k + 100])] == wanted


def test_long_sequences_go_the_same_way():
    rng = random.Random(4)
    sequences = ["".join(rng.choice("abcaab the") for _ in range(rng.randint(1, 400))).encode() for _ in range(200)] + [b"a" * 301, b"ab" * 77]
    rounds, long = token_counts.RankMerges(A, longest_round=10**6), token_counts.RankMerges(A, longest_round=2)
    for x, y in zip(rounds.merged(sequences), long.merged(sequences)):
        assert np.array_equal(x, y)


def test_windows_of_a_long_text_change_nothing(library, monkeypatch):
    text = " ".join(odd_texts(2000, 6))
    monkeypatch.setattr(token_counts, "WINDOW", 50)
    assert token_counts.UnitCounts(A).totals([text, "", text]) == [n := len(library.encode(text, add_special_tokens=False).ids), 0, n]


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        token_counts.RankMerges(tokenizer_path("word_bpe_49k.json"))


def test_count_tokens(docs, rows, library):
    found = token_counts.count_tokens(docs, A, keep=["doc_id", "kept"], limit=20)
    assert found.columns == ["doc_id", "kept", "n_bytes", "n_tokens", "over_limit"]
    wanted = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        wanted.append((i, "k", len((t or "").encode()), n, n > 20))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert token_counts.count_tokens(docs.where("false"), A, keep=["doc_id"]).count() == 0


# --- alignment ----------------------------------------------------------------------

def brute_alignment(texts):
    """(n_a, n_b, n_groups, digest, links) per text by the libraries' own ids and plain sets."""
    from tokenizers import Tokenizer

    models = alignment.two_models(A, B)
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    out = []
    for text in texts:
        wanted = b" " + (text or "").encode()
        a = library.encode(" " + (text or ""), add_special_tokens=False).ids
        b = models.b.encode(text or "")
        if not text or any(b"".join(map(names.__getitem__, ids)) != wanted for ids, names in ((a, models.bytes_a), (b, models.bytes_b))):
            out.append((0, 0, 0, "", []))
            continue
        ends_a = np.cumsum([len(models.bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(models.bytes_b[i]) for i in b]).tolist()
        both = sorted(set(ends_a) & set(ends_b))
        group = {e: k for k, e in enumerate(both)}
        parts = [([], []) for _ in both]
        for side, (ends, ids) in enumerate(((ends_a, a), (ends_b, b))):
            for e, i in zip(ends, ids):
                parts[next(group[x] for x in both if x >= e) if len(both) < 200 else group[both[np.searchsorted(both, e)]]][side].append(str(i))
        digest = ";".join(",".join(x) + "|" + ",".join(y) for x, y in parts)
        by_a, by_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        out.append((len(a), len(b), len(both), hashlib.sha256(digest.encode()).hexdigest(), [(by_a[e], by_b[e]) for e in both]))
    return out


def test_paths_cut_anywhere_give_all_shared_ends():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 40, 500):
        for _ in range(20):
            a, b = (np.unique(rng.integers(0, max(1, 2 * n), rng.integers(0, n + 1))) for _ in range(2))
            wanted = np.intersect1d(a, b)
            for work in (1, 2, 3, 17, 10_000):
                i, j = alignment.path_splits(a, b, work)
                assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (i[-1], j[-1]) == (len(a), len(b))
                assert np.diff(i + j).max(initial=0) <= work + 1
                x, y = alignment.shared_ends(a, b, work)
                assert np.array_equal(a[x], wanted) and np.array_equal(b[y], wanted)


def test_alignment_of_texts():
    texts = odd_texts(800, 25, ["▁"]) + ["a" * 700, " " * 300 + "x", "word, word. word! (word) 'word' word's"]
    wanted = brute_alignment(texts)
    models = alignment.two_models(A, B)
    for work in (8192, 5):
        for got, w in zip(alignment.aligned(models, texts, work), wanted):
            keys = models.pairs.keys[np.frombuffer(got[4], "<i4")]
            assert got[:4] == w[:4]
            assert keys.tolist() == sorted(a * models.pairs.n_b + b for a, b in w[4])
    assert 0 < sum(w[0] == 0 for w in wanted) < len(texts)  # texts with U+2581 don't come back
    small = alignment.TwoModels(A, B, most=20)
    assert [x for k in range(0, 800, 50) for x in alignment.aligned(small, texts[k:k + 50])] == alignment.aligned(models, texts[:800])


def test_align(docs, rows):
    found = alignment.align(docs, A, B, keep=["doc_id", "kept"])
    assert found.columns == ["doc_id", "kept", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    each = brute_alignment([t for _, t in rows])
    counts = Counter(link for e in each for link in e[4])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    wanted = [(i, "k", *e[:3], len(e[4]), sum(counts[x] == best[x[1]] for x in e[4]), sum(counts[x] for x in e[4]), e[3])
              for (i, _), e in zip(rows, each)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted))
    assert alignment.align(docs.where("false"), A, B, keep=["doc_id"]).count() == 0


# --- search -------------------------------------------------------------------------

def brute_search(docs, items, top=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    each = [(i, Counter(terms(t))) for i, t in docs]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    count, length = len(each), sum(n for _, _, n in each)
    held = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in each:
            m = 100 - 90 + (90 * n * count) // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * held[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "É", "the", "The", "x_y", "a-b", "中文"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    docs += [(k, docs[3][1]) for k in range(300, 340)] + [(7, docs[3][1]), (None, docs[3][1]), (None, None), (500, ""), (501, "-- !!")]
    docs += [(502, "w1 " * 5000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(30)]
    items += [(30, docs[3][1]), (30, docs[3][1]), (31, None), (32, ""), (33, "unknown words only"), (None, "w1 w2")]
    return docs, items


def test_search(spark, corpus, monkeypatch):
    docs, items = corpus
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item string, rank int").repartition(6)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    wanted = sorted(map(str, brute_search(docs, items)))
    for block in (1 << 20, 200):
        assert sorted(str(tuple(r)) for r in lexical.search(frame, asked, block_bytes=block).collect()) == wanted
    assert len(wanted) > 100
    assert lexical.search(frame.where("false"), asked).count() == 0
    assert lexical.search(frame, asked.where("false")).count() == 0
    assert lexical.search(frame.where("text = ''"), asked).count() == 0


def test_shared_parts_give_the_items_back():
    rng = random.Random(3)
    for n in (0, 1, 5, 60):
        items = [sorted(rng.sample(range(40), rng.randint(0, 20))) for _ in range(n)]
        graph = lexical.share(items, 40)
        parts = {k: [t for t in range(40) if graph.leaf_of[t] == k] for k in range(graph.leaves)}
        for node, a, b in (m for level in graph.levels for m in zip(*(x.tolist() for x in level))):
            parts[node] = parts[a] + parts[b]
        for found, nodes in zip(items, graph.items):
            assert sorted(t for k in nodes for t in parts[k]) == found  # every term once
        assert graph.additions[1] <= graph.additions[0] or n < 2
    same = lexical.share([[0, 1, 2, 3]] * 50, 4)
    assert same.leaves == 1 and same.additions == (150, 3)


def test_terms_in_runs(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 3)
    data = "Ab_cd  e中文-f A1b2".encode()
    assert [t for run in lexical._runs(data) for t in run] == lexical.terms_of(data) == ["ab".encode(), b"cd", "e中文".encode(), b"f", b"a1b2"]
