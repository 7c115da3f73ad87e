"""Operators that compare rows, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cellweave.llm import components, exact_dedup, ngram_join, packing, vector_dedup

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(texts):
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, digest):
    texts = ["a", "A", None, "", "É", "é", "b" * 50_000, "B" * 50_000, "x", "y", "z", "a"] + [f"t{i % 40}" for i in range(100)]
    got = {r["doc_id"]: r for r in exact_dedup.dedup(spark.createDataFrame(rows_of(texts), DOCS), digest=digest).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if lower(u) == lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
        assert got[i]["text_sha256"] == hashlib.sha256(lower(t).encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "q")], "doc_id long, text string")
    got = [tuple(r)[:4] for r in exact_dedup.dedup(df).orderBy("doc_id", "keep_id").collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 4, False), (None, 3, 4, False), (3, 3, 4, True), (3, 3, 4, True), (None, None, 1, True)], key=str)
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    """A second run over a folder with new files starts from the stored state and gives what one run over all would."""
    rows = rows_of(["a", "b", "A", "c", "b", "d", None, ""] * 3)
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    frame = lambda part: spark.createDataFrame(part, DOCS + ", digest string, keep_id long, n long, salt int")
    clash = [(*r, "x", 1, 2, 3) for r in rows]
    frame(clash[:10]).write.parquet(path)
    first = {r["doc_id"]: r["group_size"] for r in exact_dedup.dedup_files(spark, path, state_path=state).collect()}
    assert first[0] == sum(lower(t) == "a" for _, t, *_ in rows[:10])
    frame(clash[10:]).write.mode("append").parquet(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    both = [sorted(map(tuple, exact_dedup.dedup_files(spark, path, state_path=s).drop("keep_file").collect())) for s in (state, None)]
    assert both[0] == both[1] and len(both[0]) == len(rows) and spark.conf.get(key) == before


def test_exact_dedup_of_a_large_group(spark):
    """A group of more rows than one task takes meets its text in several, each row once."""
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"own {i}") for i in range(3000)], "doc_id long, text string")
    got = exact_dedup.dedup(df).groupBy("group_size", "kept").count().collect()
    assert {(r["group_size"], r["kept"]): r["count"] for r in got} == {(2000, False): 1999, (2000, True): 1, (1, True): 1000}


def test_vectors_at_the_threshold_and_of_one_id(spark):
    """A cosine of the threshold itself links; rows of one id are one vector and don't link with each other."""
    rows = [(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [6.0, 8.0], 0), (3, [6.0, 8.0], 0), (4, [0.0, 1.0], 0)]
    got = vector_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.6, recall=1.0).collect()
    assert {(r["vec_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1)} and len(got) == 5
    one = {r["vec_id"]: r["n_links"] for r in got}
    assert one[1] >= 2 and one[4] >= 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    g = Groups({n for e in edges for n in e})
    for a, b in edges:
        g.join(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: g.find(n) for n in g.up if any(n in e for e in edges if e[0] != e[1])}


def plain_join(texts, width, percent):
    sets = []
    for t in texts:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    g = Groups(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                g.join(i, j)
    return sets, g


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_ngram_join(spark, width, percent):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  \t", "one", "ONE", "one two", "One  two", "w1 " * 5000, " "]
    for size in (8, 15, 30, 120, 600):
        for _ in range(4):
            base = rng.choices(words, k=size)
            for edits in (0, 1, 1, 2, 3, 6, 12):
                own = list(base)
                for _ in range(edits):
                    own[rng.randrange(len(own))] = rng.choice(words)
                texts.append(" ".join(own[: len(own) - rng.randrange(2)]))
    sets, g = plain_join(texts, width, percent)
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r["doc_id"]: r for r in ngram_join.join_documents(df, width, percent).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert {i: r["component_id"] for i, r in got.items()} == {i: g.find(i) for i in range(len(texts))}


def test_ngram_join_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert Counter((r["doc_id"], r["component_id"]) for r in ngram_join.join_documents(df).collect()) == Counter({(None, None): 1, (7, 7): 2, (9, 7): 1})
    assert ngram_join.join_documents(df.limit(0)).count() == 0


def test_words_of_like_letters_are_apart(spark):
    """Long words that a polynomial hash of bytes modulo 2 ** 64 can't tell apart (Thue-Morse) share no link."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} {other}"), (4, f"{other} {word}"), (5, word.upper())]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_ngram_join_large_groups(spark):
    """Many near copies of one text, exact copies by the hundred, and texts that share a passage only."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base, passage = rng.choices(words, k=200), rng.choices(words, k=60)
    texts = [" ".join(base[:i] + ["x%d" % i] + base[i + 1 :]) for i in range(150)] + [" ".join(base)] * 200
    texts += [" ".join(rng.choices(words, k=120) + passage) for _ in range(100)]
    df = spark.createDataFrame([(*r, "u", "v", "w", "x") for r in rows_of(texts)], DOCS + ", id string, fp string, c string, sig string").repartition(7)
    sets, g = plain_join(texts, 3, 90)
    got = {r["doc_id"]: r for r in ngram_join.join_documents(df, 3, 90).collect()}
    assert all(got[i]["component_id"] == g.find(i) and got[i]["n_shingles"] == len(s) for i, s in enumerate(sets))


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for percent in (70, 80, 90):
        levels = ngram_join._levels()
        for _ in range(1500):
            n = int(rng.integers(1, 60 if rng.random() < 0.8 else 400))
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = set(a.tolist())
            for _ in range(int(rng.integers(0, max(8, n // 4)))):
                if rng.random() < 0.5 and len(b) > 1:
                    b.discard(sorted(b)[int(rng.integers(0, len(b)))])
                else:
                    b.add(int(rng.integers(0, 1 << 63)))
            c = np.array(sorted(b), np.uint64)
            common = len(np.intersect1d(a, c))
            if 100 * common >= percent * (len(a) + len(c) - common):
                assert len(np.intersect1d(ngram_join.signatures(a, percent, levels), ngram_join.signatures(c, percent, levels)))


def test_packing_plan():
    rng = random.Random(6)
    for counts in ({2048: 3, 1024: 5, 1: 7}, {1500: 10, 548: 4, 300: 20, 248: 6, 100: 9}, {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}, {700: 1_000_000, 648: 10}, {}):
        runs = packing.plan(counts, 2048)
        n = int(runs["sequences"][0])
        used = Counter()
        for length, side, first in zip(runs["length"].tolist(), runs["side"].tolist(), runs["first"].tolist(), strict=True):
            used[length] = max(used[length], first)
        total = sum(k * v for k, v in counts.items())
        # No packing needs fewer sequences than the tokens fill, or than there are pieces longer than a half.
        least = max(math.ceil(total / 2048), sum(k for x, k in counts.items() if x > 1024), math.ceil(sum(k for x, k in counts.items() if x >= 683) / 2))
        assert least <= n <= 1.12 * least + 2


def test_sums_index_lists_all_combinations():
    rng = random.Random(2)
    for _ in range(60):
        n = np.zeros(41, np.int64)
        for x in rng.sample(range(1, 41), rng.randint(1, 25)):
            n[x] = rng.randint(1, 3)
        index = packing.Sums(n, 40)
        for _ in range(12):
            have = [x for x in range(1, 41) for _ in range(min(n[x], 3))]
            for s in range(1, 41):
                pairs = {(a, b) for a, b in itertools.combinations(sorted(have, reverse=True), 2) if a + b == s}
                assert {tuple(p) for p in index.two(s)} == pairs and (index.one(s) == [[s]]) == (s in have)
                triples = {t for t in itertools.combinations(sorted(have, reverse=True), 3) if sum(t) == s}
                assert triples <= {tuple(t) for t in index.three(s)}
            if not have:
                break
            x = rng.choice(have)
            index.take(x, rng.randint(1, int(n[x])))


def check_packed(rows, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at = 0
        for n, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            own = ids_of[doc][at : at + r["length"]]
            assert r["piece"] == n and r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and (n == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids_of[doc]) and len(pieces) == math.ceil(at / capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    total = sum(map(len, ids_of.values()))
    return len(by_sequence), math.ceil(total / capacity)


def test_pack(spark):
    library, rng = Tokenizer.from_file(VOCAB), random.Random(8)
    texts = [None, "", "a b " * 300] + [" ".join(rng.choices(["word", "other", "thing", "é"], k=rng.randrange(1, 150))) for _ in range(300)] + ["same text"] * 50
    df = spark.createDataFrame(rows_of(texts), DOCS).repartition(5)
    ids_of = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(df, VOCAB, capacity=128, ids=True).collect()
    n, least = check_packed(rows, ids_of, 128)
    assert n <= 1.03 * least + 1
    for r in rows:
        assert list(r["ids"]) == ids_of[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert packing.pack(df.limit(0), VOCAB).count() == 0


def test_vector_dedup(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32))
    near = np.repeat(base[:60], 6, axis=0) + 0.12 * rng.standard_normal((360, 32)) * np.linspace(0.2, 1.2, 360)[:, None]
    hot = np.repeat(base[100:101], 300, axis=0) + 0.02 * rng.standard_normal((300, 32))
    x = np.concatenate([base, near, hot, base[:30]]).astype(np.float32)
    label = [int(i % 3) for i in range(60)] * 25 + [int(i // 6 % 3) for i in range(360)] + [1] * 300 + [int(i % 3) for i in range(30)]
    rows = [(i, v.tolist(), c, "k", 1) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [None] * 32, [1.0] * 8, [1.0] * 8]
    rows += [(5000 + i, v, 0, "k", 1) for i, v in enumerate(odd)] + [(6000, x[0].tolist(), None, "k", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, home string, indexed int")
    got = {r["vec_id"]: r for r in vector_dedup.link(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near_ = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label))
    np.fill_diagonal(near_, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.9 * near_.sum() and all(got[i]["n_links"] <= near_[i].sum() for i in range(len(x)))
    g = Groups(range(len(x)))
    for a, b in zip(*np.nonzero(np.triu(near_)), strict=True):
        g.join(int(a), int(b))
    assert np.mean([got[i]["component_id"] == g.find(i) for i in range(len(x))]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (*range(5000, 5006), 6000)) and got[5007]["component_id"] == 5006 and got[5006]["n_links"] == 1
    assert vector_dedup.link(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = [f"mot{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    near = texts[0].split()
    near[59] = "other"
    texts += [texts[1].upper(), texts[2], " ".join(near), None, "12 34", "mail a@b.org now " + texts[3][:80], "", "word " * 3000]
    spark.createDataFrame(rows_of(texts), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {i: t for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    last = {lower(t): i for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if last[lower(t)] == i}
    order = sorted(kept)
    _, g = plain_join([kept[i] for i in order], 5, 80)
    kept = {i: kept[i] for n, i in enumerate(order) if g.find(n) == n}
    kept = {i: t.replace("a@b.org", "<EMAIL>") for i, t in kept.items()}
    library = Tokenizer.from_file(VOCAB)
    check_packed(rows, {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in kept.items()}, 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
