"""Operators on single texts against plain versions: tokens, PII, secrets, licenses, language."""

from __future__ import annotations

import hashlib
import json
import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import bpe_automaton, language_id, license_scan, pii, secrets_scan, tokens

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
MERGE_LIST = json.loads(Path(VOCAB).read_text())["model"]["merges"]
_BYTE = bpe_automaton.byte_alphabet()
RANKS = {tuple(bytes(_BYTE[c] for c in x) for x in (m if isinstance(m, list) else m.split(" "))): i for i, m in enumerate(MERGE_LIST)}
DOCS = "doc_id long, text string, lang string, n_tokens string, score double, spans string, part string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


@pytest.fixture(scope="module")
def automaton():
    return AUTOMATON


def rows_of(texts, start=0):
    return [(start + i, t, "en", "x", 1.0, "y", "z") for i, t in enumerate(texts)]


ODD = ["", None, " ", "\n\n", "a" * 30_000, " a  b\n\n c \t d ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "don't we'll", "日本語 １２ ½ é é \U0001f600‍", "end  ", "same", "same"]


LIBRARY, AUTOMATON, MERGES = Tokenizer.from_file(VOCAB), bpe_automaton.Tokenizer(VOCAB), bpe_automaton.Tokenizer(VOCAB, "merges")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab tThe'sl\n\r\t .,!1２é中😀　 \x85\x1c-<|>")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_automaton_equals_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert AUTOMATON.encode(text) == ids and MERGES.encode(text) == ids
    assert AUTOMATON.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.lists(st.integers(0, 50_255), min_size=2, max_size=4))
def test_table_has_one_path_and_it_is_the_merged_one(word):
    """Merge by rank, plainly, and hold the compiled states and arcs against it: the merged sequence is a path of the
    table, path() finds it, and no other cut of the word into tokens is one."""
    machine = AUTOMATON.automaton
    if isinstance(word, list):  # tokens set side by side, which merging may cut elsewhere
        word = b"".join(machine.labels[i] for i in word)
    word = word[:60]
    parts = [bytes([b]) for b in word]
    while found := [(RANKS[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in RANKS]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert [machine.labels[i] for i in machine.path(word)] == parts
    assert all(machine.has_arc(a, t) for a, t in zip([None, *parts], parts))
    ways = {0: {None: 1}}  # position -> last token -> accepted ways to get there
    for end in range(1, len(word) + 1):
        ways[end] = {}
        for start in range(end):
            t = word[start:end]
            n = sum(k for a, k in ways[start].items() if machine.has_arc(a, t)) if t in machine.leads else 0
            if n:
                ways[end][t] = n
        assert sum(ways[end].values()) == 1


def test_automaton_paths_of_random_ids(library, automaton):
    rng = random.Random(3)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_encode_table(spark, library):
    df = spark.createDataFrame(rows_of(ODD), DOCS)
    got = {r["doc_id"]: r for r in tokens.encode(df, VOCAB, digests=True, decoded=True).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == (t or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = tokens.decode(tokens.encode(df, VOCAB), VOCAB).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {i: t or "" for i, t in enumerate(ODD)}
    assert tokens.encode(df.limit(0), VOCAB).count() == 0


def test_length_histogram(spark):
    lengths = [0, 0, 5, 7, 7, 1023, 1024, 5000, 5001, None]
    h = tokens.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    own = [x for x in lengths if x is not None]
    for r in h.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == own.count(n) and r["docs_ge"] == sum(x >= n for x in own) and r["tokens_ge"] == sum(x for x in own if x >= n)
        assert r["docs_le"] == sum(x <= n for x in own) and r["tokens_le"] == sum(x for x in own if x <= n) and r["tokens_within"] == sum(min(x, n) for x in own)
    told = {(r["kind"], r["asked"]): r for r in tokens.answer(h, [6, 100_000], [0.5]).collect()}
    assert told["limit", 6]["tokens_within"] == sum(min(x, 6) for x in own) and told["limit", 6]["docs_cut"] == sum(x > 6 for x in own)
    assert told["limit", 100_000]["tokens_within"] == sum(own) and told["quantile", 0.5]["n_tokens"] == sorted(own)[4]
    assert tokens.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def plain_pii(t):
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "1", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1", "(555) ", "555-0199 22", "é", "_%", "12.", "a@b", "@c.d"]), max_size=12).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert [(k, a, b) for k in pii.KINDS for a, b in pii.base_spans(text)[k]] == plain_pii(text)


@pytest.mark.parametrize(("text", "kind", "source"), [
    ("write to jane (at) mail (dot) example.org now", "email", "jane (at) mail (dot) example.org"),
    ("write to jane at mail dot com", "email", "jane at mail dot com"),
    ("jаne@mаil.com", "email", "jаne@mаil.com"),
    ("call +one five five five one two three four five six now", "phone", "+one five five five one two three four five six"),
    ("ip １９２.168.0.1!", "ip", "１９２.168.0.1"),
])
def test_disguised_spans_map_back(text, kind, source):
    found = [(k, text[a:b]) for k, a, b, base in pii.spans(text) if not base]
    assert (kind, source) in found


def test_clean_texts_have_no_disguised_spans():
    for t in ["We met at noon and put one dot there.", "one two buckle my shoe", "Привет, мир", "x" * 50_000, "@" * 20_000, "1" * 50_000, "a.b " * 5000]:
        assert pii.spans(t) == []


def test_pii_tables(spark):
    texts = [*ODD, "a@b.co and 10.0.0.1", "jane (at) mail (dot) org"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    for i, t in enumerate(texts):
        base = plain_pii(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest() and got[i]["n_email"] == sum(x[0] == "email" for x in base)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[13] == "<EMAIL> and <IP>" and clean[14] == "<EMAIL>" and clean[1] is None and pii.redact(df).columns == df.columns
    assert pii.detect(df.limit(0)).count() == 0


def plain_secrets(t):
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    place = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], place.index(s[0])))


def test_secret_scan(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd", "Api_Key", "apikey", "token", ":", "=", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", "0123456789abcdef0", "short", "é", "longenoughvalue1", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(300)] + ODD + ["-----BEGIN RSA PRIVATE KEY-----", "x" * 40_000 + " secret=abcdefghijklmnop", "password: token: abcdefghijklmnopqr"]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r["doc_id"]: r for r in secrets_scan.scan(df).collect()}
    for i, t in enumerate(texts):
        base = plain_secrets(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), t
        assert got[i]["n_hex"] == sum(s[0] == "hex" for s in base)
    assert "private_key:0:31" in got[len(texts) - 3]["spans"]
    assert secrets_scan.scan(df.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets_scan.trigram_query(r"[0-9a-f]{16,}") is None
    assert secrets_scan.trigram_query(r"AKIA[A-Z0-9]{14,}") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in secrets_scan.trigram_query(secrets_scan.RULES[0].regex)
    assert secrets_scan.trigram_query("(foo|ba)r?") is None and secrets_scan.trigram_query("abc.*defg") == [frozenset({"abc", "def", "efg"})]


def plain_licenses(texts):
    def shingles(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    out = set()
    for i, t in enumerate(texts):
        have = set(shingles(t))
        for name, body in license_scan.TEMPLATES.items():
            own = set(shingles(body))
            if len(own & have) >= 0.8 * len(own):
                out.add((i, name, len(own & have)))
    return out


def test_license_scan(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    texts = [noise(rng.randrange(60)) + " " + body + " " + noise(rng.randrange(60)) for body in license_scan.TEMPLATES.values() for _ in range(4)] + ODD + [noise(5000) + license_scan.TEMPLATES["mit"], "released under the"]
    mine = license_scan.scan(spark.createDataFrame(rows_of(texts), DOCS))
    assert {(r["doc_id"], r["license"], r["n_found"]) for r in mine.collect()} == plain_licenses(texts)
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_license_bands_decide(spark):
    """Without the wide bands the longer templates aren't retrieved, however much of them a text holds."""
    texts = ["some words before " + license_scan.TEMPLATES["mit-text"] + " and after", license_scan.TEMPLATES["mit"]]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    few, all_ = ({r["license"] for r in license_scan.retrieve(df, bands=b).collect()} for b in (1, license_scan.BANDS))
    assert {"mit-text", "mit-grant", "mit"} <= all_ and "mit" in few and "mit-text" in all_ - (few - {"mit-text"})
    assert not {r["license"] for r in license_scan.scan(df, {"x": license_scan.TEMPLATES["gpl-header"]}).collect()}


def test_license_bands_miss_little():
    """Bands over random windows of 16 shingles that hold a unit of 8 whole, or all but one of it."""
    rng, corners = np.random.default_rng(3), np.array(license_scan.seeds(license_scan.BANDS), np.int64)
    least = lambda x: (x[:, :, None] ^ corners).min(axis=1)
    for common, bound in ((8, 1e-4), (7, 1.5e-3)):
        missed, n = 0, 0
        for _ in range(20):
            window = rng.integers(-(1 << 63), (1 << 63) - 1, (5000, 16), dtype=np.int64)
            unit = np.concatenate([window[:, :common], rng.integers(-(1 << 63), (1 << 63) - 1, (5000, 8 - common), dtype=np.int64)], axis=1)
            missed += int((~(least(window) == least(unit)).any(axis=1)).sum())
            n += 5000
        print(common, missed / n)
        assert missed / n < bound


def test_license_first_words(spark):
    both = f"x {license_scan.TEMPLATES['mit']} and {license_scan.TEMPLATES['unlicense']}"
    got = {r["license"]: r["first_word"] for r in license_scan.scan(spark.createDataFrame(rows_of([both]), DOCS)).collect()}
    assert got["mit"] == 1 and got["unlicense"] == 7


def test_many_matches_in_one_text(spark):
    """100,000 matches in a text take no longer than their number."""
    n = 100_000
    hexes, mails = "deadbeefdeadbeef " * n, "a@b.co " * n
    df = spark.createDataFrame([(1, hexes)], "doc_id long, text string")
    [r] = secrets_scan.scan(df).collect()
    assert r["n_hex"] == n and r["spans"].endswith(f"hex:{17 * (n - 1)}:{17 * n - 1}")
    assert r["base_sha256"] == hashlib.sha256(",".join(f"hex:{17 * i}:{17 * i + 16}" for i in range(n)).encode()).hexdigest()
    found = pii.spans(mails + "jane (at) mail (dot) org " * 1000)
    assert sum(s[3] for s in found) == n and len(found) == n + 1000


def test_language_id(spark):
    rng = random.Random(2)
    words = {"en": "the and of that was with from they".split(), "de": "der und nicht mit ein ich schön größe".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(120) for lang in [("en", "de")[i % 2]]] + [(900, None, "en"), (901, "12 34 !", None), (902, "", "de"), (903, "²½", None), (904, "und" * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, public_tokenizers.path("piece_bpe_32k.model"), ~language_id.held_out(), per_language=30)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i < 900)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903)) and got[904]["lang_pred"] in ("en", "de")
    none = language_id.train(df.limit(0), public_tokenizers.path("piece_bpe_32k.model"), ~language_id.held_out())
    assert {r["lang_pred"] for r in language_id.predict(df, none).collect()} == {"und"}


def test_long_words_teach_whole():
    """Without a cut or an underflow: the expected counts of a long word cover each of its characters once."""
    rows = {"a": 0.2, "b": 0.1, "ab": 0.05, "▁": 0.01, "▁a": 0.02}
    short, long = (language_id._expected({w: 2}, rows, 1e-6, 2) for w in ("ab" * 12, "ab" * 13))
    assert all(abs(sum(len(p) * n for p, n in got.items()) - 2 * (1 + k)) < 1e-3 for got, k in ((short, 24), (long, 26)))
    assert abs(language_id._expected({"q" * 5000: 1}, rows, 1e-9, 2)["q"] - 5000) < 1e-3
    plain = language_id._expected({"ab" * 12: 1}, rows, 1e-6, 2)
    scaled: dict = language_id.defaultdict(float)
    language_id._expected_long("▁" + "ab" * 12, 1, rows, 1e-6, 2, scaled)
    assert plain.keys() == scaled.keys() and all(abs(plain[k] - scaled[k]) < 1e-9 for k in plain)
    assert language_id.learn({"x": {"q" * 150: 1}, "y": {"w" * 150: 1}}, ["q", "w"]).rows["q"].argmax() == 0


def test_forward_sums_all_segmentations():
    model = language_id.learn({"x": {"abab": 3, "ba": 1}}, ["a", "b", "ab", "▁a", "▁ab"])
    p = {k: float(v[0]) for k, v in model.rows.items()}

    def total(w):
        return 1.0 if not w else sum(p[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p)

    assert abs(float(model.forward("abab")[0]) - np.log(total("▁abab"))) < 1e-9
    long = float(model.forward("ab" * 400)[0])
    assert np.isfinite(long) and long < float(model.forward("ab" * 200)[0])
