"""Each operator against a plain version, on a small table."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.common import ByteBound
from tessella.llm import bpe, fingerprints, graph, language_id, line_dedup, packing, quality_classifier, quality_rules, queries, secret_scan, simhash, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PIECES, JSON = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))
ODD_TEXT = st.text(alphabet="ab'stlrev \n\t1²é漢!… \u0085😀́ſ\x1c_<>|▁", max_size=60)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


# graph


def test_components_of_random_links(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 7)]
    want = Sets()
    for a, b in links:
        if a is not None:
            want.join(a, b)
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: want.find(x) for x in list(want) if want.find(x) != x}


# 1: classifier


def test_classifier_on_held_out_labels(spark, small):
    sf = small.replace("sf0.001", "sf0.1")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality_classifier.label_grades(spark.read.parquet(f"{sf}/labels.parquet"))
    model = quality_classifier.fit(d, labels.where("doc_id % 4 <> 1"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = quality_classifier.classify(d, model, 2).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    good, toxic = [r for r in rows if r["grade"] == 2], [r for r in rows if r["grade"] == 0]
    assert np.mean([r["selected"] for r in good]) > 0.97
    assert np.mean([r["tails"][0] < 0.5 or not r["selected"] for r in toxic]) > 0.85
    assert all(r["tails"][0] >= r["tails"][1] and r["expected_grade"] == pytest.approx(sum(r["tails"])) for r in rows)


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(0)
    grades = r.integers(0, 4, 600)
    rows = [np.unique(np.r_[10 + np.arange(g), r.integers(100, 140, 4)]).astype(np.int32) for g in grades]
    tails = quality_classifier.fit_ordinal(rows, grades, 4).tails(rows)
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.95


def test_ordinal_fit_reaches_the_likelihoods_optimum():
    """Against plain gradient descent on the likelihood itself, with numeric gradients."""
    r = np.random.default_rng(3)
    kind = r.integers(0, 4, 3000)
    score = np.array([-2.0, -0.5, 1.0, 2.5])[kind] + r.logistic(size=3000)
    grades = np.digitize(score, [-1.0, 1.5])
    rows = [np.array([10 + k], np.int32) for k in kind]

    def loss(w, t):
        x = 1 / (1 + np.exp(-(w[:, None] - t)))
        x = np.concatenate([np.ones((4, 1)), x, np.zeros((4, 1))], axis=1)
        return -np.mean(np.log(np.maximum(x[kind, grades] - x[kind, grades + 1], 1e-12)))

    p = np.array([0.0, 0.0, 0.0, 0.0, -1.0, 1.0])
    for _ in range(1500):
        at = [loss(q[:4], q[4:]) for q in (p + h for h in 1e-5 * np.eye(6))]
        p = p - 2.0 * (np.array(at) - loss(p[:4], p[4:])) / 1e-5
    model = quality_classifier.fit_ordinal(rows, grades, 3)
    assert loss(model.weights[10:14], model.thresholds) < loss(p[:4], p[4:]) + 0.005
    assert model.thresholds[0] < model.thresholds[1]
    assert model.tails(rows[:4]).shape == (4, 2) and model.tails([np.zeros(0, np.int32)]).shape == (1, 2)


# 2: fingerprints


def test_fingerprints(docs, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).collect()}

    def shingles(t):
        w = WORD.findall(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    gaps = []
    for k, i in enumerate(order):
        t, other = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + other[:third]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(t), shingles(edited)
        if len(a) > 200:
            gaps.append(abs(likeness(a, b) - got[i]["near_edited"]))
            assert abs(likeness(a, shingles(other)) - got[i]["near_next"]) < 0.1
    assert np.mean(gaps) < 0.06
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values()) and len({x for s in by_text.values() for x in s}) == len(by_text)


def _plain_shingles(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_merge_and_contain(spark):
    """Texts of 1 to 20 words within a long one and beside each other, and halves of a long one."""
    w = [f"w{i}" for i in range(400)]
    rows = [(n, s, " ".join(w[s : s + n]), " ".join(w[s + max(0, n - 4) : s + n + 30]), " ".join(w[s : s + n + 30]), " ".join(w)) for n in range(1, 21) for s in range(0, 300, 15)]
    rows += [(250, 0, " ".join(w[:250]), " ".join(w[246:]), " ".join(w), " ".join(w))]
    d = spark.createDataFrame(rows, "n int, s int, a string, b string, ab string, c string")
    for c in ("a", "b", "ab", "c"):
        d = fingerprints.with_fingerprint(d, c, f"f{c}")
    a, b, c = F.col("fa"), F.col("fb"), F.col("fc")
    found = d.select("n", "a", "b", "ab", fingerprints.merge(a, b).alias("m"), "fab", fingerprints.containment(a, c).alias("in_c"), fingerprints.containment(a, F.col("fab")).alias("in_ab"), fingerprints.likeness(a, b).alias("j"), F.size("fa.sketch").alias("kept"))
    n_known = 0
    for r in found.collect():
        if r["n"] >= 5:  # fewer words are one shingle of their own, which no longer text has
            assert r["m"] == r["fab"]
            assert r["in_c"] == (1.0 if r["kept"] else None)
            assert r["in_ab"] == 1.0 or (r["in_ab"] is None and not r["kept"])
            n_known += r["kept"] > 0
        x, y = _plain_shingles(r["a"]), _plain_shingles(r["b"])
        if len(x) <= 32 and len(y) <= 32:
            assert r["j"] == len(x & y) / len(x | y)
    assert n_known > 150


def test_likeness_of_short_and_empty_texts(spark):
    d = spark.createDataFrame([("", " \n"), ("", "one"), ("one", "one"), ("one two", "one"), ("one", " ".join(f"w{i}" for i in range(100)))], "a string, b string")
    d = fingerprints.with_fingerprint(fingerprints.with_fingerprint(d, "a", "fa"), "b", "fb")
    got = [tuple(r) for r in d.select(fingerprints.likeness(F.col("fa"), F.col("fb")), fingerprints.containment(F.col("fa"), F.col("fb"))).collect()]
    assert [x for x, _ in got] == [1.0, 0.0, 1.0, 0.0, 0.0]
    assert [x for _, x in got][:4] == [1.0, 1.0, 1.0, 0.0]


def test_fingerprints_of_other_ids(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "three"), (None, "four five six"), ("a", "three")], "doc_id string, text string")
    got = fingerprints.fingerprint_report(d).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(["b", "a", "a", None]) and len({r["fingerprint"] for r in got}) == 3


@pytest.mark.parametrize("ids", [[5], [3, 1, 2], [None, 4, 4, 9, None, -1], list(range(1000)), [7] * 300 + list(range(200)) + [None] * 300, [x**3 for x in range(700)]])
def test_next_row_over_ranges(spark, ids, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 8)
    d = spark.createDataFrame([(i, f"t{k:04d}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    got = {r["text"]: r["next"]["text"] for r in fingerprints.with_next(d).collect()}
    rows = d.withColumn("h", F.xxhash64("text")).collect()
    order = [r["text"] for r in sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}
    if 7 in ids[:2]:
        parts = d.withColumn("__hash", F.xxhash64("text")).withColumn("r", fingerprints._range_of([3, 7, 7, 7, 7, 100], 4, 2)).groupBy("r").count().collect()
        assert len(parts) > 10 and max(r["count"] for r in parts) < 150


# 3: secrets


def plain_base(t):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in sorted(found, key=lambda x: (x[0], x[2])))


def test_secrets(docs, texts):
    for r in secret_scan.secret_report(docs).collect():
        want = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


@given(st.lists(st.sampled_from(["token", "API_key", '"', "'", " ", ":", "=", "abcdef", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "é", "secret", "-/+", "\n"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_secret_patterns(parts):
    t = "".join(parts)
    assert ",".join(f"{k}:{s}:{e}" for s, e, k in secret_scan.base_spans(t)) == plain_base(t)


def test_novelty():
    key = "q8Zr1vXe0TbYw5Kd7LmNp2Hs"
    assert [k for _, _, k in secret_scan.novel_spans(f"auth = {key}", [])] == ["novel"]
    assert not secret_scan.novel_spans("auth = production_environment_1", [])
    assert not secret_scan.novel_spans(f"seen {key}", [])
    assert not secret_scan.novel_spans(f"auth = {key} auth = {key}", [(0, 100, "hex")])
    assert not secret_scan.is_novel(key, f"the same again {key} ")


@pytest.mark.parametrize("form", ["'password' => '{}'", 'DB_PASSWORD_PROD = "{}"', '"client_secret_value": "{}"', "Authorization: Token {}", "token {}", "passwd_old={}"])
def test_novelty_after_base_names(form):
    key = "x9KqT2mVb7Zr4LwP8sDn3HcY"
    t = form.format(key)
    assert [t[s:e] for s, e, _ in secret_scan.novel_spans(t, secret_scan.base_spans(t))] == [key]


def test_novelty_without_digits():
    r = random.Random(9)
    for n in (16, 20, 40):
        for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"):
            keys = ["".join(r.choices(alphabet, k=n)) for _ in range(200)]
            assert sum(bool(secret_scan.novel_spans(f"auth = {k}", [])) for k in keys) >= 198
    assert secret_scan.novel_spans("session = 9028173645019283", [])
    for word in ("internationalization", "customerRelationshipManager", "AuthenticationProvider", "request.getSession.getAttribute", "/usr/local/share/config/path", "my_database_connection", "-" * 40):
        assert not secret_scan.novel_spans(f"auth = {word}", [])


def test_names_of_the_documents_prime_the_dictionary(spark):
    """Long names that the code uses are not reported, keys beside them are, however often copied."""
    r = random.Random(6)
    name, key = "zylvexFromquadBrithe_okdentPraxulor", "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=30))
    d = spark.createDataFrame([(i, f"{name} = {i}\nauth = {name}\ncookie = {key}") for i in range(40)], "doc_id long, text string").repartition(8)
    names = secret_scan.common_names(d)
    assert name in names and not any(key in x for x in names)
    assert secret_scan.marginal_bytes(name, "auth = ", "", names) < secret_scan.marginal_bytes(name, "auth = ")
    for x in secret_scan.secret_spans(d).collect():
        assert [d["kind"] for d in x["spans"]] == ["novel"]
        assert secret_scan.secret_spans(d.where("false")).count() == 0


def test_many_spans_in_one_text():
    t = " ".join(f'token = "{"ab12" * 5}" auth = q8Zr1vXe0TbYw5Kd7LmNp2Hs' for _ in range(2000))
    base = secret_scan.base_spans(t)
    assert len(base) >= 2000 and all(not (s < b and a < e) for s, e, _ in secret_scan.novel_spans(t, base)[:50] for a, b, _ in base)


# 4: SimHash


def plain_simhash(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, texts):
    fps = {i: plain_simhash(t) for i, t in texts.items()}
    sets = Sets()
    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(i, j)
    for r in simhash.simhash_components(docs).collect():
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == sets.find(r["doc_id"])


def test_trie_join_finds_what_all_pairs_do(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    for x in list(fps):
        for _ in range(r.randint(0, 4)):
            x ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 2, 3))))
            fps.add(x)
    fps = sorted(x - (1 << 63) for x in fps)
    sets = Sets()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                sets.join(a, b)
    got = {x["fp"]: x["root"] for x in simhash.fingerprint_components(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets) if sets.find(x) != x}


# 5: byte-level BPE


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def test_bpe_round_trip(docs, texts, reference_bpe):
    once = {r["doc_id"]: (bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.bpe_round_trip(docs, RANKS).collect()}
    for r in bpe.bpe_decode(bpe.bpe_encode(docs, RANKS), RANKS).collect():
        t = texts[r["doc_id"]]
        assert once[r["doc_id"]] == (bytes(r["ids"]), t.encode())
        assert list(np.frombuffer(r["ids"], "<u4")) == reference_bpe.encode_ordinary(t)
        assert bytes(r["decoded"]) == t.encode()
        at = np.frombuffer(r["offsets"], "<u4").tolist()
        assert [t[a:b] for a, b in pairwise([*at, len(t)])] == regex.findall(public_tokenizers.PATTERN, t)


@given(st.lists(ODD_TEXT, max_size=5))
@settings(max_examples=300, deadline=None)
def test_bpe_of_odd_texts(reference_bpe, parts):
    found = list(bpe.encode_texts(parts, RANKS))
    assert [x.tolist() for x, _, _ in found] == [reference_bpe.encode_ordinary(t) for t in parts]
    for t, (ids, offsets, ends) in zip(parts, found, strict=True):
        assert bpe.decode_slices(ids, offsets, ends, RANKS).tobytes() == t.encode()
        for a, b in ((0, len(t)), (1, 3), (2, len(t) - 1), (len(t), len(t) + 2)):
            assert bpe.decode_between(ids, offsets, ends, RANKS, a, b) == t[a : max(a, b)]


def test_ids_that_do_not_fit_their_offsets_are_an_error():
    (ids, offsets, ends), *_ = bpe.encode_texts(["one two three"], RANKS)
    with pytest.raises(ValueError, match="offsets"):
        bpe.decode_slices(ids, offsets + np.array([0, 1, 0]), ends, RANKS)


def test_caches_are_bounded():
    held = ByteBound(lambda k: k * 2, lambda k, v: 10, 100)
    assert [held[str(i % 7)] for i in range(50)] == [str(i % 7) * 2 for i in range(50)]
    for i in range(1000):
        assert held[str(i)] == str(i) * 2 and len(held) + len(held.old) <= 10


def test_long_slices(reference_bpe):
    for t in ("a" * 3000, "ab" * 2000, " " * 1000, "漢" * 300, "!" * 500):
        assert next(bpe.encode_texts([t], RANKS))[0].tolist() == reference_bpe.encode_ordinary(t)


# 6: rules


def test_rules(docs, texts):
    for r in quality_rules.quality_report(docs).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_rules_keep_what_labels_call_good(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = quality_rules.quality_report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.2


def test_estimation_recovers_accuracies():
    r = np.random.default_rng(1)
    good = r.random(20_000) < 0.7
    right = (0.95, 0.8, 0.7)
    votes = np.stack([np.where(r.random(len(good)) < a, good, ~good) for a in right], axis=1) * 2 - 1
    patterns = Counter(map(tuple, votes.tolist()))
    share, chance = quality_rules.estimate(patterns, 3)
    assert share == pytest.approx(0.7, abs=0.05)
    assert [c[1, 1] for c in chance] == pytest.approx(right, abs=0.05)


# 7: lines


def plain_lines(t):
    return [re.sub(r"\s+", " ", x).strip() for x in t.lower().split("\n")]


def plain_alike(a, b):
    a, b = ({x[i : i + 8] for i in range(len(x) - 7)} for x in (a, b))
    return bool(a or b) and 5 * len(a & b) >= 4 * len(a | b)


def plain_dedup(texts):
    """What stays of {id: text}, by all pairs of lines."""
    lines = list({x: None for i in sorted(texts) for x in plain_lines(texts[i]) if x})
    sets, number = Sets(), {x: k for k, x in enumerate(lines)}
    grams = [{x[i : i + 8] for i in range(len(x) - 7)} for x in lines]
    for k, a in enumerate(grams):
        for j, b in enumerate(grams[:k]):
            if 0.8 * len(a) <= len(b) <= 1.25 * len(a) and a and 5 * len(a & b) >= 4 * len(a | b):
                sets.join(k, j)
    first, out = set(), {}
    for i in sorted(texts):
        stay = []
        for raw, x in zip(texts[i].split("\n"), plain_lines(texts[i]), strict=True):
            c = sets.find(number[x]) if x else None
            if c is None or c not in first:
                stay.append(raw)
            first.add(c)
        out[i] = "\n".join(stay)
    return out


def test_line_dedup(docs, texts):
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == plain_dedup(texts)


@given(st.text(alphabet="aB \n\t\r\x0b\x1c\x85\u00a0\u2003\u3000é", max_size=30))
@settings(max_examples=500, deadline=None)
def test_lines_are_compared_without_case_and_spacing(t):
    assert line_dedup.normal_lines(t) == [" ".join(x.split()) for x in t.lower().split("\n")]


def test_repeated_phrases_of_different_length_meet(spark):
    """Lines with more shingles than one kind of signature is for, but few distinct ones."""
    texts = {1: "-" * 200, 2: "-" * 400, 3: "all rights reserved. " * 20, 4: "all rights reserved. " * 60, 5: "all rights reserved. " * 3, 6: "=" * 90, 7: "=" * 5000}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()} == plain_dedup(texts)


def test_bands_find_nearly_all_alike_lines():
    r = random.Random(9)
    found = []
    for n in (40, 90, 110, 125, 140, 200, 300, 600, 1500):
        for _ in range(40):
            a = "".join(r.choice("abcdefghij ") for _ in range(n))
            b = list(a)
            for _ in range(max(1, n // 100)):
                b[r.randrange(n)] = "z"
            b = "".join(b)
            if plain_alike(a, b):
                which, keys = line_dedup.band_keys([a, b])
                found.append(bool(set(keys[which == 0]) & set(keys[which == 1])))
    assert len(found) > 200 and np.mean(found) > 0.98


def test_band_keys_do_not_depend_on_the_other_lines():
    r = random.Random(4)
    lines = ["".join(r.choice("abcd ") for _ in range(n)) for n in (3, 8, 30, 100, 119, 130, 400, 5000)] + ["-" * 300, "", "漢字" * 60]
    which, keys = line_dedup.band_keys(lines)
    for k, x in enumerate(lines):
        assert sorted(keys[which == k]) == sorted(line_dedup.band_keys([x])[1])


@pytest.mark.parametrize("n", [5, 40, 150, 300])
def test_group_links_join_as_all_pairs_do(n, monkeypatch):
    r = random.Random(n)
    base = [{r.randint(0, 400) for _ in range(40)} for _ in range(8)]
    sets = [base[k % 8] - set(r.sample(sorted(base[k % 8]), r.randint(0, 6))) | {1000 + r.randint(0, 3)} for k in range(n)]
    want, got = Sets(), Sets()
    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if 5 * len(s & t) >= 4 * len(s | t):
                want.join(i, j)
    for a, b in line_dedup.links_in([np.array(sorted(s), np.uint64) for s in sets]):
        got.join(a, b)
    assert [want.find(k) for k in range(n)] == [got.find(k) for k in range(n)]


def test_large_groups_by_joins_as_in_one_piece(spark, monkeypatch):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij ") for _ in range(300))
    lines = []
    for k in range(120):  # near copies, chains that lead away from them, and lines that share a passage
        x = list(lines[-1] if lines and k % 3 == 0 else base)
        for _ in range(r.randint(1, 3)):
            x[r.randrange(len(x))] = r.choice("xyz")
        lines.append("".join(x))
    lines += [base[:200] + "".join(r.choice("klmnopqrst ") for _ in range(120)) for _ in range(60)]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string").repartition(3)
    whole = {tuple(x) for x in line_dedup.line_components(d).collect()}
    for lines_at_most, chars_at_most in ((6, 1 << 20), (2048, 2000)):
        monkeypatch.setattr(line_dedup, "BLOCK", lines_at_most)
        monkeypatch.setattr(line_dedup, "BLOCK_CHARS", chars_at_most)
        assert {tuple(x) for x in line_dedup.line_components(d).collect()} == whole
    assert len(whole) > 100


# 8: language


def test_language_on_held_out_documents(spark, small):
    d = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = language_id.language_report(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in rows]) < 0.01


def test_texts_without_letters_are_unknown(spark):
    d = spark.createDataFrame([(1, "hello there my friend", "en"), (3, "12 34", "en"), (4, None, "en"), (5, "", "fr"), (9, "bonjour mon ami", "fr")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(d, language_id.fit(d, F.lit(True))).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5)) and got[1][0] == "en" and got[9][0] == "fr"


# 9: token counts


def test_token_counts(docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_counts.token_counts(docs, PIECES).collect():
        t = texts[r["doc_id"]]
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


@given(st.lists(ODD_TEXT, max_size=5))
@settings(max_examples=300, deadline=None)
def test_token_counts_of_odd_texts(parts):
    import pyarrow as pa

    assert token_counts.count_tokens(pa.array(parts, pa.string()), PIECES).tolist() == [len(x) for x in token_counts.model(PIECES).encode(parts)]


# 10: packing


@given(st.lists(st.integers(1, 24), max_size=80), st.sampled_from([24, 32]))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [c for c in left if c >= n]
        if fit:
            left.remove(min(fit))
            left.append(min(fit) - n)
        else:
            left.append(window - n)
    used = defaultdict(list)
    for length, lo, hi, first, offset, each in packing.best_fit_decreasing(Counter(lengths), window):
        for r in range(lo, hi):
            used[first + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    for q in used.values():
        at = 0
        for o, n in sorted(q):
            assert o == at
            at += n
    assert sorted(used) == list(range(len(left)))
    assert sorted(window - sum(n for _, n in q) for q in used.values()) == sorted(left)
    assert sum(map(len, used.values())) == len(lengths)


def test_packing(docs, texts):
    t = Tokenizer.from_file(JSON)
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    rows = packing.pack(docs, JSON, with_ids=True).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and part.tobytes() == bytes(r["ids"]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert [s for s, _ in sorted(seen[i])] == list(range(0, len(x), 1024))
    for q in sequences.values():
        assert sum(n for _, n in q) <= 1024 and all(o == sum(n for p, n in q if p < o) for o, _ in q)
    assert sum(map(len, ids.values())) / (len(sequences) * 1024) > 0.95


def test_special_strings_are_tokens():
    t = Tokenizer.from_file(JSON)
    parts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "", "<|endof"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.encode_texts(parts, JSON)] == [t.encode(x, add_special_tokens=False).ids for x in parts]


# pipeline


def test_pipeline_against_plain_steps(spark, docs, texts, small):
    import corpus_pipeline

    out = docs
    kept = dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, small)
        if name == "packing":
            break
        out = out.persist()
        got = {r["doc_id"]: r for r in out.collect()}
        assert set(got) <= set(kept) and all(r["n_chars"] == len(r["text"]) for r in got.values())
        if name == "language_id":
            assert {i for i, t in kept.items() if not any(c.isalpha() for c in t)} & set(got) == set() and len(got) >= 0.98 * len(kept)
        if name == "line_dedup":
            assert set(got) == set(kept)
            lines = Counter(x for r in got.values() for x in line_dedup.normal_lines(r["text"]) if x)
            assert max(lines.values()) == 1
        if name == "simhash_near_dedup":
            fps = {i: plain_simhash(t) for i, t in kept.items()}
            sets = Sets()
            for i in fps:
                for j in fps:
                    if i <= j and (fps[i] ^ fps[j]).bit_count() <= 2:
                        sets.join(i, j)
            assert set(got) == {sets.find(i) for i in fps}
        if name == "secret_scan":
            assert set(got) == set(kept) and not any(plain_base(r["text"]) for r in got.values())
        kept = {i: r["text"] for i, r in got.items()}
    assert {r["doc_id"] for r in out.collect()} == set(kept)
    assert corpus_pipeline.run(spark, small).count() == out.count()


def test_one_row_of_a_component_goes_on(spark):
    """Repeated rows, copies without an id in components with and without one, and one id with two texts."""
    import corpus_pipeline

    r = random.Random(8)
    a, b, c, d = (" ".join(r.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(4))
    rows = [(5, a), (5, a), (3, a), (None, a), (None, b), (None, b), (7, c), (7, c), (7, d), (None, ""), (2, None)]
    t = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.deduplicate_documents(spark, t, "").collect()
    assert Counter((x["doc_id"], x["text"]) for x in got) == Counter([(3, a), (None, b), (7, c), (7, d), (2, None)])
    assert corpus_pipeline.deduplicate_documents(spark, t.where("false"), "").count() == 0


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
