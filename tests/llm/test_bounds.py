"""What must not depend on copies, on partitions or on texts without blanks."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from tessella.llm import language_id, quality_classifier, secret_scan, token_counts


def _words(r, letters, n):
    return " ".join("".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(n))


def test_copies_do_not_crowd_out_a_language(spark):
    r = random.Random(1)
    english = [_words(r, "abcdefgh", 30) for _ in range(31)]
    french = [_words(r, "opqrstuvé", 30) for _ in range(60)]
    copies = spark.range(100_000).select(F.lit(english[0]).alias("text"), F.lit("en").alias("lang"))
    d = copies.unionByName(spark.createDataFrame([(t, "en") for t in english[1:]] + [(t, "fr") for t in french], "text string, lang string"))
    model = language_id.fit(d, F.lit(True))
    assert set(model.langs) == {"en", "fr"} and model.langs.count("en") > 1
    langs, _, rejected = model.predict([*english, *french])
    assert langs == ["en"] * 31 + ["fr"] * 60 and not rejected.any()


def test_the_sample_is_that_of_the_smallest_hashes(spark):
    """The same model whatever copies there are and however rows are dealt out."""
    r = random.Random(2)
    rows = [(_words(r, "abcdefgh", 12), "en") for _ in range(80)] + [(_words(r, "mnopqrs", 12), "xx") for _ in range(5)]
    d = spark.createDataFrame(rows, "text string, lang string")
    hashes = [x[0] for x in d.where("lang = 'en'").select(F.xxhash64("text")).collect()]
    drawn = [t for _, (t, _) in sorted(zip(hashes, rows, strict=False))][:20]
    few = spark.createDataFrame([(t, "en") for t in drawn] + rows[80:], "text string, lang string")
    again = d.unionByName(d).unionByName(d.limit(7))
    models = [language_id.fit(x.repartition(n), F.lit(True), fit_documents=20) for x, n in ((d, 1), (d, 5), (again, 3))]
    assert all((m.centers == models[0].centers).all() for m in models[:2])
    assert [m.langs for m in models] == [models[0].langs] * 3 and len(few.collect()) == 25


def test_names_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    texts = [f'refreshEndpoint = "{i}"; see loadUserSettings and my.module here' for i in range(51)] + [f"only_once_{x} = 1" for x in "ab"]
    texts += ["same_name same_name same_name"] + [_words(r, "abcdefgh", 20) for _ in range(20)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [secret_scan.common_names(d.repartition(n)) for n in (1, 2, 16)]
    assert found[0] == found[1] == found[2] == ("loadUserSettings", "my.module", "refreshEndpoint")
    spans = [sorted((r["doc_id"], r["spans"]) for r in secret_scan.secret_report(d.repartition(n)).collect()) for n in (1, 2, 16)]
    assert spans[0] == spans[1] == spans[2]


def test_short_and_quoted_secrets(spark):
    keys = {'pwd: "Xk9$mQ2!vB7#zL4"': (6, 21), 'passphrase = "aZ4kQ9xW7bT2"': (14, 26), "auth_key = 'p@55;w0rd|Qz81'": (12, 26), 'credential: "gTqZ#vKx!WbRj&HpD"': (13, 30)}
    for text, (s, e) in keys.items():
        assert secret_scan.novel_spans(text, []) == [(s, e, "novel")], text
    for text in ('pwd: "please-change-me!"', "session = 'Hello,everybody!'", 'auth: "https://example.com/settings"', "license: international", 'key: "${SECRET_TOKEN_NAME}"', "credential = 000000000000"):
        assert secret_scan.novel_spans(text, []) == [], text


def test_long_quoted_strings_are_no_trouble():
    r = random.Random(4)
    text = 'key = "' + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000)) + '"'
    assert secret_scan.novel_spans(text, []) == [(7, 200_007, "novel")]


def test_caches_are_bounded_by_bytes():
    r = random.Random(5)
    path = public_tokenizers.path("piece_bpe_32k.model")
    for _ in range(40):
        long = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(1000)) for _ in range(100)]
        quality_classifier._TOKENS.rows([t.encode() for t in long])
    assert quality_classifier._TOKENS.bytes <= quality_classifier.CACHE_BYTES + 400_000
    token_counts.pre_token_counts(long, path)
    assert not any(t in token_counts._known(path) for t in long)
    assert [int(n) for n in token_counts.pre_token_counts(long[:3], path)] == [len(token_counts.model(path).encode(t)) for t in long[:3]]


def test_features_are_the_same_after_the_table_begins_anew(monkeypatch):
    texts = [f"word{i} and some Words, {i} times! {'長い' * 30}{i}" for i in range(50)]
    before = [quality_classifier.features(t).tolist() for t in texts]
    monkeypatch.setattr(quality_classifier, "CACHE_BYTES", 300)
    assert [quality_classifier.features(t).tolist() for t in texts] == before
