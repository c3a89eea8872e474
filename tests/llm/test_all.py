"""Every operator and pipeline stage on odd rows, clashing columns and an empty table."""

import math
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odd_rows import ODD
from tessella.llm import bpe, fingerprints, language_id, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, token_counts

RANKS, PIECES, JSON = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"))


def _classified(d):
    labels = d.sparkSession.createDataFrame([(4, 1, 0), (4, 0, 0), (6, None, 1), (7, 0, 1), (None, 1, 0), (11, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    return quality_classifier.classify(d, quality_classifier.fit(d, quality_classifier.label_grades(labels), 3), 2)


BY_ROW = {
    "classifier": _classified,
    "fingerprints": fingerprints.fingerprint_report,
    "secrets": secret_scan.secret_report,
    "simhash": simhash.simhash_components,
    "bpe": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, RANKS), RANKS),
    "rules": quality_rules.quality_report,
    "lines": line_dedup.dedup_lines,
    "language": language_id.language_report,
    "tokens": lambda d: token_counts.token_counts(d, PIECES),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_odd_rows_keep_their_number_and_ids(odd, name):
    got = Counter(r["doc_id"] for r in BY_ROW[name](odd).select("doc_id").collect())
    assert got == Counter(i for i, _, _ in ODD)


@pytest.mark.parametrize("name", BY_ROW)
def test_empty_table(none, name):
    got = BY_ROW[name](none)
    assert got.count() == 0 and "doc_id" in got.columns


def test_packing_of_odd_rows_and_of_none(odd, none):
    rows = packing.pack(odd, JSON).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(i for i, _, _ in ODD)
    assert packing.pack(none, JSON).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows_and_on_none(spark, odd, none, small, k):
    name, stage = corpus_pipeline.STAGES[k]
    out, empty = stage(spark, odd, small), stage(spark, none, small)
    assert out.count() > 0 and empty.count() == 0
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# Values on odd rows, by plain versions.


def _by_id_and_text(df, odd_rows):
    """Result rows in the order of the odd rows with ids of their own."""
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], []).append(r)
    return [(i, t or "", got[i][0]) for i, t, _ in odd_rows if i is not None and len(got[i]) == 1]


def test_values_of_rows_alone(odd):
    import hashlib

    import sentencepiece
    import tiktoken
    from test_against_brute_force import WORD, plain_base, plain_simhash

    for _, t, r in _by_id_and_text(simhash.simhash_components(odd), ODD):
        assert r["fingerprint"] == f"{plain_simhash(t):016x}"
    for _, t, r in _by_id_and_text(secret_scan.secret_report(odd), ODD):
        assert r["base_sha256"] == hashlib.sha256(plain_base(t).encode()).hexdigest()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})
    for _, t, r in _by_id_and_text(bpe.bpe_round_trip(odd, RANKS), ODD):
        assert bytes(r["decoded"]).decode() == t and len(r["ids"]) == 4 * len(encoding.encode_ordinary(t))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _, t, r in _by_id_and_text(token_counts.token_counts(odd, PIECES), ODD):
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(sp.encode(t)))
    for _, t, r in _by_id_and_text(quality_rules.quality_report(odd), ODD):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r["base_failed"] or len(w) >= 20
    for _, t, r in _by_id_and_text(language_id.language_report(odd), ODD):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in t)) and 0 <= r["score"] <= 1


def test_next_of_odd_rows(odd):
    """Rows without an id come last, of equal ids by hash; the last row's next is the first."""
    got = fingerprints.with_next(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).collect()
    rows = Counter((r["doc_id"], r["text"]) for r in got)
    assert rows == Counter((i, t or "") for i, t, _ in ODD) == Counter((r["next"]["doc_id"], r["next"]["text"]) for r in got)
    top = max(i for i, _, _ in ODD if i is not None)
    assert {r["next"]["doc_id"] for r in got if r["doc_id"] is None} == {None, top}


def test_line_dedup_of_odd_rows_and_ties(spark, odd):
    from test_against_brute_force import plain_dedup

    alone = {i: t for i, t, _ in ODD if i is not None and t is not None and i != 4}
    d = odd.where("doc_id is not null and text is not null and doc_id <> 4")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d).collect()} == plain_dedup(alone)
    # of rows with one id the text's hash decides, and rows alike in both lose the same lines
    rows = spark.createDataFrame([(1, "one line here"), (1, "one line here\nmore"), (1, "one line here"), (None, "more")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(rows).collect())
    assert sum(got.values()) == 4 and got[None, "more", 0] == 1 and sum(v for (_, t, _), v in got.items() if "one line here" in t) in (1, 2)
    assert not any(t.endswith("more") for i, t, _ in got if i == 1)


def test_languages_that_tie_go_by_name(spark):
    d = spark.createDataFrame([(1, "abcd efgh", "xx"), (3, "abcd efgh", "aa"), (4, "abcd efgh", "mm")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(d, language_id.fit(d, F.lit(True))).collect()} == {"aa"}


def test_prediction_is_the_nearest_centroid(spark, docs):
    """Plain cosines over the centroids, text by text; and the same whatever is predicted together."""
    model = language_id.fit(docs, F.lit(True))
    texts = [r["text"] for r in docs.limit(40).collect()] + ["abc", "é", "x" * 5000]
    langs, score, _ = model.predict(texts)
    for t, lang, s in zip(texts, langs, score, strict=True):
        counts = next(language_id.gram_counts([t]))[0][0].tolist()
        x = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        cos = [sum(a * float(b) for a, b in zip(x, c, strict=True)) / norm for c in model.centers]
        best = max(range(len(cos)), key=lambda i: cos[i])
        assert s == pytest.approx(max(0.0, min(1.0, cos[best])), abs=1e-4)
        assert lang == model.langs[best] or cos[best] - max(c for c, k in zip(cos, model.langs, strict=True) if k == lang) < 1e-5


def test_the_fit_of_languages_is_bounded_and_copies_count_once(spark, monkeypatch):
    rows = [(i, "the same text of one language again", "en") for i in range(400)] + [(1000 + i, f"mot numéro {'abcdefgh'[i % 8]} et {i}", "fr") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    seen = []
    real = language_id.cluster
    monkeypatch.setattr(language_id, "cluster", lambda x, *a: (seen.append(len(x)), real(x, *a))[1])
    model = language_id.fit(d, F.lit(True), fit_documents=20)
    assert set(model.langs) == {"en", "fr"} and model.langs.count("en") == 1


def test_short_texts_do_not_fill_a_worker():
    assert max(len(x) for x, _ in language_id.gram_counts(["abc"] * 5000)) <= language_id.BATCH_ROWS


def test_scratch_tables_of_a_scope_go(spark):
    from tessella.llm import common

    with common.scratch_scope() as keep:
        gone = common.materialize(spark.range(3), "scope")
        kept = keep(common.materialize(spark.range(4), "scope"))
    assert kept.count() == 4
    with pytest.raises(Exception, match=".*"):
        gone.count()
    common.discard(kept)
