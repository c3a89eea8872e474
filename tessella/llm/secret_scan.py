"""Secret scans: fixed patterns, and strings that stay incompressible next to a dictionary.

Base spans come from three patterns. The method adds novelty spans: in a sensitive context (an
assignment to a name such as ``auth`` or ``credential``, a bearer header, a connection string) each
candidate string's marginal cost is measured, which is the zstandard size of context and candidate
less that of the context alone, with the compressor primed by a dictionary and with the surrounding
text. The dictionary holds common words of code and the identifiers that most of the documents
themselves hold. Prose, identifiers, paths and repeated values compress
well; a random key costs nearly all its bits and is reported. The compressor stores the letters of a
short string it has no match for as they are, words too, so what has no digit must also stay dear
under the letter pairs of the same dictionary.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, text_runs

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
#: Runs of a class are matched whole, so asking for the least length in the pattern finds the same.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Names after which, within ``REACH`` characters, a string is a candidate.
SENSITIVE_NAMES = ("password", "passwd", "secret", "token", "auth", "bearer", "credential", "passphrase", "private", "pwd", "session", "signature", "salt", "key", "conn", "cookie", "license")
#: A candidate is what is quoted, of 12 characters at least and with any punctuation, or a bare string
#: of key characters: of 12 after a sign of assignment, of 16 after blanks.
SENSITIVE = re.compile(
    rf"""(?:{"|".join(SENSITIVE_NAMES)})[A-Za-z0-9_-]*["']?(?:\x20*(?::|=>?)\x20*(?:"([^"\s]{{12,}})"|'([^'\s]{{12,}})'|["']?(?:(?:Basic|Bearer|Token|ApiKey|Digest)\x20+)?([A-Za-z0-9+/_.=~-]{{12,}}))|\x20+["']?(?:(?:Basic|Bearer|Token|ApiKey|Digest)\x20+)?([A-Za-z0-9+/_.=~-]{{16,}}))""",
    re.I | re.A,
)
CONTEXT_CHARS = 256
#: Least share of a candidate's own entropy bound (6 bits a character for 64 symbols, 4 for hex)
#: that it must still cost beside the dictionary and its context.
LEAST_SHARE = 0.8
#: Weight of single characters in the code of letter pairs.
PAIR_PRIOR = 60

#: What code and configuration commonly hold; primes the compressor.
CODE_WORDS = (
    "import export return function class public private static const let var self this null none true false "
    "string int float bool array list dict map object value name type key id index count size length data file path "
    "config settings environment production development staging localhost default user username email account "
    "password passwd secret token api_key apikey access_key auth authorization bearer basic session cookie csrf "
    "certificate signature license salt hash sha256 md5 base64 encode decode encrypt decrypt client server host port "
    "database connection string postgres mysql redis mongodb amqp http https www com org net example test sample "
    "placeholder changeme your-key-here xxxxxxxxxxxxxxxx 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ the and of to in is that it with for as was on be by this are from at or an"
)


#: Identifiers: names that are assigned to, called or declared, and words with an inner underscore, hump
#: or dot wherever they stand; and how many of them the dictionary takes, of those in two documents at least.
NAMES = re.compile(r"(?<![A-Za-z0-9_.-])(?:[A-Za-z][A-Za-z_.-]{3,47}(?=[\"']?\x20?[=:(])|(?=[A-Za-z_.-]{4,48}(?![A-Za-z0-9_.-]))[A-Za-z]+(?:[_.][A-Za-z]+|(?<=[a-z])[A-Z][a-z]+)+)", re.A)
LEARNED_NAMES = 2000
BATCH_CHARS = 1 << 20


@lru_cache(maxsize=4)
def _compressor(names: tuple[str, ...] = ()) -> zstandard.ZstdCompressor:
    words = CODE_WORDS.split()
    joined = [f"{a}{s}{b}" for s in ("_", "-", ".") for a, b in zip(words, words[1:], strict=False)]
    content = " ".join([*names[::-1], *joined, *(w.upper() for w in words), *(w.title() for w in words), *words]).encode()
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=held, write_content_size=False, write_checksum=False)


def marginal_bytes(candidate: str, before: str, after: str = "", names: tuple[str, ...] = ()) -> int:
    """Compressed bytes that the candidate adds to its surroundings."""
    around = (before + "\n" + after + "\n").encode()
    size = lambda x: len(_compressor(names).compress(x))
    return size(around + candidate.encode()) - size(around)


@cache
def _pairs() -> tuple[Counter, Counter, Counter]:
    """Counts of characters, of pairs and of pairs' first characters in the dictionary's words, as
    identifiers have them."""
    words = [w for w in CODE_WORDS.split() if w.isalpha() and len(set(w)) < 20]  # without the alphabet
    held = [f(w) for w in words for f in (str.lower, str.lower, str.lower, str.title, str.upper)]
    held += [a + s + f(b) for a, b in pairwise(words) for s, f in (("", str.title), ("_", str.lower), ("-", str.lower), (".", str.lower), ("/", str.lower))]
    pairs = Counter(x for w in held for x in pairwise(w))
    firsts = Counter(a for a, _ in pairs.elements())
    return Counter("".join(held)), pairs, firsts


def pair_bits(candidate: str) -> float:
    """Bits of the candidate, coded by the letter pairs of the dictionary."""
    chars, pairs, firsts = _pairs()
    total = chars.total()
    alone = lambda c: (chars[c] + 1) / (total + 70)
    after = lambda a, c: (pairs[a, c] + PAIR_PRIOR * alone(c)) / (firsts[a] + PAIR_PRIOR)
    return -math.log2(alone(candidate[0])) - sum(math.log2(after(a, c)) for a, c in pairwise(candidate))


def _like_words(candidate: str) -> bool:
    """Whether a string without digits is cheaper by the dictionary's letter pairs than random letters."""
    return _like_short_words(candidate) if len(candidate) <= 48 else _cheap_by_pairs(candidate)


@lru_cache(maxsize=1 << 14)
def _like_short_words(candidate: str) -> bool:
    return _cheap_by_pairs(candidate)


def _cheap_by_pairs(candidate: str) -> bool:
    letters = 26 if candidate in (candidate.lower(), candidate.upper()) else 52
    return pair_bits(candidate) < math.log2(letters) * len(candidate)


def is_novel(candidate: str, before: str, after: str = "", names: tuple[str, ...] = ()) -> bool:
    if len(set(candidate)) < 8:
        return False
    bits = math.log2(10) if candidate.isdigit() else 4 if re.fullmatch(r"[0-9A-Fa-f]+", candidate) else math.log2(62)
    if not re.search(r"[0-9]", candidate):
        letters = candidate
        if not re.fullmatch(r"[A-Za-z+/_.=~-]+", candidate):  # other marks part its words
            letters = re.sub(r"[^A-Za-z]+", "_", candidate).strip("_")
            letters = letters.lower() if letters.isupper() else letters
        if len(letters) < 4 or _like_words(letters):
            return False
    return 8 * marginal_bytes(candidate, before, after, names) >= LEAST_SHARE * bits * len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed."""
    low = text.lower()
    found = [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    if any(x in low for x in ASSIGN_NAMES):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def novel_spans(text: str, taken: list[tuple[int, int, str]], names: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """Spans of the method that overlap none of ``taken``, which come by start."""
    low, out = text.lower(), []
    if not any(x in low for x in SENSITIVE_NAMES):
        return out
    starts, ends = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))
    for m in SENSITIVE.finditer(text):
        s, e = m.span(m.lastindex)
        before = bisect_right(starts, e - 1)  # spans that start before the candidate's end
        if before and ends[before - 1] > s:
            continue
        if is_novel(text[s:e], text[max(0, s - CONTEXT_CHARS) : s], text[e : e + CONTEXT_CHARS], names):
            out.append((s, e, "novel"))
    return out


def common_names(docs: DataFrame, text_col: str = "text", most: int = LEARNED_NAMES) -> tuple[str, ...]:
    """The ``most`` identifiers that most documents hold, most frequent first, ties by name; the same for
    any partitioning. Names that look random (keys of letters) are left out. Documents are counted, so
    a name that one text repeats counts once; repeated rows are documents each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            found = Counter(x for t in batch.column("text").to_pylist() for x in set(NAMES.findall(t)))
            kept = [x for x in found if _like_words(x)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([found[x] for x in kept], pa.int64())], ["name", "n"])

    names = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    top = names.where("n > 1").orderBy(F.desc("n"), "name").limit(most)  # the feature: a dictionary of bounded size
    return tuple(r["name"] for r in top.collect())


def _joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] | None = None) -> DataFrame:
    """Per input row: doc_id, spans array<struct<kind,start,end>> in code points (end exclusive),
    base_sha256 (of the base spans alone).

    ``names`` are the dictionary's learned ones, of :func:`common_names` over ``docs`` by default.
    Base spans stay whatever the method finds. Null and empty texts have no spans; rows without a
    doc_id and repeated rows are scanned like others; spans with one start come in the order of
    ``KINDS``; an empty table gives an empty result; other columns are not looked at. Whole texts
    are scanned, of any length.
    """
    d = id_and_text(docs, id_col, text_col)
    names = common_names(d) if names is None else names
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            spans, digests = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                both = sorted(base + novel_spans(text, base, names), key=lambda x: (x[0], KINDS.index(x[2])))
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k in both])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(digests, pa.string())], ["doc_id", "spans", "base_sha256"]
            )

    return d.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>, base_sha256 string")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and joined spans of :func:`secret_spans`, a row for each input row."""
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return secret_spans(docs, id_col, text_col).select(
        "doc_id", count("assign"), count("access"), count("hex"), count("novel"), "base_sha256", F.concat_ws(",", joined).alias("spans")
    )


def mask_secrets(docs: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The documents with every span of :func:`secret_spans` replaced by its kind in angle
    brackets; overlapping spans are one, named by the first. All rows and columns stay, columns of
    any name, repeated rows too; a null text stays null and an empty one empty; an empty table
    gives an empty result. Whole texts, of any length."""
    names = common_names(docs) if names is None else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            at = batch.schema.get_field_index("text")
            texts = [_mask(t, names) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _mask(text: str, names: tuple[str, ...]) -> str:
    out, done = [], 0
    base = base_spans(text)
    for s, e, kind in sorted(base + novel_spans(text, base, names)):
        if s >= done:
            out += [text[done:s], f"<{kind}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])
