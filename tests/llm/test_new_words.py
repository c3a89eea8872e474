"""Texts whose words are all new to a worker: merged together, with the ids that one slice alone has."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe, packing
from tessella.llm.common import ByteBound

RANKS, JSON = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"))


def _words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("aabcdeeilnorstuéñ漢😀'9!", k=r.randint(1, 20))) for _ in range(n)]


def test_new_words_take_no_loop_each(monkeypatch):
    """Only slices that are tokens as they are, or long ones, are merged one by one."""
    vocabulary, alone = packing._vocabulary(JSON)[0], []
    merge = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: (alone.append(piece), merge(piece, ranks))[1])
    texts = [" ".join(_words(seed, 400)) for seed in range(5)] + ["", "x" * 300, " "]
    held = bpe.slice_cache(vocabulary)
    got = [ids.tolist() for ids, _, _ in bpe.encode_slices(texts, held)]
    t = Tokenizer.from_file(JSON)
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert all(x in vocabulary or len(x) > 64 for x in alone) and len(held) > 5 * len(alone)


@pytest.mark.parametrize("seed", range(3))
def test_merged_together_as_alone(seed):
    ranks = bpe.ranks(RANKS)
    words = [x for x in {w.encode() for w in _words(seed, 3000)} if x not in ranks]
    words += [b"a" * 63, b"ab" * 32, b"\xff\xfe\xff", " 　漢".encode()]
    ids, size = bpe.merge_together(words, bpe.PairRanks(ranks))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [bpe.merge(x, ranks) for x in words]
    ids, size = bpe.merge_together([], bpe.PairRanks(ranks))
    assert len(ids) == len(size) == 0


def test_values_made_together_are_bounded():
    held = ByteBound(lambda k: k * 2, lambda k, v: 10, 100, lambda keys: [k * 2 for k in keys])
    r = random.Random(4)
    for n in (0, 1, 3, 5, 6, 40, 2, 300):
        keys = [str(i) for i in r.sample(range(1000), n)]
        assert held.all_of(keys) == [k * 2 for k in keys] and held.held <= 50
        assert len(held) + len(held.old) <= 10
    assert held["7"] == "77"
