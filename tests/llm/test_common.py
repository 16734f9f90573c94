import random
import re

import numpy as np
import pyarrow as pa

from brindle.llm import common, debruijn


def test_memo_is_bounded_and_right():
    budget = 20_000
    m, rnd = common.Memo(lambda k: (k * 2, "x" * (k % 300)), budget), random.Random(1)

    def size(d):
        return sum(common._bytes(k) + common._bytes(v) + common.SLOT for k, v in d.items())

    for _ in range(5000):
        k = rnd.choice((rnd.randrange(20), rnd.randrange(10_000)))
        assert m[k] == (2 * k, "x" * (k % 300))
        assert size(m) <= budget // 2 and size(m.old) <= budget // 2
    assert m[7][0] == 14


def test_a_process_holds_the_values_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_PER_PROCESS", {"shared": ((), "x")})
    a = common.per_process(("one-words", 1), list)
    assert common.per_process(("one-words", 1), list) is a
    common.per_process("one-more", dict)
    assert common.per_process(("one-words", 2), list) is not a
    common.per_process("two", dict)
    assert set(common._PER_PROCESS) == {"shared", "two"}


def test_rolling_is_the_polynomial():
    x = np.random.default_rng(3).integers(0, 2**63, 200).astype(np.uint64)
    for size in (1, 2, 3, 8, 13, 20, 31, 200):
        want = np.zeros(len(x) - size + 1, np.uint64)
        for j in range(size):
            want = want * debruijn._BASE + x[j : j + len(want)]
        assert (debruijn.rolling(x, size) == want).all()


def test_split_words_at_ascii_white_space():
    texts = ["a b  c", None, "", " \t\n", "x\x1cy\x85z\xa0w\x0bv\x0cu\r", "é a"]
    index, words, before = common.split_words(pa.array(texts, pa.string()))
    got = [[words[i] for i in index[a:b]] for a, b in zip(before, before[1:], strict=False)]
    assert got == [re.findall(common.WORD, t or "") for t in texts]
    assert common.split_words(pa.array([], pa.string()))[0].size == 0
