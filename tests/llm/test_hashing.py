"""Word hashes: one per word, equal for equal words."""

import random

import numpy as np

from flowsight.llm.hashing import Sequence, word_hashes


def test_words_and_their_hashes():
    rng = random.Random(2)
    seen = {}
    texts = []
    for _ in range(300):
        text = "".join(rng.choice("ab é\n\t\x0b\x1c🙂 c\0") for _ in range(rng.randint(0, 80)))
        texts.append((text + rng.choice(["", "x" * 5000, " "])).encode())
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    for w, h in zip([w for t in texts for w in t.split()], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in word_hashes([])] == [0, 0]
    assert word_hashes([b"", b" "])[1].tolist() == [0, 0]


def test_runs_depend_on_their_words_only():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 50, dtype=np.uint64)
    a, b = Sequence(words), Sequence(np.concatenate([words[7:30], words]))
    assert a.runs(np.array([9]), 12) == b.runs(np.array([2]), 12)
    assert a.runs(np.array([9]), 12) != a.runs(np.array([10]), 12)
