"""Words that the packing tokeniser remembers."""

import numpy as np

from tagloom.llm import packing, queries


def test_packing_keeps_a_million_words(monkeypatch):
    encoder, learnt = packing._Encoder(queries.tokenizer_path(queries.WORD_TOKENIZER)), []
    monkeypatch.setattr(encoder, "_ids", lambda new: learnt.append(len(new)) or [np.full(1, 7, np.uint32)] * len(new))
    letters = "abcdefghij"
    word = lambda i: "".join(letters[int(d)] for d in str(i))
    blocks = [" ".join(map(word, range(first, first + 200_000))).encode() for first in range(0, 1_000_000, 200_000)]
    for _ in range(2):
        for block in blocks:
            raw = np.frombuffer(block, np.uint8)
            assert len(encoder.encode(raw, np.array([0, len(raw)]))[0]) == 200_000
    assert sum(learnt) == 1_000_000
