"""A text far longer than a block gives what its parts give."""

import random
import re

import numpy as np

from codeloom.llm import ctw, textbuf, toxicity
from codeloom.llm.textbuf import block_of

W = re.compile(r"[^\x20\x09-\x0D]+")


def text(n):
    rng = random.Random(1)
    return " ".join(rng.choice(["alpha", "Beta", "gämma", "d" * 300, "e\nf"]) for _ in range(n))


def test_hashes_do_not_depend_on_the_stretch(monkeypatch):
    t = text(4000)
    want = block_of([t]).word_hashes()
    monkeypatch.setattr(textbuf, "BLOCK_BYTES", 1000)
    assert (block_of([t]).word_hashes() == want).all()
    words = [w.lower() if w.isascii() else w for w in W.findall(t)]
    assert len(set(want.tolist())) == len(set(words))


def test_contexts_in_stretches():
    b = block_of([text(3000)])
    whole, _ = ctw.contexts(b)
    parts = [k for k, _ in ctw.pieces(b, most=777)]
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all()


def test_many_megabytes_in_one_text():
    t = "word and another word here\n" * 200_000
    b = next(textbuf.blocks(iter([__import__("pyarrow").record_batch({"text": [t, "x"]})])))
    assert b.n == 1 and len(b.words()[0]) == 1_000_000 and len(set(b.word_hashes().tolist())) == 4


def test_grams_by_hand():
    b = block_of(["abcd Abcd xy"])
    w = toxicity.Words.of(b)
    counts = np.diff(w.gram_first)
    assert sorted(counts.tolist()) == [3, 4] and len(w.hashes) == 2
