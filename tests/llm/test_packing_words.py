"""Ids that are put together from words and marks are the tokenizer's own; words that differ by case or mark are learned once."""

import numpy as np
import pytest

from tidemark.llm import packing as P

pytest.importorskip("public_tokenizers")

AWKWARD = [
    "Foo foo, FOO!! foo... (foo) foo's DON'T!'s a.b,c d+!! x_. 3,4. %%% é, É! ***", "J̌, J̌ T̈! é. Å",
    "İstanbul, École; ΣΣ. Kelvin x,y z ß! ŉn?", "a!́ b. 😀, c\x1cd", "", None, "WORD" * 50 + ".",
]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = P.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = [t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t for t in AWKWARD]
    for text, ids in zip(texts, P.token_bytes(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_case_and_marks_are_learned_once(monkeypatch):
    monkeypatch.setattr(P, "_REMEMBER", {})
    P.token_bytes(["Plover plover, PLOVER! plover. plover;"], P.default_tokenizer())
    known = P._REMEMBER[P.default_tokenizer()]
    assert set(known) == {b"plover", b",", b"!", b".", b";"}
