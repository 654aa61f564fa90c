"""Tokens that the tokenizer file adds are found in the text as it is written, beside words that are put together."""

import numpy as np
import pytest

from tidemark.llm import packing as P

pytest.importorskip("public_tokenizers")

TEXTS = [
    "x <|endoftext|> y", "Foo<|endoftext|>bar! Foo, bar", "<|ENDOFTEXT|> <|EndOfText|>!", "<|startoftext|>Foo, BAR.<|endoftext|>",
    "<|endoftext", "|> endoftext|>", "", None, "  ", "\t<|endoftext|>\n<|endoftext|><|endoftext|>", "foo, bar",
]


@pytest.mark.parametrize("remembered", [P.REMEMBERED, 2])
def test_added_tokens(monkeypatch, remembered):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "_REMEMBER", {})
    monkeypatch.setattr(P, "REMEMBERED", remembered)
    path = P.default_tokenizer()
    whole = Tokenizer.from_file(path)
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    for texts, ids in ((TEXTS, expected), (TEXTS[::-1], expected[::-1]), *(([t], [i]) for t, i in zip(TEXTS, expected, strict=True))):
        assert [np.frombuffer(b, "<u4").tolist() for b in P.token_bytes(texts, path)] == ids
    assert P.token_bytes([], path) == []
