"""Ids of texts that hold an added token, against a tokenizer that is loaded afresh."""

import public_tokenizers
from tokenizers import Tokenizer

from sparkqa.llm import packing


def test_added_tokens():
    path = public_tokenizers.path(packing.VOCABULARY)
    fresh, e = Tokenizer.from_file(path), packing.Encoder.of(path)
    assert 50256 in fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids
    for t in ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "a  b\n c'll <|ENDOFTEXT|>", "日本 <|endoftext|> a"]:
        ids = fresh.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == b"".join(i.to_bytes(4, "little") for i in ids)
