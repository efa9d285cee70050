"""Token ids by chunks against the tokenizer on whole texts, for all of Unicode."""

import random

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm.packing import WordCache, check_tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def wrong(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    return [t for t, a, b in zip(texts, WordCache(PATH)(texts), want, strict=True) if a != b]


def test_every_character_before_a_comma_and_a_stop():
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert wrong([f"a{c}, {c}. x{c}\n{c},{c}" for c in chars if c.isprintable() or c.isspace()]) == []


def test_marks_and_neighbours():
    rng = random.Random(8)
    odd = ["İ", "য়", "क़", "ড়", "שׁ", "יִ", "é", "́", "ΑΣ", "ς", "ﬁ", "ǅ", "ß", "²", "½", "Ⅷ", "é", "ก็", "한", "하", "'s", "don't", "1", "_", "-", ".", ",", " ", "\n", "\t", " ", "a", "B", "<|endoftext|>", "日本", "😀"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    assert wrong([*texts, "R. İ. Kaya geldi.", "হয়, তবে", "क़. ज़,"]) == []


def test_other_tokenizers_raise():
    with pytest.raises(ValueError):
        check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
