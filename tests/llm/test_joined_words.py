"""Words that the library encodes together."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from eventloom.llm import token_files
from eventloom.llm.registry import default_vocabulary


def test_unknown_words_are_encoded_together(monkeypatch):
    with open(default_vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(token_files, "CACHE_WORDS", 50)
    monkeypatch.setattr(token_files, "TOGETHER", 7)
    own, rng = token_files.LibraryEncoder(spec), random.Random(3)
    plain = Tokenizer.from_str(spec)
    signs = ["a", "b", "É", "don't", "x1", "9", "\n", "\n\n", "  ", ".", ",", "!?", "'s", "中文", "😀", " ", "Ġ", "<|endoftext|>", "\t", "ß", "ab", "the", "\x1c", " "]
    for _ in range(60):
        texts = ["".join(rng.choice(signs) + " " * (rng.random() < 0.4) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        ids, sizes = own.encode_all(pa.array(texts))
        want = [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    calls, real = [], own.joined
    monkeypatch.setattr(own, "joined", lambda words, library: calls.append(len(words)) or real(words, library))
    own.encode_all(pa.array([" ".join(f"w{'abcdefghij'[n % 10]}{n // 10:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for n in range(2000))]))
    assert sum(calls) > 1500 and len(calls) <= 2  # one call for all, not one a word
