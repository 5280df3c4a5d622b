"""Words of a slice and their cache."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from eventloom.llm import token_files
from eventloom.llm.registry import default_vocabulary


def spec():
    with open(default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def words_of(n, rng):
    return ["".join(rng.choice("abcdeilnorstüé") for _ in range(rng.randint(7, 11))) for _ in range(n)]


def test_a_later_slice_asks_the_library_for_new_words_only(monkeypatch):
    """Whatever marks and lines' ends stand at a word, its letters are encoded once."""
    own, plain, rng = token_files.LibraryEncoder(spec()), Tokenizer.from_str(spec()), random.Random(5)
    known = words_of(3000, rng)
    own.encode_all(pa.array(["x " + " ".join(known)]))
    asked, real = [], own.joined
    monkeypatch.setattr(own, "joined", lambda words, library: asked.extend(words) or real(words, library))
    texts = ["x " + " ".join(w + rng.choice(["", ".", ",", "?!", "###", ".\nthe", "\nthe"]) for w in rng.sample(known, 500)) for _ in range(5)] + ["x brandnew"]
    ids, sizes = own.encode_all(pa.array(texts))
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert asked == ["brandnew"]


def test_words_that_leave_the_cache_are_encoded_again(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_WORDS", 100)
    own, plain, rng = token_files.LibraryEncoder(spec()), Tokenizer.from_str(spec()), random.Random(6)
    known = words_of(900, rng) + ["y" * 200, "12.", "漢字,"]
    for n in range(12):
        texts = [" ".join(rng.sample(known, 60)) for _ in range(3)]
        ids, sizes = own.encode_all(pa.array(texts, pa.string() if n % 2 else pa.large_string()))
        want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
        kept = own.kept[" "]
        assert len(kept.words) == len(kept.ids) == len(kept.used) <= 200 and "y" * 200 not in kept.words.to_pylist()


def test_slices_are_even(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 1000)
    for rows, slices in ((10, 1), (104, 1), (205, 2), (1000, 10)):
        texts = pa.record_batch({"d": list(range(rows)), "t": ["x" * 10] * rows})
        cut = [len(b) for b in token_files.pieces_of(texts, 1, token_files.even(texts.column(1)))]
        assert len(cut) == slices and max(cut) - min(cut) <= 2
