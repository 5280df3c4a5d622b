"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Reading a piece byte by byte, the transducer keeps for each prefix the one token that its encoding ends
with: the longest vocabulary token t such that the encoding of what stands before t ends with a token u and
merging the bytes of u and t gives u, t again. Tokens are never longer than `lookahead` bytes (computed from
the merge list), so each later encoding passes through one of the last `lookahead` prefixes; a token on the
paths of all of them is stable and is emitted. What is kept stays within a window that does not grow with
the text. Decoding is an incremental byte-to-text state machine.

Nulls: a null text is the empty text: no tokens. An empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import begin, give_back, kept_in_worker, pieces_of

#: The byte-level split of the public vocabulary (a fixed value of its file format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Two white-space characters side by side.
DOUBLE = re.compile(r"\s\s")
#: Entries of each of a cache's two generations, pairs of tokens kept, and the longest string kept, in characters.
CACHE_ENTRIES, CACHE_PAIRS, CACHE_CHARS = 120_000, 250_000, 48
#: Letters before this one are told by str.isalpha as by the split; beyond, versions of Unicode may differ.
LATIN_END = "\u0250"
#: Marks that end a word often; a piece of their own after letters.
STOPS = frozenset(".,;:!?")
#: Tokens handed to the decoder's state machine at a time.
DECODE_TOKENS = 8192


def byte_letters() -> dict[str, int]:
    """The file format's letter for each byte: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class Recent:
    """A bounded cache in two generations: when the new one is full, it takes the old one's place."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self.new) >= CACHE_ENTRIES:
                self.old = self.new.copy()
                self.new.clear()
            self.new[key] = value


class Transducer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: str):
        """spec: the text of a tokenizer's JSON file."""
        d = json.loads(spec)
        letters = byte_letters()
        to_bytes = lambda word: bytes(letters[c] for c in word)
        vocab = {to_bytes(w): i for w, i in d["model"]["vocab"].items() if all(c in letters for c in w)}
        self.bytes_of = {i: b for b, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        self.rank = {(vocab[to_bytes(a)], vocab[to_bytes(b)]): (r, vocab[to_bytes(a + b)]) for r, (a, b) in enumerate(merges)}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens") or []}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.made: dict[int, tuple[int, int, int]] = {}  # a token's last merge and its rank
        self.usable = {}
        for b, i in vocab.items():
            if len(b) == 1 or self.merged(b) == [i]:
                self.usable[b] = i
                if len(b) > 1:
                    self.made[i] = self.joined
        self.spines: tuple[dict, dict] = ({}, {})
        self.lookahead = max(map(len, self.usable))
        self.endings = ahocorasick.Automaton()
        for b, i in self.usable.items():
            self.endings.add_word(b.decode("latin-1"), (len(b), i))
        self.endings.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words, self.pieces = Recent(), Recent()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the pair of least rank, leftmost first, until none is left. For short pieces."""
        ids, rank, none = [self.single[b] for b in piece], self.rank, (1 << 60, -1)
        self.joined = None
        while len(ids) > 1:
            found = [rank.get(p, none) for p in zip(ids, ids[1:])]
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            self.joined = (ids[at], ids[at + 1], best[0])
            ids[at : at + 2] = [best[1]]
        return ids

    def spine(self, t: int, right: bool) -> list[tuple[int, int]]:
        """A token's parts along one edge, each with the rank of the merge that takes it up."""
        known = self.spines[right].get(t)
        if known is None:
            known, upper, x = [], 1 << 60, t
            while True:
                known.append((x, upper))
                if x not in self.made:
                    break
                a, b, upper = self.made[x]
                x = b if right else a
            self.spines[right][t] = known
        return known

    def stands(self, u: int, t: int) -> bool:
        """Whether u, t is the encoding of its own bytes: no merge across the border comes before those that hide it."""
        known = self.pairs.get((u, t))
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known, rank = True, self.rank
            for x, over in self.spine(u, True):
                for y, above in self.spine(t, False):
                    r = rank.get((x, y))
                    if r is not None and r[0] < over and r[0] <= above:
                        known = False
            self.pairs[u, t] = known
        return known

    def stream(self, piece: bytes) -> Iterator[int]:
        """The ids of one piece, each as soon as it is stable."""
        look, pairs, stands = self.lookahead, self.pairs.get, self.stands
        ends: list[tuple[int, int]] = [(-1, 0)]  # for the prefix of base + n bytes: its last token, and its start
        base, sent, done = 0, 0, 0  # ends[0] is the prefix of `base` bytes; all before `sent` is emitted
        # The automaton yields, byte by byte, every token that ends there, the longest first.
        for at, (size, t) in self.endings.iter(piece.decode("latin-1")):
            start = at + 1 - size
            if at < done or start < base:
                continue
            if at > done:  # no encoding ends in between
                ends.extend((-2, n) for n in range(done + 1, at + 1))
                done = at
            u = ends[start - base][0]
            if start and (u < 0 or not ((known := pairs((u, t))) or known is None and stands(u, t))):
                continue
            ends.append((t, start))
            done = at + 1
            if done - sent >= 4 * look:
                low, marks = sent, {n for n in range(done - look + 1, done + 1) if ends[n - base][0] >= 0}
                while len(marks) > 1:  # the paths back meet at a prefix that every later encoding has
                    last = max(marks)
                    marks.discard(last)
                    marks.add(ends[last - base][1])
                meet = marks.pop() if marks else low
                if meet > sent:
                    yield from self.back(ends, base, sent, meet)
                    sent = meet
                    del ends[: meet - base]
                    base = meet
        yield from self.back(ends, base, sent, len(piece))

    @staticmethod
    def back(ends: list[tuple[int, int]], base: int, sent: int, to: int) -> list[int]:
        out = []
        while to > sent:
            t, to = ends[to - base]
            out.append(t)
        return out[::-1]

    def window(self, piece: bytes) -> list[int]:
        """As stream, for a piece within the window: nothing has to be emitted before its end."""
        pairs, stands, done = self.pairs.get, self.stands, 0
        last, start_of = [-2] * (len(piece) + 1), [0] * (len(piece) + 1)
        last[0] = -1
        for at, (size, t) in self.endings.iter(piece.decode("latin-1")):
            if at < done:
                continue  # a longer token ends here
            start = at + 1 - size
            if start:
                u = last[start]
                if u < 0:
                    continue
                known = pairs((u, t))
                if known is False or known is None and not stands(u, t):
                    continue
            done = at + 1
            last[done], start_of[done] = t, start
        out, to = [], len(piece)
        while to:
            out.append(last[to])
            to = start_of[to]
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        """A piece's ids as little-endian 32-bit integers."""
        raw = piece.encode("utf-8", "replace")
        whole = self.usable.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        return array("I", self.window(raw) if len(raw) < 4 * self.lookahead else self.stream(raw)).tobytes()

    def spaced(self, word: str) -> bytes:
        """The ids of a space and the word after it, which holds no space itself."""
        got = self.words.get(word)
        if got is None:
            if word.isalpha() and max(word) < LATIN_END:  # one piece
                got = self.packed(" " + word)
            elif word[-1:] in STOPS and (rest := word[:-1]).isalpha() and max(rest) < LATIN_END:  # a piece and a mark
                got = self.spaced(rest) + self.piece(word[-1])
            else:
                got = b"".join([self.spaced(p[1:]) if len(p) > 1 and p[0] == " " and p != " " + word else self.piece(p) for p in self.split.findall(" " + word)])
            self.words.put(word, got)
        return got

    def piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.packed(piece)
            self.pieces.put(piece, got)
        return got

    def encode(self, text: str) -> bytes:
        """A whole text's ids, packed."""
        if self.cut is None:
            parts = [text]
        else:
            parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif DOUBLE.search(part):
                out.extend(map(self.piece, self.split.findall(part)))
            elif part:
                # Where white space never doubles, the split has a border before each space.
                first, *words = part.split(" ")
                out.extend(map(self.piece, self.split.findall(first)))
                got = list(map(self.words.new.get, words))
                if None in got:
                    got = [self.spaced(w) if g is None else g for w, g in zip(words, got)]
                out += got
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, in parts, through the state machine of the incremental UTF-8 decoder."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), DECODE_TOKENS):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids[at : at + DECODE_TOKENS].tolist())))
        yield machine.decode(b"", True)


_loaded: dict[str, Transducer] = kept_in_worker("bpe")


def transducer(spec: str) -> Transducer:
    """One transducer a worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        give_back()
        _loaded[key] = Transducer(spec)
        give_back()
    return _loaded[key]


def bpe_round_trip(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, position_col: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, and the ids themselves and a long position on demand.

    vocabulary: a driver-side path to the tokenizer's JSON file; its bounded text (a few MB) is broadcast.
    """
    import pyarrow as pa

    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("bpe")
        t = transducer(spec.value)
        for batch in (x for b in batches for x in pieces_of(b, 1)):
            counts, ids_sha, text_sha, kept = [], [], [], []
            for text in batch.column(1):
                packed = t.encode(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4")
                decoded = hashlib.sha256()
                for part in t.decode(ids):
                    decoded.update(part.encode("utf-8"))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(decoded.hexdigest())
                if with_ids:
                    kept.append(ids.astype("int32"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            if position_col:
                columns.append(batch.column(2))
                names.append(position_col)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        t.words.old, t.pieces.old = {}, {}
        give_back()

    passed = [f"cast(`{position_col}` as long) `{position_col}`"] if position_col else []
    narrow = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text", *passed)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (f", `{position_col}` long" if position_col else "")
    return narrow.mapInArrow(run, schema)
