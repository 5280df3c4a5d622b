"""Clustering, vector codes and token files against plain versions and the library, on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from eventloom.llm.registry import default_vocabulary
from eventloom.llm.token_files import LibraryEncoder, count_tokens, find_tokens, placed, read_tokens, token_digests, tokens_at, write_tokens
from eventloom.llm.vector_codes import vector_codes
from eventloom.llm.wavelet import BLOCK, WaveletFile, pack
from eventloom.llm.yinyang import first_assignment, groups_of, reassigned, yinyang_clusters

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v int, n int"


def odd_vectors(rng, n, dim):
    """Grid points (ties), copies, repeated ids, and rows that take no part."""
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim)], int(i % 3) if i % 7 else None, "x", 1, 2) for i in range(n)]
    rows += [(5, rows[5][1], 1, "x", 1, 2), (5, rows[6][1], 1, "x", 1, 2), (None, rows[7][1], None, "x", 1, 2), (n, rows[8][1], 2, "x", 1, 2), (n + 1, [-0.37] * dim, 2, "x", 1, 2)]
    rows += [(n + 2, None, 1, "x", 1, 2), (n + 3, [1.0] * (dim - 1) + [None], 1, "x", 1, 2), (n + 4, [float("nan")] * dim, 1, "x", 1, 2), (n + 5, [float("inf")] + [0.0] * (dim - 1), 1, "x", 1, 2)]
    return rows


def whole(rows):
    ok = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    return ok, [[int(np.floor(1024 * np.float64(np.float32(x)))) for x in r[1]] for r in ok]


def plain_rounds(x, start, rounds):
    """Lloyd's rounds in Python's integers."""
    c = [list(s) for s in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for v in x]
        for j in range(len(c)):
            mine = [v for v, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return c, [nearest(v) for v in x]


@pytest.mark.parametrize("k,groups", [(8, None), (20, 5), (3, 1)])
def test_clusters_are_those_of_plain_rounds(spark, k, groups):
    rng, dim = np.random.default_rng(k), 6
    rows = odd_vectors(rng, 150, dim) + [(900, [1.0] * (dim - 1), 1, "x", 1, 2), (901, [], 1, "x", 1, 2)]
    ok, x = whole(rows)
    ok, x = zip(*[(r, v) for r, v in zip(ok, x) if len(v) == dim])
    key = lambda i: (ok[i][0] is None, hashlib.sha256(f"3:{ok[i][0]}".encode()).hexdigest(), x[i])
    c, found = plain_rounds(x, [x[i] for i in sorted(range(len(x)), key=key)[:k]], 4)
    of = {j: sum(d for d, o in found if o == j) for j in range(k)}
    expected = sorted((-1 if r[0] is None else r[0], j, d, of[j], sum(of.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for r, (d, j) in zip(ok, found))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = yinyang_clusters(df, k=k, rounds=4, dim=dim, groups=groups).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == expected


def test_bounds_spare_distances_and_hold():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (24, 16))
    x = centres[rng.integers(0, 24, 6000)] + rng.integers(-300, 300, (6000, 16))
    old = x[:24].copy()
    group = groups_of(old, 4)
    assert set(group) == set(range(group.max() + 1))
    state = first_assignment(x, old, group)
    computed = 0
    for _ in range(6):
        new = np.array([x[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else old[j] for j in range(24)])
        *state, n = reassigned(x, *state, old, new, group)
        computed, old = computed + n, new
        d = ((x[:, None] - new) ** 2).sum(2)
        at = np.arange(len(x))
        assert (state[0] == d.argmin(1)).all() and (state[1] >= np.sqrt(d[at, state[0]])).all()
        d = np.sqrt(d)
        d[at, state[0]] = np.inf
        assert all((state[2][:, g] <= d[:, group == g].min(1)).all() for g in range(group.max() + 1))
    assert computed < 0.5 * 6 * x.shape[0] * 24


def test_vector_codes_are_those_of_plain_rounds(spark):
    rng, dim, entries = np.random.default_rng(4), 8, 16
    rows = odd_vectors(rng, 120, dim) + [(900, [1.0, 2.0, 3.0], None, "x", 1, 2), (901, [], 1, "x", 1, 2)]
    ok, x = whole(rows)
    x = [v + [0] * (dim - len(v)) for v in x]
    first = sorted(range(len(x)), key=lambda i: (ok[i][0] is None, ok[i][0] or 0, x[i]))[:entries]
    books, codes, errors = [], [""] * len(x), [0] * len(x)
    for p in range(4):
        part = [v[p * 2 : p * 2 + 2] for v in x]
        book, found = plain_rounds(part, [part[i] for i in first], 4)
        books += [str(b) for entry in book for b in entry]
        for i, (d, j) in enumerate(found):
            codes[i] += f"{j:02x}"
            errors[i] += d
    by_label = {}
    for r, e in zip(ok, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    expected = sorted((-1 if r[0] is None else r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(ok, codes, errors))
    got = vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == expected


def test_vectors_without_rows_and_too_large(spark):
    none = spark.createDataFrame([(1, None, 1, "x", 1, 2)], VECTORS)
    for operator in (yinyang_clusters, vector_codes):
        assert operator(none).collect() == [] and operator(none.limit(0)).collect() == []
    few = spark.createDataFrame([(i, [float(i)] * 64, 1, "x", 1, 2) for i in range(3)], VECTORS)
    assert sorted((r.cluster, r.distance) for r in yinyang_clusters(few).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert {r.error for r in vector_codes(few).collect()} == {0}
    with pytest.raises(Exception, match="too large"):
        yinyang_clusters(spark.createDataFrame([(1, [1e30] * 64, 1, "x", 1, 2)], VECTORS)).collect()


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (1000, 50257), (8 * BLOCK + 5, 3), (3 * 8 * BLOCK, 70000)])
def test_wavelet_file(n, top):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, top - 1).astype(np.uint32)
    sizes = np.array([n // 3, 0, n - n // 3])
    raw = pack(ids, np.array([4, 0, -9]), np.array([False, True, False]), sizes)
    f = WaveletFile(lambda at, size: raw[at : at + size])
    assert (f.ids() == ids).all() and [x.tolist() for x in f.documents()] == [[4, 0, -9], [False, True, False], sizes.tolist()]
    at = np.arange(n) if n < 2000 else np.random.default_rng(1).integers(0, n, 500)
    assert (f.access(at) == ids[at]).all()
    for token in {0, 1, 5, top - 1, top + 9, 1 << 20}:
        where = np.flatnonzero(ids == token)
        assert f.count(token) == len(where)
        assert np.array_equal(np.concatenate([np.zeros(0, int), *f.occurrences(token, 1000)]), where)
    with pytest.raises(IndexError):
        f.access(np.array([n]))
    with pytest.raises(ValueError):
        WaveletFile(lambda at, size: b"something else"[at : at + size])


def odd_texts():
    rng = random.Random(8)
    words = ["grau", "Über", "naïve,", "it's", "x.\ny", "a_b", "12", "don't!", "<|endoftext|>", "ab<|endoftext|>cd", "漢字", "🙂", "é", "word###", "(so)", "end.\n", "\tq", "ß&&&", "ⅳ", " ", "\x1c", "\x85z", "ǅ", "a'", "'s", "a.'s"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*texts, "", " ", "  ", "\n", " a", "a ", "a  b", "a\n\nb", " \n ", "x" * 3000, "ab cd " * 60_000, "é" * 2000 + " " * 50 + "z", *("".join(rng.choice(" \nab.'é<|>") for _ in range(30)) for _ in range(300))]


def test_encoder_gives_what_the_library_gives():
    with open(default_vocabulary(), encoding="utf-8") as f:
        e = LibraryEncoder(f.read())
    library = Tokenizer.from_file(default_vocabulary())
    assert e.by_words
    for text in odd_texts():
        assert np.frombuffer(b"".join(e.encode(text)), e.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
    for some in (odd_texts(), odd_texts()[:280], ["a b", "c  d", "e f"], [""]):
        ids, sizes = e.encode_all(pa.array(some))
        expected = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in some]
        assert ids.tolist() == sum(expected, []) and sizes.tolist() == list(map(len, expected))


def test_token_files(spark):
    texts = odd_texts()
    rows = [(7 * i % 1009, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "no id", "x", 1, 2), (5000, None, "x", 1, 2), (3, "more", "x", 1, 2), (3, "more", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, file int, n_tokens int").repartition(4)
    library = Tokenizer.from_file(default_vocabulary())
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows}
    manifest = write_tokens(docs, default_vocabulary(), shard_tokens=800)
    assert manifest.count() > 15
    got = sorted(read_tokens(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((d is not None, d or 0, ids[t]) for d, t, *_ in rows)
    at, last = 0, None
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert last is None or r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    every = np.array([i for r in got for i in r.ids])
    tokens = [0, 220, 50256, 64, 49999, 10**6]
    assert {r.token: r.n for r in count_tokens(manifest, tokens).collect()} == {t: int((every == t).sum()) for t in tokens}
    found = find_tokens(manifest, [50256, 220]).collect()
    assert sorted((r.token, r.position) for r in found) == sorted((t, p) for t in (50256, 220) for p in np.flatnonzero(every == t).tolist())
    begins = {r.start: r.doc_id for r in got}
    assert all(begins[r.position - r.offset] == r.doc_id for r in found)
    asked = [0, 1, len(every) - 1, len(every), -1, 12345, 12345]
    looked = tokens_at(spark, manifest, spark.createDataFrame([(a,) for a in asked], "position long")).collect()
    assert sorted((r.position, r.token) for r in looked) == sorted((a, int(every[a])) for a in asked if 0 <= a < len(every))
    assert placed(manifest).count() == manifest.count()


def test_token_files_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_digests(none, default_vocabulary()).collect() == []
    assert [r.n for r in count_tokens(write_tokens(none, default_vocabulary()), [1]).collect()] == [0]
