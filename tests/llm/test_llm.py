"""Each operator against a brute-force version or an exact round trip, with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import suffix_dedup
from eventloom.llm.ann_multi_index import approximate_top_k
from eventloom.llm.bpe import bpe_round_trip
from eventloom.llm.html_extract import best_region, extract_main_text
from eventloom.llm.jaccard_join import jaccard_components, one_of_each_group
from eventloom.llm.mixing import edf_period, in_mixed_order, pfair_mix, phases
from eventloom.llm.quality_rules import quality_scores
from eventloom.llm.registry import default_vocabulary
from eventloom.llm.sharding import lpt_shards, schedule
from eventloom.llm.suffix_dedup import remove_repeats, repeat_digest, repeated_starts, suffix_array, without_repeats
from eventloom.llm.topk_cover_tree import dual_search, exact_top_k
from eventloom.llm.toxicity import fit_examples, toxicity_scores, without_toxic

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, shard int, key long, token long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, shared passages, repeats inside a text, nulls, empties, short texts and one long text."""
    rng = random.Random(4)
    base = [" ".join(words(rng, rng.randint(30, 120))) for _ in range(60)]
    passage = " ".join(words(rng, 60))
    texts = list(base) + [base[0]] * 5
    for t in base[:20]:
        for _ in range(3):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [b + " " + passage for b in base[20:26]] + [passage * 3, None, "", "   ", "one two", "one two", "é漢字🙂 " * 60, "x" * 5000]
    texts.append(" ".join(words(rng, 20000)))
    rows = [(i, t, "en", f"src{0 if i % 3 == 0 else i % 7}", len(t or ""), 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [(None, base[3], None, None, None, 1, 2, 3, 4), (7, texts[7], "en", "src0", 1, 1, 2, 3, 4)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    table = {c: c + 32 for c in range(65, 91)}
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_components(spark, docs, none):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    expected = Counter((doc, len(s), least.get(find(i)) if s else doc) for i, (doc, s) in enumerate(rows))
    got = jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == expected
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = len({find(i) for i, (_, s) in enumerate(rows) if s}) + len({d for d, s in rows if not s})
    assert kept.count() == groups
    assert jaccard_components(none).count() == 0


def test_jaccard_links_of_two_guests(spark):
    """x and y of one class of size link; z, of the class above and no partner of theirs, holds the shingles of both."""
    rng, rows = random.Random(11), []
    for g in range(150):
        w = [f"g{g}w{i}" for i in range(82)]
        y = list(w)
        for at in (24, 56):
            y[at] = f"g{g}y{at}"
        z = w + y[20:29] + y[52:61] + [f"g{g}z{i}" for i in range(20)]
        texts = [" ".join(t) for t in (w, y, z)]
        a, b, c = map(shingles, texts)
        assert 100 * len(a & b) >= 75 * len(a | b) and a | b < c and 100 * len(a) < 75 * len(c) and 100 * len(b) < 75 * len(c)
        rows += [(3 * g + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x for x in range(0, 450, 3) if (got[x], got[x + 1], got[x + 2]) != (x, x, x + 2)] == []


def test_suffix_array_and_repeats():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 50))] * rng.choice([1, 2]) + [0]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    regions = [b"abcabcabc", b"xxabcab", b"zzzz"]
    count = Counter(r[i : i + 4] for r in regions for i in range(len(r) - 3))
    assert [x.tolist() for x in repeated_starts(regions, np.ones(3, int), 4)] == [[i for i in range(len(r) - 3) if count[r[i : i + 4]] > 1] for r in regions]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int)) == 1) + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 1])
def test_remove_repeats(docs, none, limit, monkeypatch):
    rows = docs.where("length(text) < 6000 or text is null").select("doc_id", "text")
    pairs = [tuple(r) for r in rows.collect()]
    expected = Counter((d, *x) for (d, _), x in zip(pairs, brute_repeats([t for _, t in pairs], 200)))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    monkeypatch.setattr(remove_repeats, "__defaults__", (200, "doc_id", "text", limit))
    assert Counter(map(tuple, repeat_digest(rows).collect())) == expected
    if limit > 1:
        cut = without_repeats(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()
        assert repeat_digest(none).count() == 0


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(default_vocabulary())
    odd = docs.sparkSession.createDataFrame([(900, "a<|endoftext|>b  \n\n c'll 'S 12é 　x"), (901, "aaaa" * 900), (902, "- = !" * 300)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    expected = []
    for doc, text in map(tuple, both.collect()):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        expected.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert Counter(map(tuple, bpe_round_trip(both, default_vocabulary()).collect())) == Counter(expected)
    assert bpe_round_trip(none, default_vocabulary()).count() == 0


def test_sharding(docs, none):
    rows = lpt_shards(docs, shards=4).collect()
    assert len(rows) == docs.count()
    loads, slots, homes = Counter(), {}, {}
    for r in rows:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert homes.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert schedule([(1, 5), (2, 4), (3, 3), (4, 3)], 2) == {1: 0, 2: 1, 3: 1, 4: 0}
    assert lpt_shards(none).count() == 0


def test_mixing_stays_within_a_block(docs, none):
    for parts in ({"a": 1, "b": 2, "c": 5}, {"a": 50, **{f"s{i}": 1 for i in range(50)}}):
        done, total = Counter(), sum(parts.values())
        for slot, (s, k, release, deadline) in enumerate(edf_period(parts)):
            assert done[s] == k and release <= slot < deadline
            done[s] += 1
            assert all(abs(done[x] * total - (slot + 1) * parts[x]) < total for x in parts)
    runs = phases({"a": 700, "b": 3, "c": 40}, {"a": 1.0, "b": 1.0, "c": 2.0})
    assert sum(r["cycles"] * sum(r["parts"].values()) for r in runs) == 743
    mixed = pfair_mix(docs, block_rows=2).collect()
    assert len(mixed) == docs.count() and len({r.mix_position for r in mixed}) == len(mixed)
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in mixed)
    assert in_mixed_order(docs).columns == docs.columns and in_mixed_order(none).count() == 0


def test_mixing_keeps_the_exact_targets(spark, monkeypatch):
    """In the first phase, over many times 1,024 slots and plans in several parts, each source stays within a block of its true target."""
    monkeypatch.setattr("eventloom.llm.mixing.PLAN_ROWS", 1000, raising=False)
    sizes = {"hot": 4000, "rare": 300} | {f"s{i}": 900 + 37 * i for i in range(6)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {"hot": 0.4999, "rare": 0.0001} | {f"s{i}": 0.5 / 6 for i in range(6)}):
        exact = {s: Fraction((weights or {}).get(s) or n**0.5) for s, n in sizes.items()}
        total, done = sum(exact.values()), Counter()
        mixed = sorted(pfair_mix(table, weights, block_rows=1).select("mix_slot", "source", "mix_release", "mix_deadline").collect())
        assert [r.mix_slot for r in mixed] == list(range(len(rows)))
        assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in mixed)
        for slot, r in enumerate(mixed):
            done[r.source] += 1
            assert all(abs(done[s] - exact[s] * (slot + 1) / total) < 1 for s in sizes)
            if done[r.source] == sizes[r.source]:
                break
        assert slot > 4000


def test_mixing_of_many_sources(spark):
    table = spark.range(1800).selectExpr("id doc_id", "concat('s', id % 600) source")
    mixed = pfair_mix(table, block_rows=2).collect()
    assert len({r.doc_id for r in mixed}) == len({r.mix_position for r in mixed}) == 1800
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in mixed)


def test_pipeline_returns_the_place_in_the_mix(spark, tmp_path):
    """Read again from several files of falling and rising size, the rows still tell the order that keeps the targets."""
    sizes = {"a": 600, "b": 200, "c": 100}
    ids = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    table = spark.createDataFrame([(i, f"text {i} " * (1 + i % 40), s) for i, s in ids], "doc_id long, text string, source string")
    mixed = in_mixed_order(table, block_rows=1).cache()
    expected = {r.doc_id: r.mix_position for r in pfair_mix(table, block_rows=1).collect()}
    assert mixed.rdd.getNumPartitions() > 1
    mixed.write.parquet(str(tmp_path / "mixed"))
    rows = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert {r.doc_id: r.mix_position for r in rows} == expected
    source, done, total = dict(ids), Counter(), sum(n**0.5 for n in sizes.values())
    for slot, r in enumerate(sorted(rows, key=lambda r: r.mix_position)):
        done[source[r.doc_id]] += 1
        assert all(abs(done[s] - n**0.5 * (slot + 1) / total) < 1 for s, n in sizes.items())
        if done[source[r.doc_id]] == sizes[source[r.doc_id]]:
            break
    assert r.mix_position > 100


def vectors(spark, n=260, dim=8):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(n)]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1020, None), (1040, [1.0, None] + [0.0] * (dim - 2)), (1060, [float("nan")] * dim), (1080, [0.0] * dim), (1100, [float("inf")] + [0.0] * (dim - 1))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


def test_exact_top_k(spark):
    df, rows = vectors(spark)
    good = [(i, np.floor(64 * np.array(v))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    expected = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:20]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, exact_top_k(df).collect())) == sorted(expected)
    assert exact_top_k(df.limit(0)).count() == 0
    assert [len(at) for at, _ in dual_search(np.ones((2, 3)), np.array([1, 2]), np.ones((500, 3)), np.arange(500), 5)] == [5, 5]


def test_approximate_top_k(spark):
    df, rows = vectors(spark, 800)
    good = {i: np.array(v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    got = approximate_top_k(df).collect()
    hits = total = 0
    for q, x in good.items():
        if q % 20 == 0:
            best = {i for _, i in sorted((-float(x @ y), i) for i, y in good.items() if i != q)[:20]}
            mine = [r for r in got if r.query_id == q]
            assert sorted(r["rank"] for r in mine) == list(range(1, 21))
            assert all(abs(r.score - float(x @ good[r.vec_id])) < 1e-12 for r in mine)
            hits, total = hits + len(best & {r.vec_id for r in mine}), total + 20
    assert hits / total >= 0.9
    assert approximate_top_k(df.limit(0)).count() == 0


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Menu</a></li></ul></nav>"
        "<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>One   two &copy;<p>three\n four</p><aside>side words here</aside><p>End.</p></article>"
        "<div class='comments'><p>a reader said this</p></div><footer>foot</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "plain text only", 0)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(df).collect()}
    text = "Head & line\nOne two ©\nthree four\nEnd."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("plain text only", 15)}
    assert best_region([-1, 2, -1, 3, -5, 1]) == (1, 4) and best_region([-1.0]) == (0, 0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        toxic, bad = int(rng.random() < 0.3), int(rng.random() < 0.3)
        w = [("x" + "".join(rng.choice("abcdefgh") for _ in range(6))) for _ in range(40)]
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vilest", "vilely", "rotter"])
        text = " ".join(w)
        rows.append((i, text.upper() + "!!!" if bad else text, 1 - bad, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(2).cache()


def test_toxicity_and_quality_on_held_out_rows(spark, labelled):
    documents, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality", "toxic")
    odd = documents.unionByName(spark.createDataFrame([(5000, None), (None, "")], documents.schema))
    truth = {r.doc_id: r for r in labels.collect()}
    model = fit_examples(documents, labels)
    for got, label in ((toxicity_scores(odd, model), "toxic"), (quality_scores(odd, labels, documents), "quality")):
        rows = got.collect()
        assert len(rows) == 902 and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert len(held) > 200 and sum(r.predicted == truth[r.doc_id][label] for r in held) / len(held) > 0.97
    left = without_toxic(odd, model)
    assert left.columns == odd.columns and 600 < left.count() < 700
    nothing = labels.limit(0)
    assert toxicity_scores(odd, fit_examples(documents, nothing)).where("predicted = 1").count() == 0
    assert quality_scores(odd, nothing, documents).where(F.col("score").isNull()).count() == 0
    assert toxicity_scores(documents.limit(0), model).count() == 0 and quality_scores(documents.limit(0), labels, documents).count() == 0
