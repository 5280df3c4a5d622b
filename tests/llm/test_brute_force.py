"""Operators against plain versions of themselves, clashing names, and each stage of the pipeline on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm.ann_multi_index import approximate_top_k
from eventloom.llm.html_extract import Weights, best_region, learn_weights, main_text
from eventloom.llm.jaccard_join import one_of_each_group
from eventloom.llm.mixing import in_mixed_order, pfair_mix
from eventloom.llm.quality_rules import compile_rules, fit_rules, quality_scores
from eventloom.llm.sharding import lpt_shards
from eventloom.llm.suffix_dedup import remove_repeats, without_repeats
from eventloom.llm.topk_cover_tree import exact_top_k
from eventloom.llm.toxicity import Examples, fit_examples, terms_of


def test_nearest_examples_by_brute_cosine():
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    marks, plain = [word("abcdef", 9) for _ in range(24)], [word("ghijkl", 5) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = rng.choices(plain, k=30) + (rng.sample(marks, rng.randint(1, 4)) if toxic else [])
        texts.append(" ".join(w))
        labels.append(int(toxic))
    model = Examples(list(range(1000, 1600)), texts, np.array(labels))
    assert len(model.term) > 10

    def vector(text):
        bag = {t: n for t, n in terms_of(text).items() if t in model.term}
        v = {t: (1 + math.log(n)) * model.idf[model.term[t]] for t, n in bag.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = [vector(t) for t in texts]
    for text in [texts[0], texts[3], "nothing of it", "", " ".join(marks[:6] * 2), marks[0], *texts[300:330]]:
        v = vector(text) if any(t in model.term for t in terms_of(text)) else {}
        cosines = [(sum(x * k.get(t, 0) for t, x in v.items()), -(1000 + n)) for n, k in enumerate(known)]
        expected = sorted((c for c in cosines if c[0] > 0), reverse=True)
        score, ids, found = model.score(text)
        assert 0 <= score <= 1 and len(ids) == min(model.nearest, len(expected))
        assert np.allclose(found, [c for c, _ in expected[: len(ids)]])
        exact = {-i: c for c, i in cosines}
        assert all(abs(exact[i] - c) < 1e-9 for i, c in zip(ids, found))
        ties = [(round(c, 9), i) for c, i in zip(found, ids)]
        assert ties == sorted(ties, key=lambda x: (-x[0], x[1]))


def test_rules_compiled_equal_rules_evaluated(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5) | (x[:, 3] > 1.2)).astype(int)
    rules, intercept = fit_rules(x, y)
    assert rules
    df = spark.createDataFrame([tuple(map(float, r)) + (n,) for n, r in enumerate(x)], "a double, b double, c double, d double, n int")
    got = [r.s for r in df.select("n", compile_rules(rules, intercept, list("abcd")).alias("s")).orderBy("n").collect()]
    for row, s in zip(x, got):
        total = intercept + sum(w for rule, w in rules if all(row[f] > cut if greater else row[f] <= cut for f, greater, cut in rule))
        assert abs(s - 1 / (1 + math.exp(-total))) < 1e-12
    assert np.mean((np.array(got) >= 0.5) == (y == 1)) > 0.95


def test_sharding_is_longest_first(spark):
    """With every group by itself, the loads are those of the plain rule."""
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 200) + str(rng.randrange(60)) for _ in range(300)] + ["same"] * 40 + [None, ""]
    rows = lpt_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=5, heavy=10**9).collect()
    loads = Counter()
    for t in texts:
        loads[t or ""] += len(t or "") + 1
    plain = [0] * 5
    for n in sorted(loads.values(), reverse=True):
        plain[plain.index(min(plain))] += n
    got = Counter()
    for r in rows:
        got[r.shard] += r["size"]
    assert sorted(got.values()) == sorted(plain) and len(rows) == len(texts)
    odd = lpt_shards(spark.createDataFrame([(1, None, 7), (None, "a", 7), (None, "a", 7)], "doc_id long, text string, shard int")).collect()
    assert len(odd) == 3 and sorted(r["size"] for r in odd) == [1, 2, 2]


def test_best_region_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        s = [rng.choice([-2, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        best = max([sum(s[a:b]) for a in range(len(s)) for b in range(a, len(s) + 1)], default=0)
        a, b = best_region(s)
        assert sum(s[a:b]) == best


ARTICLE = "<article><header><h1>The title</h1></header><p>One two three four five six seven eight nine ten.</p><p>And more of the text.</p></article>"
TEXT = "The title\nOne two three four five six seven eight nine ten.\nAnd more of the text."


@pytest.mark.parametrize("wrapper", ["overflow-hidden", "has-sidebar content", "layout with-sidebar", "post header-fixed", "container lg-hidden", "col search", "article related"])
def test_a_name_never_wins_over_the_article(wrapper):
    page = f"<html><body><nav><a>Home</a></nav><div class='{wrapper}'>{ARTICLE}</div><div class='cookie-banner'>We use cookies</div><footer>foot</footer></body></html>"
    learned = learn_weights([page, page.replace("div", "section")])
    assert main_text(page, Weights()) == TEXT == main_text(page, learned)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><form id=aspnet action=x><div class=menu>a b c</div><div class=content><p>" + "word " * 40 + "</p></div></form></body>", ("word " * 40).strip()),
        ("<p>x &lt; y &amp;&#233;&eacute; <b>bo</b>ld<br>next\n line</p>", "x < y &éé bold\nnext line"),
        ("<article><p>kept</p><div class='share-buttons'>tweet it</div><section id=comments><p>me first</p></section></article>", "kept"),
        ("<article><p>a<!-- b --> c<script>d('</p>')</script> e</p></article><p hidden>gone</p>", "a c e"),
        ("<main><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></main>", "one\ntwo\nx\ny"),
        ("just words", "just words"),
        ("<div></div>", ""),
        ("<div" + " class=x" * 5000, ""),
        ("<b>" * 3000 + "deep" + "</i>" * 3000, "deep"),
        ("<article>" + "<p>long text here</p>" * 20000 + "</article>", "\n".join(["long text here"] * 20000)),
    ],
)
def test_page_shapes(page, text):
    assert main_text(page, Weights()) == text


def test_clashing_names(spark):
    rows = [(i, f"text {i % 3} " * 60, f"s{i % 4}", i, i, i, i, i, i) for i in range(40)]
    names = "doc_id long, text string, source string, kept int, removed_spans int, n int, s int, mix_source int, mix_position int"
    df = spark.createDataFrame(rows, names)
    mixed = pfair_mix(df, block_rows=2)
    assert mixed.count() == 40 and mixed.columns.count("mix_source") == 1 and mixed.select("mix_source").distinct().count() == 4
    ordered = in_mixed_order(df, block_rows=2)
    assert ordered.columns == df.columns and {r.mix_position for r in ordered.collect()} == set(range(40))
    cut = remove_repeats(df)
    assert sorted(cut.columns) == sorted(c for c in df.columns if c != "text") and cut.where(F.size("removed_spans") > 0).count() == 40
    left = without_repeats(df)
    assert left.columns == df.columns and {r.kept for r in left.collect()} == set(range(40))


def test_vectors_that_take_no_part(spark):
    bad = spark.createDataFrame([(0, None), (20, [float("nan")]), (40, [None])], "vec_id long, embedding array<double>")
    assert exact_top_k(bad).count() == 0 and approximate_top_k(bad).count() == 0
    ids = spark.createDataFrame([(None, [1.0]), (20, [2.0]), (3, [2.0]), (5, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in exact_top_k(ids).where("vec_id is not null").orderBy("rank").collect()] == [(1, 3), (2, 5)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["vilest", "vilely"])
        rows.append([i, " ".join(w), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5]
    clean[0][1] += " " + passage
    clean[1][1] += " " + passage
    rows += [[1000 + n, r[1], "en", "s0", 0] for n, r in enumerate(clean[10:14])]  # copies
    near = clean[20][1].split()
    near[30] = "another"
    rows.append([1010, " ".join(near), "en", "s1", 0])
    rows += [[2000, None, None, None, None], [2001, "", "en", "s2", 0], [2002, "   ", "en", None, 0], [None, "lone text of nobody", "en", "s2", 0], [2003, "word " * 8000, "en", "s1", 0]]
    for r in rows:
        r[4] = len(r[1] or "")
    sf = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node int, mix_block int, kept int").repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, {r[0]: r[1] for r in rows}, {r[0] for r in clean}


def test_pipeline_stages(spark, corpus, tmp_path):
    sf, texts, clean = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "source_mix", "tokens"]
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        none = stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
        assert none.count() == 0
    toxic = {i for i in range(240) if i % 5 == 0}
    assert not toxic & set(kept["toxicity"]) and set(texts) - toxic == set(kept["toxicity"])
    gone = set(kept["toxicity"]) - set(kept["near_duplicates"])
    assert gone == {1000, 1001, 1002, 1003, 1010}
    cut = kept["repeated_passages"]
    assert set(cut) == set(kept["near_duplicates"]) and all(r.n_chars == len(r.text) for r in cut.values())
    shorter = {i for i, r in cut.items() if r.text != (texts[i] or "")}
    assert shorter == {sorted(clean)[0], sorted(clean)[1], 2003}
    assert set(kept["source_mix"]) == set(cut)
    assert sorted(r.mix_position for r in kept["tokens"].values()) == list(range(len(cut)))
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert rows == {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in kept["tokens"].items()}


def test_cells_that_cannot_win_never_meet(spark):
    """Clustered vectors in many cells: exact all the same, ties and copies included."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6) * 0.1]) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(3000, rows[0][1]), (3000, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    asked = {}
    for i, v in whole:
        if i % 20 == 0:
            asked[i] = min([v, asked[i]], key=lambda x: list(x)) if i in asked else v
    expected = []
    for q, x in asked.items():
        best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:20]
        expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, exact_top_k(df, cell_rows=60).collect())) == sorted(expected)


def plain_removal(texts, length=200):
    """Kept bytes of each text, by a table of all strings."""
    from collections import defaultdict

    seen = defaultdict(int)
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


def test_large_groups_are_split(spark, monkeypatch):
    """Passages of 40 to 230 bytes in ever new company: groups far over the limit, down to strings that meet by all their bytes."""
    from eventloom.llm import suffix_dedup

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [word(n) for n in (40, 100, 150, 185, 198, 199, 200, 201, 230)]
    texts = [word(rng.randint(0, 150)) + rng.choice(passages) + word(rng.randint(0, 150)) for _ in range(500)] + ["z" * 700, word(90) + "z" * 260]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = plain_removal([t.encode() for t in texts])
    splits = []
    inner = suffix_dedup.repeated_in_groups

    def spied(regions, length, limit, width=None):
        splits.append(width)
        return inner(regions, length, limit, width)

    monkeypatch.setattr(suffix_dedup, "repeated_in_groups", spied)
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, group_regions=3).select("doc_id", "kept").collect()}
    assert [got[i] for i in range(len(texts))] == expected
    assert len(splits) >= 4 and splits[-1] == 1


def test_rows_repeated_whole(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, other, short = word(2500), word(600), "short"
    base = spark.createDataFrame([(1, one), (2, other), (3, short), (4, word(20) + other[:300])], "doc_id long, text string")
    many = base.where("doc_id <> 2 AND doc_id <> 4").crossJoin(spark.range(20_000).select()).unionByName(base.where("doc_id in (2, 4)")).repartition(5)
    rows = remove_repeats(many).selectExpr("doc_id", "octet_length(kept) n").groupBy("doc_id", "n").count().collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 20_000), (2, 300, 1), (3, 5, 20_000), (4, 20, 1)]


@pytest.mark.parametrize("name", ["__raw", "__key", "__spans", "__removed", "__kept", "__doc_key", "__RAW"])
def test_names_of_repeats_cannot_clash(spark, name):
    df = spark.createDataFrame([(1, "x" * 500, 7), (2, "some text", 8)], f"doc_id long, text string, `{name}` int")
    got = without_repeats(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "", 7), (2, "some text", 8)]


@pytest.mark.parametrize("name", ["__start", "__rn", "__salt", "__salts", "__mix_at", "__mix_source", "__user", "__id", "__raw", "__key", "__spans", "__sum"])
def test_names_cannot_clash_in_any_stage(spark, name):
    df = spark.createDataFrame([(i, f"text number {i} with some words of its own {i * i}", "a" if i % 2 else "b", 7 * i) for i in range(9)], f"doc_id long, text string, source string, `{name}` int")
    expected = sorted(map(tuple, df.collect()))
    for stage in (in_mixed_order, without_repeats, one_of_each_group):
        got = stage(df)
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == expected, stage


def test_weights_of_zero_and_worse(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(120)], "doc_id long, source string")
    rows = pfair_mix(df, {"a": 1.0, "b": 0.0, "c": 3.0}, block_rows=4).collect()
    assert len(rows) == 120 and sorted({r.mix_slot for r in rows}) == list(range(30))
    assert min(r.mix_slot for r in rows if r.source == "b") == 20
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="not negative"):
            pfair_mix(df, {"a": bad})


def test_bounded_fits_of_repeated_ids(spark):
    docs = spark.createDataFrame([(3, f"some text {i}") for i in range(500)] + [(4, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3, 30)], "doc_id long, quality int, toxic int")
    assert len(fit_examples(docs, labels, examples=2).ids) <= 4
    assert quality_scores(docs, labels, fit_rows=1).count() == 501


def page_of(middle):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    return f"<html><body><p>{words('a', 12)}</p>{middle}<p>{words('b', 11)}</p></body></html>", words("a", 12), words("b", 11)


def test_article_goes_on_after_a_named_part():
    html, first, last = page_of('<p class="notice">' + "note " * 11 + "</p>")
    assert main_text(html, Weights()) == f"{first}\n{last}"
    html, first, last = page_of('<div class="a b c d e f g h sidebar"><a href="x">' + "link " * 15 + "</a></div>")
    assert "link" not in main_text(html, Weights())


def test_deep_pages_end():
    html = "<body>" + "".join(f'<div class="c{i}">' for i in range(3000)) + "<p>" + "word " * 40 + "</p>" + "</div>" * 3000
    assert main_text(html, Weights()).split() == ["word"] * 40
