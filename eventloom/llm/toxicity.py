"""Toxicity from the nearest labelled examples.

Texts are TF-IDF vectors over words and word beginnings that the labelled rows tie to the label. Each text's
nearest examples by exact cosine come from an inverted index with block maxima: blocks of examples are read in
order of their upper bounds, until no bound exceeds the kth cosine found. Their votes, weighted by cosine,
are calibrated on examples that took no part in choosing the terms: each half of the examples votes on the other. The
nearest ids are the evidence.

The examples are a bounded sample of the labelled rows (EXAMPLES of each label, none longer than EXAMPLE_CHARS), so the
index that is broadcast is bounded; every row's whole text is scored. A null text counts as empty. A text without any
term of the index is at cosine 0 from all examples and gets the calibrated rate of such texts. With no labelled rows
every score is 0.0. Ties of cosine go to the smaller example id, a repeated row scores as its copies do, and an example
never is its own evidence's vote in calibration. Empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, give_back, held_out, pieces_of

EXAMPLES, EXAMPLE_CHARS, NEAREST, BLOCK = 2_500, 100_000, 15, 64
#: A term is kept if it is so many times as frequent with the label, and no chance finding (a log-likelihood ratio).
ODDS, SURPRISE = 8.0, 28.0
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that count as terms, and what marks them.
HEADS = (4, 5, 6)


def terms_of(text: str, known: dict[str, int] | None = None, starts: set[str] | None = None) -> Counter:
    """Counts of words and of marked word beginnings; where `known` is given (starts: its first letters), of those only."""
    lower = text.lower()
    out: Counter = Counter()
    if starts is not None and len(starts) <= 64 and not any(s in lower for s in starts):
        return out  # the usual case, settled by substring search
    words = Counter(WORD.findall(lower))
    for w, n in words.items():
        if starts is not None and w[: HEADS[0]] not in starts:
            continue
        if known is None or w in known:
            out[w] += n
        for size in HEADS:
            if len(w) >= size and (known is None or f"{w[:size]}*" in known):
                out[f"{w[:size]}*"] += n
    return out


def surprise(a: float, n1: float, b: float, n0: float) -> float:
    """Twice the log-likelihood ratio of a of n1 against b of n0."""
    p = (a + b) / (n1 + n0)
    part = lambda x, n: x * np.log(x / n / p) if x else 0.0
    rest = lambda x, n: (n - x) * np.log((n - x) / n / (1 - p)) if n > x and p < 1 else 0.0
    return 2 * (part(a, n1) + part(b, n0) + rest(a, n1) + rest(b, n0))


def family(text: str) -> int:
    """Alike for most near copies: the least hash of the text's longer words."""
    return min((crc32(w.encode()) for w in set(WORD.findall(text.lower())) if len(w) >= 7), default=crc32(text.encode()))


class Examples:
    """The labelled examples with their inverted index; `calibrated` ones learn what a vote is worth as well."""

    def __init__(self, ids: list[int], texts: list[str], labels: np.ndarray, nearest: int = NEAREST, calibrated: bool = True):
        self.nearest = nearest
        positive, negative = Counter(), Counter()
        for text, y in zip(texts, labels):
            if y:
                positive.update(terms_of(text).keys())
        often = {t: 0 for t, a in positive.items() if a >= 4}
        starts = {t.rstrip("*")[: HEADS[0]] for t in often}
        for text, y in zip(texts, labels):
            if not y:
                negative.update(terms_of(text, often, starts).keys())
        # Copies of a text with the label are one finding: a term's findings are counted by family.
        families: dict[str, set[int]] = {t: set() for t in often}
        for text, y in zip(texts, labels):
            if y:
                own = family(text)
                for t in terms_of(text, often, starts):
                    families[t].add(own)
        positive = Counter({t: len(f) for t, f in families.items()})
        n1 = max(1, len({family(text) for text, y in zip(texts, labels) if y}))
        n0 = max(1, int(len(labels) - labels.sum()))
        strength = {}
        for t, a in positive.items():
            b = negative[t]
            if a >= 4 and a / n1 > ODDS * b / max(1, n0) and (g := surprise(a, n1, b, n0)) > SURPRISE:
                strength[t] = (g, (b + 0.5) / (a + b + 1))
        # A longer beginning, or a word, adds nothing to a shorter one that is as pure.
        heads = lambda t: [f"{t.rstrip('*')[:n]}*" for n in HEADS if n < len(t)]
        strength = {t: v for t, v in strength.items() if not any(h != t and h in strength and strength[h][1] <= v[1] for h in heads(t))}
        chosen = sorted(strength, key=lambda t: (-strength[t][0], t))
        self.starts = {t.rstrip("*")[: HEADS[0]] for t in chosen}
        self.term = {t: n for n, t in enumerate(chosen)}
        df = np.array([positive[t] + negative[t] for t in chosen], float)
        self.idf = np.log((1 + len(texts)) / (1 + df)) + 1 if len(chosen) else np.zeros(0)
        bags = [terms_of(text, self.term, self.starts) for text in texts]
        order = sorted(range(len(bags)), key=lambda n: ids[n])
        self.ids = np.array([ids[n] for n in order], dtype="int64")
        self.labels = np.array([labels[n] for n in order], dtype=float)
        postings: list[list[tuple[int, float]]] = [[] for _ in chosen]
        for at, n in enumerate(order):
            for t, w in zip(*self.vector(bags[n])):
                postings[t].append((at, w))
        self.blocks = -(-len(ids) // BLOCK)
        self.post = [(np.array([a for a, _ in p], dtype="int64"), np.array([w for _, w in p])) for p in postings]
        self.top = []  # by term: its blocks and the largest weight in each
        for at, w in self.post:
            own, first = np.unique(at // BLOCK, return_index=True)
            self.top.append((own, np.maximum.reduceat(w, first) if len(w) else w, np.append(first, len(at))))
        if calibrated:
            self.calibrate(ids, texts, labels)

    def vector(self, bag: Counter) -> tuple[list[int], np.ndarray]:
        own = sorted(self.term[t] for t in bag if t in self.term)
        if not own:
            return [], np.zeros(0)
        names = {self.term[t]: c for t, c in bag.items() if t in self.term}
        w = np.array([(1 + np.log(names[t])) * self.idf[t] for t in own])
        return own, w / np.sqrt((w * w).sum())

    def search(self, terms: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact nearest examples: positions and cosines, best first, ties to the smaller id."""
        k = self.nearest
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, weights):
            own, most, _ = self.top[t]
            bound[own] += w * most
        best_at, best = np.zeros(0, dtype="int64"), np.zeros(0)
        todo = np.argsort(-bound, kind="stable")
        for block in todo[: np.count_nonzero(bound)]:
            if len(best) == k and bound[block] < best[-1] - 1e-12:
                break
            if len(best) == k and bound[block] <= best[-1] + 1e-12 and block * BLOCK > best_at[-1]:
                continue  # it could only tie, with larger ids
            sums = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                own, _, first = self.top[t]
                n = np.searchsorted(own, block)
                if n < len(own) and own[n] == block:
                    at, v = self.post[t]
                    part = slice(first[n], first[n + 1])
                    sums[at[part] - block * BLOCK] += w * v[part]
            hit = np.flatnonzero(sums)
            at = hit + block * BLOCK
            best_at, best = np.concatenate([best_at, at]), np.concatenate([best, sums[hit]])
            keep = np.lexsort([best_at, -best])[:k]
            best_at, best = best_at[keep], best[keep]
        return best_at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        return float((cosine * self.labels[at]).sum() / cosine.sum()) if len(at) else -1.0

    def calibrate(self, ids: list[int], texts: list[str], all_labels: np.ndarray) -> None:
        """Rates of label 1 by steps of the vote that the other half casts, smoothed, made monotone by pooling; -1: no neighbour.

        Halves are by family, so that near copies don't vote on each other.
        """
        halves = np.array([crc32(str(family(t)).encode()) & 1 for t in texts], dtype=int)
        votes, labels = [], []
        for h in (0, 1):
            own, other = np.flatnonzero(halves == h), np.flatnonzero(halves != h)
            judge = Examples([ids[n] for n in other], [texts[n] for n in other], all_labels[other], self.nearest, calibrated=False)
            votes += [judge.poll(texts[n]) for n in own]
            labels += all_labels[own].tolist()
        votes, labels = np.array(votes or [-1.0]), np.array(labels or [0.0])
        edges = [-1.0, 0.0, 0.25, 0.5, 0.75, 0.9, 0.999]
        which = np.searchsorted(edges, votes, side="right") - 1
        pools = []
        for n in range(len(edges)):
            own = labels[which == n]
            pools.append([own.sum() + 0.5 * (n / (len(edges) - 1)), len(own) + 0.5, 1])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        self.edges, self.rates = np.array(edges), np.repeat([a / b for a, b, _ in pools], [c for _, _, c in pools])

    def neighbours(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        terms, weights = self.vector(terms_of(text, self.term, self.starts)) if self.term else ([], np.zeros(0))
        return self.search(terms, weights) if len(terms) else (np.zeros(0, dtype="int64"), np.zeros(0))

    def poll(self, text: str) -> float:
        return self.vote(*self.neighbours(text))

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        at, cosine = self.neighbours(text)
        rate = self.rates[np.searchsorted(self.edges, self.vote(at, cosine), side="right") - 1]
        return float(min(1.0, max(0.0, rate))), self.ids[at].tolist(), cosine.tolist()


def fit_examples(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Examples:
    """Examples from the rows that learning may use: `examples` of each label at most, picked by hash of the id.

    A picked text beyond EXAMPLE_CHARS is left out, so that what the driver reads is bounded.
    """
    own = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & ~held_out(F.col("__id")))
    picked = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(examples) for y in (0, 1)]
    small = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * examples rows
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    lower = F.lower("__t")
    words = F.array_join(F.regexp_extract_all(lower, F.lit(r"(\p{L}+)"), F.lit(1)), " ")
    seen = text.where(F.char_length("__t") <= EXAMPLE_CHARS).join(small, "__id").select("__id", "__y", words.alias("w"))
    # Ids may be repeated: at most `examples` rows of a label only now.
    bounded = [seen.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id", "w").limit(examples) for y in (0, 1)]
    rows = sorted((tuple(r) for part in bounded for r in part.toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    return Examples([r[0] for r in rows], [r[2] for r in rows], np.array([r[1] for r in rows], dtype=int))


def toxicity_scores(docs: DataFrame, model: Examples, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids and evidence_cosines of every row of docs."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        m = shared.value
        for batch in (x for b in batches for x in pieces_of(b, 2)):
            got = [m.score(x.as_py() or "") for x in batch.column(2)]
            scores = [g[0] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"],
            )
        give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")


def without_toxic(docs: DataFrame, model: Examples, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows that the model rejects."""
    import pyarrow as pa

    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in (x for b in batches for x in pieces_of(b, at)):
            keep = [shared.value.score(x.as_py() or "")[0] < threshold for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
