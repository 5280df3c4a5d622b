"""Exact n-gram Jaccard join with signature trees.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with equal sets are one class;
classes link when 100 * |A and B| >= 75 * |A or B| (the threshold is a parameter). Steps:

1. Prefixes. Under one order of all shingles (those frequent in a bounded sample last, then by hash), two linked
   sets share a shingle among the first n - ceil(t n) + 1 of each. Shingles in the prefix of one class only go.
2. Buckets. Each class joins the bucket of its first shared shingle, in blocks of about BLOCK classes. A block is
   indexed in a signature tree, whose nodes hold the OR of their sets' bitmaps and their size range; the tree is
   walked against itself, and pairs of nodes go whose largest possible overlap is too small. The sets of the classes
   left are gathered, and their pairs compared exactly, unless connected already.
3. The rest. Of all shared shingles, those whose classes step 2 left in several components make buckets again, one
   for each class of size (sizes of linked sets are in one class or in neighbouring ones; a set is a guest in the
   bucket above its own, and guests aren't compared with each other). The large ones are dealt to other blocks for a few rounds, as in step 2 and with the components known so far; this
   connects most of a large group without forming its pairs. What is still apart makes buckets of bitmaps only, with
   every pair of blocks, walked in the same way. The pairs left, each once, are compared exactly.
4. Components of all links by large-star and small-star rounds.

No link is lost: step 3 meets every pair that steps 1 and 2 left apart. No group is held whole by a task. Nulls: a
null text has the empty set, which links with nothing; a null doc_id never names a component. Rows repeated under
one doc_id each get their row. Empty tables give empty tables. Hashes stand for shingles: two different ones are
taken for equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, discard, free_names, give_back, materialize, pieces_of, release

WORDS, PERCENT = 5, 75
SAMPLE_DOCS, HOT_TOKENS = 16_384, 200_000
BLOCK, PACK_ROWS, BATCH_BYTES, HOT_SALTS = 512, 2_048, 500_000, 64
#: Rounds that deal groups to new blocks before pairs are formed, for shingles of more classes than CROWD.
ROUNDS, CROWD = 4, 64
#: How many of its first open buckets a set names, so that a pair is passed on from the first it shares; later ones may pass it on again.
NAMED = 8
#: Sets told apart at a time by a task that lists shingles: copies beyond are listed again, and found to be the same later.
SEEN = 100_000
#: Blocks of so many members at most are leaves of their own, compared without a tree; bytes of bitmaps compared at a time.
SMALL, LEAF_BYTES = 64, 2_000_000
#: Size of the bitmap that picks the texts whose sets are wanted: beyond some ten million it lets others pass, at a cost in time alone.
PICK_BITS = 1 << 24
U64 = np.uint64

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_letters = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_base, _inverse = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_steps = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves each of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        _powers[size] = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))]) for b in (_base, _inverse))
    return _powers[size]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than a shingle has count as one shingle."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < BATCH_BYTES):
            size += len(texts[end]) + 1
            end += 1
        out += _some_sets(texts[start:end], words)
        start = end
    return out


def _some_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = _lower[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_letters[data] * up[: len(data)], out=sums[1:])
    edge = np.diff(np.concatenate([[0], (~_space[data]).view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64))
    bounds = np.searchsorted(first, begins)
    rolled = word * _steps[0]
    for k in range(1, words):
        rolled[: len(word) - k] += word[k:] * _steps[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            out.append(mix((word[a:b] * _steps[words : words + b - a]).sum(keepdims=True, dtype=U64) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def ordered(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: hot shingles last."""
    if not len(hot) or not len(tokens):
        return tokens
    is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
    return np.concatenate([tokens[~is_hot], tokens[is_hot]]) if is_hot.any() else tokens


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1 if n else 0


def node_of(tokens: np.ndarray) -> int:
    """The name of a set: a hash of its members."""
    if not len(tokens):
        return 0
    h = mix(np.array([mix(tokens).sum(dtype=U64) ^ (mix(tokens ^ U64(0x5851F42D4C957F2D)) * U64(3)).sum(dtype=U64) + U64(len(tokens))], U64))
    return int(h.view(np.int64)[0])


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Of 2 n to 4 n bits (64 at least), so that bitmaps of linked sets are equal in size or one step apart."""
    bits = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    out = np.zeros(bits // 8, np.uint8)
    at = (tokens >> U64(40)) & U64(bits - 1)
    np.bitwise_or.at(out, (at >> U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U64(7)).astype(np.uint8)))
    return out


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """A bitmap at a smaller size: its bits by their low-order place."""
    return np.bitwise_or.reduce(x.reshape(-1, size), axis=0) if len(x) > size else x


class SignatureTree:
    """Members in order of size; leaves of FAN members, and parents of FAN nodes each, up to one root."""

    FAN = 16

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray]):
        self.order = np.lexsort([[m[: 8].tobytes() for m in maps], sizes]) if len(maps) else np.zeros(0, int)
        width = min((len(m) for m in maps), default=8)
        self.sizes = sizes[self.order]
        bits = np.stack([fold(maps[n], width) for n in self.order]) if len(maps) else np.zeros((0, 8), np.uint8)
        self.bits = bits.view(np.uint64)
        # Members beyond their distinct bits: so many more may hide in a common bit.
        self.extra = self.sizes - np.bitwise_count(self.bits).sum(1)
        self.levels = [(self.bits, self.sizes, self.sizes, self.extra)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, extra = self.levels[-1]
            at = np.arange(0, len(b), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))


def may_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """For nodes of two trees' levels, whether any pair under them can link: a matrix."""
    bits, low, high, extra = a
    bits2, low2, high2, extra2 = b
    common = np.zeros((len(bits), len(bits2)), np.int64)
    for w in range(bits.shape[1]):
        common += np.bitwise_count(bits[:, w][:, None] & bits2[:, w][None, :])
    most = np.minimum(common + np.minimum(extra[:, None], extra2[None, :]), np.minimum(high[:, None], high2[None, :]))
    need = (100 + percent) * most >= percent * (low[:, None] + low2[None, :])
    return need & (100 * high[:, None] >= percent * low2[None, :]) & (100 * high2[None, :] >= percent * low[:, None])


def candidate_pairs(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk two trees together; members (in tree order) of the pairs that may link. For one tree twice, each pair once."""
    same = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    todo = [(min(top, len(a.levels) - 1), min(top, len(b.levels) - 1), np.array([0]), np.array([0]))] if len(a.sizes) and len(b.sizes) else []
    fan = SignatureTree.FAN
    while todo:
        la, lb, ra, rb = todo.pop()
        na, nb = tuple(x[ra] for x in a.levels[la]), tuple(x[rb] for x in b.levels[lb])
        i, j = np.nonzero(may_link(na, nb, percent))
        i, j = ra[i], rb[j]
        if same and la == lb:
            keep = i < j if la == 0 else i <= j
            i, j = i[keep], j[keep]
        if la == 0 and lb == 0:
            if len(i):
                yield i, j
            continue
        for x, y in zip(i.tolist(), j.tolist()):
            below_a = np.arange(x * fan, min((x + 1) * fan, len(a.levels[la - 1][0]))) if la else np.array([x])
            below_b = np.arange(y * fan, min((y + 1) * fan, len(b.levels[lb - 1][0]))) if lb else np.array([y])
            todo.append((max(0, la - 1), max(0, lb - 1), below_a, below_b))


def paired(n: np.ndarray, maps: list[np.ndarray], first: np.ndarray, second: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs that may link, within `first` or between it and `second`.

    Bitmaps have 2 to 4 bits a member, so linked sets have equal sizes of bitmap or neighbouring ones: there is a
    tree for each size, and each is walked with its own size and with the next one folded to it.
    """

    def by_width(rows: np.ndarray) -> dict[int, np.ndarray]:
        widths = np.array([len(maps[x]) for x in rows])
        return {int(w): rows[widths == w] for w in np.unique(widths)}

    def tree(rows: np.ndarray, width: int) -> SignatureTree:
        return SignatureTree(n[rows], [fold(maps[x], width) for x in rows])

    a, b = by_width(first), by_width(first if second is None else second)
    for w, rows in a.items():
        for w2 in ((w, 2 * w) if second is None else (w // 2, w, 2 * w)):
            if w2 not in b:
                continue
            one = tree(rows, min(w, w2))
            two = one if second is None and w2 == w else tree(b[w2], min(w, w2))
            for i, j in candidate_pairs(one, two, percent):
                yield rows[one.order[i]], b[w2][two.order[j]]


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test on two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def leaf_pairs(rows: np.ndarray, block: np.ndarray, n: np.ndarray, maps: list[np.ndarray], percent: int, apart: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs that may link within small blocks, each a leaf of its own: all leaves of a pack at once.

    rows lie side by side by block. apart(x, y) says which pairs are worth a look.
    """
    xs, ys = [], []
    for step in range(1, SMALL):
        at = np.flatnonzero(block[step:] == block[:-step])
        if not len(at):
            break
        x, y = rows[at], rows[at + step]
        keep = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        if apart:
            keep &= apart(x, y)
        xs.append(x[keep])
        ys.append(y[keep])
    if not xs:
        return
    x, y = np.concatenate(xs), np.concatenate(ys)
    widths = np.array([len(m) for m in maps])
    narrow = np.minimum(widths[x], widths[y])
    for w in np.unique(narrow).tolist():
        a, b = x[narrow == w], y[narrow == w]
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        bits = np.stack([fold(maps[r], w) for r in used]).view(np.uint64)
        extra = n[used] - np.bitwise_count(bits).sum(1)
        at_a, at_b = at[: len(a)], at[len(a) :]
        some = max(1, LEAF_BYTES // w)
        for c in range(0, len(a), some):
            i, j = at_a[c : c + some], at_b[c : c + some]
            both = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(extra[i], extra[j])
            most = np.minimum(both, np.minimum(n[used[i]], n[used[j]]))
            good = (100 + percent) * most >= percent * (n[used[i]] + n[used[j]])
            if good.any():
                yield a[c : c + some][good], b[c : c + some][good]


def candidates(blocks: list[np.ndarray], n: np.ndarray, maps: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs within blocks that may link."""
    small = [b for b in blocks if len(b) <= SMALL]
    if small:
        yield from leaf_pairs(np.concatenate(small), np.repeat(np.arange(len(small)), [len(b) for b in small]), n, maps, percent)
    for rows in blocks:
        if len(rows) > SMALL:
            yield from paired(n, maps, rows, None, percent)


def block_labels(blocks: list[np.ndarray], nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Each row's label: the least name that exact links within blocks connect it with; rows of one name are connected."""
    first = {int(name): x for x, name in reversed(list(enumerate(nodes)))}
    parent = [first[int(name)] for name in nodes]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in candidates(blocks, np.array([len(s) for s in sets]), [bitmap(s) for s in sets], percent):
        for x, y in zip(i.tolist(), j.tolist()):
            rx, ry = find(x), find(y)
            if rx != ry and links(sets[x], sets[y], percent):
                keep, lose = (rx, ry) if nodes[rx] <= nodes[ry] else (ry, rx)
                parent[lose] = keep
    return nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node u of the edges with the least node v of its component, those that are it left out."""
    state = materialize(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct(), "links")
    while not stars(state):
        both = state.unionByName(state.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(low, "u").where("v > u and v <> m").selectExpr("v u", "m v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        last, state = state, materialize(small.where("v <> m").selectExpr("v u", "m v").unionByName(low2.selectExpr("u", "m v")).distinct(), "links")
        discard(last)
        release(edges.sparkSession)  # the tables that a round's joins broadcast stay in the driver's heap until it is collected
    return state


def stars(state: DataFrame) -> bool:
    """Whether no u has two v or is one: then each v is the least of its component, as u > v."""
    sides = state.selectExpr("u node", "1 out").unionByName(state.selectExpr("v node", "0 out"))
    return sides.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).where("outs > 1 OR outs > least").count() == 0


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs, its key (doc_id, or a hash of the text) and its component's first."""
    import pyarrow as pa

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    plain = plain.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))

    # 1. The shingle order's frequent end, from a bounded sample.
    rows = plain.count()
    some = plain.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, rows // SAMPLE_DOCS))) == 0).select("text")

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in (x for b in batches for x in pieces_of(b, 0)):
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["token"])
            del sets
        give_back()

    often = some.mapInArrow(all_tokens, "token long").groupBy("token").count().where("count >= 4").orderBy(F.desc("count"), "token").limit(HOT_TOKENS)
    hot = np.sort(often.select("token").toArrow().column(0).to_numpy().view(U64))  # HOT_TOKENS at most
    shared = spark.sparkContext.broadcast(hot)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in (x for b in batches for x in pieces_of(b, 1)):
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            heads = [ordered(s, shared.value)[: prefix_size(len(s), percent)].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int32()),
                 pa.array(heads, pa.binary()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "key", "node", "n", "head", "bits"],
            )
        give_back()

    described = materialize(plain.mapInArrow(describe, "doc_id long, key long, node long, n int, head binary, bits binary"), "shingles")
    release(spark)
    heads = described.where("n > 0").select("node", "head", "n")
    classes = described.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"))

    step = np.log(100.1 / percent)  # a little more than linked sizes can differ by

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        seen: set[int] = set()
        for batch in (x for b in batches for x in pieces_of(b, 1)):
            fresh = []
            for at, name in enumerate(batch.column(0).to_pylist()):
                if name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    fresh.append(at)
            batch = batch.take(pa.array(fresh, pa.int64()))
            heads = [np.frombuffer(h, np.int64) for h in batch.column(1).to_pylist()]
            sizes = [len(h) for h in heads]
            token = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            often = np.isin(token.view(U64), shared.value)
            repeat = lambda c: np.repeat(c.to_numpy(), sizes)
            level = np.floor(np.log(np.repeat(batch.column(2).to_numpy(), sizes)) / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token, pa.int64()), pa.array(repeat(batch.column(0)), pa.int64()), pa.array(often, pa.bool_()),
                 pa.array(np.concatenate([np.arange(n) for n in sizes]) if sizes else [], pa.int32()), pa.array(level, pa.int32())],
                names=["token", "node", "often", "pos", "level"],
            )
            del heads, token, often, level
        seen.clear()
        give_back()

    def in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of token and node, each once: those whose token another node has too, or is frequent.

        Keeps one row from batch to batch.
        """
        begin()
        held, held_used = None, False
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = token[1:] == token[:-1]
            once = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
            if not once.all():
                batch = batch.filter(pa.array(once))
                token = token[once]
                same = token[1:] == token[:-1]
            used = np.concatenate([[held_used and held is not None], same]) | np.concatenate([same, [False]]) | batch.column(2).to_numpy(zero_copy_only=False)
            held, held_used = batch.slice(len(batch) - 1, 1), bool(used[-1])
            yield batch.slice(0, len(batch) - 1).filter(pa.array(used[:-1]))
        if held is not None and held_used:
            yield held
        give_back()

    kinds = "token long, node long, often boolean, pos int, level int"
    tokens = heads.mapInArrow(spread, kinds)
    # A frequent shingle is in company, wherever its rows go: they are dealt to many tasks.
    dealt = tokens.repartition("token", F.when(F.col("often"), F.pmod("node", F.lit(HOT_SALTS))).otherwise(0))
    active = materialize(dealt.sortWithinPartitions("token", "node").mapInArrow(in_company, kinds).drop("often"), "active")
    release(spark)

    # 2. Blocks by first shared shingle; bitmaps alone say which classes have a possible partner there.
    homes = active.groupBy("node").agg(F.min(F.struct("pos", "token")).alias("f")).select("node", F.col("f.token").alias("home"))
    homes = materialize(homes, "homes")
    crowd = homes.groupBy("home").agg(F.count(F.lit(1)).alias("c"))
    spots = homes.join(crowd, "home").where("c > 1").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)))
    packs = max(1, -(-homes.count() // PACK_ROWS))
    spots = spots.select("node", "home", "part", F.pmod(F.xxhash64("home", "part"), F.lit(packs)).alias("pack"))

    def blocks_of(table: pa.Table) -> list[np.ndarray]:
        node, home, part = (table[c].to_numpy() for c in ("node", "home", "part"))
        order = np.lexsort([node, part, home])
        cuts = np.flatnonzero(np.concatenate([[True], (home[order][1:] != home[order][:-1]) | (part[order][1:] != part[order][:-1]), [True]]))
        return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]

    def partnered(table: pa.Table) -> pa.Table:
        node, n, maps = table["node"].to_numpy(), table["n"].to_numpy(), [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
        live = np.zeros(len(node), bool)
        for x, y in candidates(blocks_of(table), n, maps, percent):
            live[x] = live[y] = True
        out = table.select(["node", "home", "part", "pack", "key"]).filter(pa.array(live))
        del maps
        give_back()
        return out

    placed = spots.join(classes.select("node", "key", "n", "bits"), "node").groupBy("pack")
    live = materialize(placed.applyInArrow(partnered, "node long, home long, part long, pack long, key long"), "partnered")
    discard(homes)
    release(spark)

    def sets_of(keys: DataFrame, name: str) -> DataFrame:
        """(node, tokens) of the classes whose key is given, and of a few more: a bitmap of fixed size picks them from the texts."""
        spot = F.pmod(F.xxhash64("key"), F.lit(PICK_BITS))
        words_of = keys.select(spot.alias("b")).groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("w")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("m"))
        picked = np.zeros(PICK_BITS // 8, np.uint8)
        for w, m in words_of.collect():  # PICK_BITS / 8 bytes at most
            picked[(w - 1) * 4096 : w * 4096] = np.frombuffer(m, np.uint8)
        chosen = spark.sparkContext.broadcast(picked)

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin()
            for batch in (x for b in batches for x in pieces_of(b, 1)):
                at = batch.column(0).to_numpy()
                rows = np.flatnonzero((chosen.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                sets = shingle_sets(batch.column(1).take(pa.array(rows)).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])
                del sets
            give_back()

        return materialize(plain.select(spot.alias("b"), "text").mapInArrow(members, "node long, tokens binary"), name)

    sets = sets_of(live.select("key"), "sets")

    def label(table: pa.Table) -> pa.Table:
        node, own = table["node"].to_numpy(), [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()]
        labels = block_labels(blocks_of(table), node, own, percent)
        out = pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(labels, pa.int64())})
        del own
        give_back()
        return out.group_by("node").aggregate([("label", "min")]).rename_columns(["node", "label"]) if len(out) else out

    labelled = live.join(sets.dropDuplicates(["node"]), "node").groupBy("pack").applyInArrow(label, "node long, label long")
    labelled = materialize(labelled, "labels")
    discard(live)
    discard(sets)
    release(spark)

    # 3. Shingles that still join several components.
    label_of = F.coalesce("label", "node").alias("label")
    known = active.join(labelled, "node", "left").select("token", "node", "level", label_of)
    apart = known.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    places = F.array(F.struct(F.col("level"), F.lit(True).alias("own")), F.struct((F.col("level") + 1).alias("level"), F.lit(False).alias("own")))
    placed = known.join(apart, "token").select("token", "node", "label", F.explode(places).alias("at"))
    placed = materialize(placed.select(F.xxhash64("token", "at.level").alias("token"), "node", "label", "at.own"), "placed")
    discard(active)
    release(spark)
    told = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node", "own")).alias("x"), F.sum(F.xxhash64("node", "own", F.lit(7)).cast("decimal(38,0)")).alias("y")]
    open_ = placed.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("own").alias("hosts"), *told).where("a <> b AND hosts")
    buckets = open_.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token", "c")  # equal buckets once
    members = materialize(placed.select("token", "node", "own").join(buckets, "token"), "members")
    discard(placed)
    release(spark)

    def merged(table: pa.Table) -> pa.Table:
        """Pairs of labels that an exact link within a block connects, a spanning set of them."""
        own, label = [np.frombuffer(x, U64) for x in table["tokens"].to_pylist()], table["label"].to_numpy()
        blocks = [rows for rows in blocks_of(table) if (label[rows] != label[rows[0]]).any()]
        out = list({(int(a), int(b)) for a, b in zip(label, block_labels(blocks, label, own, percent)) if a != b})
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    # Large groups first: dealt to blocks anew, by their most frequent shingle, blocks of the round before meet.
    gathered = None
    for turn in range(1, ROUNDS + 1):
        now = members.join(labelled, "node", "left").select("token", "node", "c", label_of)
        still = now.where(F.col("c") > CROWD).groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
        best = now.join(still, "token").groupBy("node").agg(F.max_by("token", F.struct("c", "token")).alias("home"), F.first("label").alias("label"))
        best = materialize(best, "crowds")
        if not (held := best.count()):
            break
        if gathered is None:
            gathered = sets_of(classes.join(best.select("node"), "node", "left_semi").select("key"), "crowd-sets")
        sizes = best.groupBy("home").agg(F.count(F.lit(1)).alias("m"))
        dealt = best.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("m") / BLOCK)))
        dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("home", "part"), F.lit(max(1, -(-held // PACK_ROWS))))).drop("m")
        joined = materialize(dealt.join(gathered.dropDuplicates(["node"]), "node").groupBy("pack").applyInArrow(merged, "u long, v long").distinct(), "merges")
        discard(best)
        if joined.isEmpty():
            break
        roots = components(joined)
        every = labelled.select("node", "label").unionByName(now.select("node", "label")).distinct()
        last, labelled = labelled, materialize(every.join(roots.toDF("label", "root"), "label", "left").selectExpr("node", "coalesce(root, label) label"), "labels")
        for done in (last, joined, roots):
            discard(done)
        release(spark)
    if gathered is not None:
        discard(gathered)

    known = members.join(labelled, "node", "left").select("token", "node", "own", "c", label_of)
    left_open = known.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    known = materialize(known.join(left_open, "token"), "open")
    discard(members)
    release(spark)
    named = known.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("token", "own"))), 1, NAMED).alias("l"))
    named = named.select("node", F.col("l.token").alias("named"), F.col("l.own").alias("hosts"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    packs = max(1, -(-(known.agg(F.sum(blocks)).first()[0] or 0) // (4 * PACK_ROWS)))
    crossing = known.withColumn("of", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, of - 1)")))
    crossing = crossing.select("node", "own", "label", "token", "mine", F.expr("least(mine, other)").alias("p"), F.expr("greatest(mine, other)").alias("q"))
    crossing = crossing.join(classes.select("node", "n", "bits").join(named, "node"), "node")

    def pairs(table: pa.Table) -> pa.Table:
        token, node, label, mine, p, q = (table[c].to_numpy() for c in ("token", "node", "label", "mine", "p", "q"))
        n, maps, own = table["n"].to_numpy(), [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()], table["own"].to_numpy()
        apart = lambda x, y: (label[x] != label[y]) & (own[x] | own[y])
        names, hosts = np.full((len(node), NAMED), np.iinfo(np.int64).max), np.zeros((len(node), NAMED), bool)
        within = np.arange(NAMED) < table["named"].combine_chunks().value_lengths().to_numpy()[:, None]
        names[within] = table["named"].combine_chunks().flatten().to_numpy()
        hosts[within] = table["hosts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)

        def first_here(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether no bucket before this one, of those named, has the pair with one as no guest."""
            out = np.ones(len(x), bool)
            for a in range(0, len(x), 16_384):
                i, j = x[a : a + 16_384], y[a : a + 16_384]
                common = (names[i][:, :, None] == names[j][:, None, :]) & (hosts[i][:, :, None] | hosts[j][:, None, :])
                out[a : a + 16_384] = ~(common.any(2) & (names[i] < token[i][:, None])).any(1)
            return out

        def meet(first: np.ndarray, second: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs that may link, two guests excepted."""
            host, guest = first[own[first]], first[~own[first]]
            if second is None:
                sides = [(host, None), (host, guest)]
            else:
                host2, guest2 = second[own[second]], second[~own[second]]
                sides = [(host, host2), (host, guest2), (guest, host2)]
            for u, v in sides:
                if len(u) and (v is None or len(v)):
                    yield from paired(n, maps, u, v, percent)

        def every(order: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            groups = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            small = [g for g in groups if 1 < len(g) <= SMALL and p[g[0]] == q[g[0]]]
            if small:
                yield from leaf_pairs(np.concatenate(small), np.repeat(np.arange(len(small)), [len(g) for g in small]), n, maps, percent, apart)
            for g in groups:
                if (label[g] == label[g[0]]).all() or len(g) <= SMALL and p[g[0]] == q[g[0]]:
                    continue
                whole = p[g[0]] == q[g[0]]
                first, second = (g, None) if whole else (g[mine[g] == p[g]], g[mine[g] == q[g]])
                for x, y in meet(first, second):
                    keep = apart(x, y)
                    yield x[keep], y[keep]

        order = np.lexsort([mine, q, p, token])
        key = np.stack([token, p, q])[:, order]
        cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        left, right = [], []
        for x, y in every(order, cuts):
            here = first_here(x, y)
            x, y = x[here], y[here]
            left.append(np.minimum(node[x], node[y]))
            right.append(np.maximum(node[x], node[y]))
        join = lambda v: pa.array(np.concatenate(v) if v else [], pa.int64())
        out = pa.table({"x": join(left), "y": join(right)})
        give_back()
        return out.group_by(["x", "y"]).aggregate([]) if len(out) else out

    spread_out = crossing.withColumn("pack", F.pmod(F.xxhash64("token", "p", "q"), F.lit(packs)))
    near = materialize(spread_out.groupBy("pack").applyInArrow(pairs, "x long, y long").distinct(), "near")
    discard(known)
    release(spark)
    ends = near.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    last_sets = sets_of(classes.join(ends, "node", "left_semi").select("key"), "more-sets")
    more = last_sets.join(ends, "node", "left_semi").dropDuplicates(["node"])
    both = near.join(more.selectExpr("node x", "tokens a"), "x").join(more.selectExpr("node y", "tokens b"), "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [links(np.frombuffer(s, U64), np.frombuffer(t, U64), percent) for s, t in zip(a, b)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["x", "y"]).filter(pa.array(good, pa.bool_()))

    found = both.select("x", "y", "a", "b").mapInArrow(compare, "x long, y long")
    name = labelled.select("node", "label")
    edges = found.join(name.toDF("x", "lx"), "x", "left").join(name.toDF("y", "ly"), "y", "left").selectExpr("coalesce(lx, x) u", "coalesce(ly, y) v")

    # 4. Components, named by their least doc_id.
    roots = components(edges)
    discard(near)
    discard(last_sets)
    final = labelled.join(roots.toDF("label", "root"), "label", "left").selectExpr("node", "coalesce(root, label) root")
    lone = roots.toDF("node", "root").join(labelled, "node", "left_anti")  # classes that only step 3 linked
    final = final.unionByName(lone)
    each = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("low"))
    grouped = each.join(final, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.min("low").alias("low"))
    names = grouped.select("node", "root").join(least, "root").select("node", "component_id", F.coalesce("component_id", "low").alias("first_key"))
    out = described.select("doc_id", "key", "n", "node").join(names, "node", "left")
    some = F.col("n") > 0
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "key",
        F.when(some, F.col("first_key")).otherwise(F.col("key")).alias("first_key"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that of least doc_id (rows repeated whole count as one)."""
    key, digest = free_names(docs.columns, "__key", "__sum")
    first = jaccard_components(docs, id_col, text_col, words, percent).where("key = first_key").select(F.col("key").alias(key))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(digest, F.xxhash64(text.cast("binary"))).withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.col(digest)))
    return keyed.join(first, key, "left_semi").dropDuplicates([key, digest]).drop(key, digest)
