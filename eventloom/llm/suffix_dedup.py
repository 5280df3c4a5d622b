"""Exact removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte goes that is covered by a string of `length` bytes which also starts elsewhere in the corpus, the same
document included. To build suffix arrays of bounded shards instead of one of the corpus, strings are dealt by
content: of the grams of GRAM bytes in a string, the one with the least hash (leftmost of equals) is its anchor.
Equal strings have equal anchors at equal offsets, so all copies of a string meet in its anchor's group.

1. Anchors of all strings, as regions: runs of neighbouring starts that share an anchor. Regions whose anchor
   occurs once in the corpus hold nothing repeated and go.
2. Equal regions of a group count as one with a number of copies. A group with one distinct region needs no order:
   its strings are repeated if it has copies.
3. Groups with several distinct regions are packed to shards. A shard's suffix array is built by induced sorting
   (suffix classes, leftmost-smaller substrings sorted recursively, then induced), its permuted common prefixes are
   computed, and starts whose common prefix with a neighbour reaches `length`, or whose region has copies, are repeated.
4. A group of over GROUP_REGIONS distinct regions (a frequent short passage in ever new company) is split before it is
   sorted: the strings of its regions are dealt to ranges of the anchor's place in them, and those of a range meet by all
   the bytes that they have in common around the anchor, so that they share almost a whole string instead of GRAM bytes.
   What is too large still is split again, at most until strings meet by all their bytes; so no task holds a large group.

Rows repeated whole count as one with a number of copies before all this, and share what is found.

Induced sorting runs in whole-array steps: a scan stops only where a slot is still to be filled by what it has not
read yet, so everything up to there is induced at once. Nulls: a null text is empty. Rows repeated whole repeat each
other. An empty table gives an empty table. Regions and rows are told apart by 64-bit hashes beside the anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, give_back, materialize, pieces_of, release
from .jaccard_join import mix, powers

LENGTH, GRAM = 200, 32
SAMPLE_DOCS, HOT_ANCHORS, HOT_SALTS = 8_192, 10_000, 64
#: Bytes of a shard, and the most distinct regions of a group (of some 300 bytes) that one task sorts.
SHARD_BYTES, GROUP_REGIONS = 600_000, 4_096
PIECE = 1 << 19
#: Into how many ranges of the anchor's place a large group's strings are dealt.
RANGES = 8
U64 = np.uint64
_letters = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def suffix_classes(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; t ends with a unique least symbol."""
    n = len(t)
    differs = np.concatenate([t[:-1] != t[1:], [True]])
    smaller = np.concatenate([t[:-1] < t[1:], [True]])
    at = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[nxt]


def _next_open(fill: np.ndarray, end: np.ndarray, c: int, step: int) -> int:
    """The first bucket from c on, upwards or downwards, that is not filled to its end; -1 if none."""
    size, width = len(fill), 256
    while 0 <= c < size:
        if step > 0:
            found = np.flatnonzero(fill[c : c + width] < end[c : c + width])
            if len(found):
                return c + int(found[0])
            c += width
        else:
            low = max(0, c - width + 1)
            found = np.flatnonzero(fill[low : c + 1] > end[low : c + 1])
            if len(found):
                return low + int(found[-1])
            c = low - 1
        width *= 2
    return -1


def _place(sa: np.ndarray, p: np.ndarray, c: np.ndarray, fill: np.ndarray, step: int) -> None:
    """Append suffixes p to their buckets c in the given order, upwards or downwards."""
    order = np.argsort(c, kind="stable")
    c, p = c[order], p[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    counts = np.diff(np.append(first, len(c)))
    within = np.arange(len(c)) - np.repeat(first, counts)
    sa[fill[c] + step * within] = p
    fill[c[first]] += step * counts


def induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, larges: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from leftmost-smaller suffixes in the order given."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    ends = starts[1:]
    middle = starts[:-1] + larges  # a bucket's larger suffixes end here, and its smaller ones begin
    tail = ends.copy() - 1
    _place(sa, lms[::-1], t[lms[::-1]], tail, -1)
    head, i = starts[:-1].copy(), 0
    while i < n:
        c = int(np.searchsorted(starts, i, side="right")) - 1
        c = _next_open(head, middle, c, 1)
        j = n if c < 0 else int(head[c])
        entries = sa[i:j]
        p = entries[entries > 0] - 1
        p = p[~small[p]]
        if len(p):
            _place(sa, p, t[p], head, 1)
        i = j
    last = sa[0]
    tail, bottom = ends.copy() - 1, middle - 1
    bounds = np.zeros(n + 1, np.int32)
    np.add.at(bounds, starts[:-1], 1)
    np.add.at(bounds, middle, -1)
    in_small = np.cumsum(bounds[:n]) == 0
    sa[in_small] = -1
    sa[0], tail[0] = last, bottom[0]
    i = n - 1
    while i >= 0:
        c = int(np.searchsorted(starts, i, side="right")) - 1
        c = _next_open(tail, bottom, c, -1)
        j = -1 if c < 0 else int(tail[c])
        entries = sa[j + 1 : i + 1][::-1]
        p = entries[entries > 0] - 1
        p = p[small[p]]
        if len(p):
            _place(sa, p, t[p], tail, -1)
        i = j
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """All suffixes of t in order; t holds whole numbers from 0 and ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_classes(t)
    sigma = int(t.max()) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
    larges = np.bincount(t[~small], minlength=sigma)
    lms = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    if len(lms) > 1:
        rough = induce(t, small, starts, larges, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        in_order = rough[is_lms[rough]]
        # Name the substrings from one leftmost-smaller suffix to the next: equal ones lie side by side.
        nth = np.zeros(n, np.int64)
        nth[lms] = np.arange(len(lms))
        upto = np.append(lms[1:], n - 1)[nth[in_order]] + 1
        up, down = powers(n + 1)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(t.astype(U64) + U64(1)) * up[:n])])
        value = (sums[upto] - sums[in_order]) * down[in_order]
        size = upto - in_order
        new = np.concatenate([[False], (value[1:] != value[:-1]) | (size[1:] != size[:-1])])
        names = np.cumsum(new)
        if names[-1] + 1 < len(lms):
            reduced = np.zeros(len(lms), np.int64)
            reduced[nth[in_order]] = names
            lms = lms[suffix_array(reduced)]
        else:
            lms = in_order
    return induce(t, small, starts, larges, lms)


def common_prefixes(data: np.ndarray, left: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: by text position, the length shared with the suffix before it, and that suffix.

    data: bytes, with 8 more at the end; left: bytes before the position's separator. Only where the bytes before
    both suffixes differ is a length compared; elsewhere it is the neighbour's less one.
    """
    n = len(left)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    prior = np.where(i > 0, data[i - 1], 256)
    prior2 = np.where(before > 0, data[before - 1], 257)
    fresh = (prior != prior2) | (before < 0) | (left == 0) | np.concatenate([[True], left[:-1] == 0]) | (left[before - 1] == 0)
    at = np.flatnonzero(fresh & (before >= 0))
    other = before[at]
    most = np.minimum(left[at], left[other])
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[: n + 1]
    words = np.ascontiguousarray(words).view("<u8").ravel()
    same = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        x = words[at[live] + same[live]] ^ words[other[live] + same[live]]
        equal = x == 0
        lowest = np.bitwise_count((x & (~x + U64(1))) - U64(1)) // 8
        same[live] += np.where(equal, 8, lowest)
        live = live[equal & (same[live] < most[live])]
    lengths = np.zeros(n, np.int64)
    lengths[at] = np.minimum(same, most)
    origin = np.maximum.accumulate(np.where(fresh, i, 0))
    lengths = np.where(fresh, lengths, lengths[origin] - (i - origin))
    return np.minimum(np.maximum(lengths, 0), left), before


def repeated_starts(regions: list[bytes], copies: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of several distinct regions, the starts of strings that start elsewhere too."""
    sizes = np.array([len(r) for r in regions])
    data = np.frombuffer(b"\xff".join(regions) + b"\xff" * 9, np.uint8)
    n = int(sizes.sum()) + len(regions)
    ends = np.cumsum(sizes + 1) - 1
    symbols = data[:n].astype(np.int64) + len(regions)
    symbols[ends] = np.arange(len(regions), 0, -1) - 1  # a separator of its own after each region, the last one 0
    left = np.repeat(ends, sizes + 1) - np.arange(n)
    sa = suffix_array(symbols)
    shared, before = common_prefixes(data, left, sa)
    hit = np.flatnonzero(shared >= length)
    marked = np.zeros(n, bool)
    marked[hit] = True
    marked[before[hit]] = True
    marked |= np.repeat(copies > 1, sizes + 1)
    marked &= left >= length
    return [np.flatnonzero(x) for x in np.split(marked, ends[:-1] + 1)]


def spans_of(starts: np.ndarray, length: int) -> np.ndarray:
    """Starts of repeated strings to the runs of bytes they cover: begin, end, begin, end, ..."""
    if not len(starts):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(starts) > length)
    begin, end = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + length
    return np.stack([begin, end], 1).ravel().astype(np.int32)


def anchored(text: bytes | np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Regions of joined documents: (document, first start, last start, anchor's place behind the first start, anchor hash, region hash)."""
    data = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    n, width = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_letters[data] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[: n - GRAM + 1]) * down[: n - GRAM + 1])
    keyed = (grams & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=U64)
    padded = np.full(-(-len(keyed) // width) * width, U64(2**64 - 1), U64)
    padded[: len(keyed)] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & U64(0xFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    valid = doc[:starts] == doc[length - 1 :]
    at = np.flatnonzero(valid)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (doc[at][1:] != doc[at][:-1]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    owner = doc[first]
    whole = mix((sums[last + length] - sums[first]) * down[first] + (last - first).astype(U64) * U64(0x9E3779B97F4A7C15) + (anchor[first] - first).astype(U64))
    return owner, first - begins[owner], last - begins[owner], anchor[first] - first, grams[anchor[first]].view(np.int64), whole.view(np.int64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_regions: int = GROUP_REGIONS) -> DataFrame:
    """Every row of docs, but for the text, with `removed_spans` (begin, end, ... in bytes of the UTF-8 text) and `kept` (the bytes left).

    A column of docs that is named like one of these two gives way to it.
    """
    out, removed, kept = cut_repeats(docs, length, id_col, text_col, group_regions)
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "removed_spans", "kept")]
    return out.select(*own, F.col(f"`{removed}`").alias("removed_spans"), F.col(f"`{kept}`").alias("kept"))


def sorted_groups(groups: DataFrame, length: int) -> DataFrame:
    """anchor, region and the spans of repeated strings of distinct regions (anchor, region, copies, bytes), sorted in shards of about SHARD_BYTES."""
    import pyarrow as pa

    total = groups.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))

    def sort_shard(table: pa.Table) -> pa.Table:
        starts = repeated_starts(table["bytes"].to_pylist(), table["copies"].to_numpy(), length) if len(table) else []
        give_back()
        return pa.table({"anchor": table["anchor"], "region": table["region"], "spans": pa.array([spans_of(s, length) for s in starts], pa.list_(pa.int32()))})

    dealt = groups.select("anchor", "region", "copies", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(sort_shard, "anchor long, region long, spans array<int>").where(F.size("spans") > 0)


def repeated_in_groups(regions: DataFrame, length: int, group_regions: int, width: int | None = None) -> DataFrame:
    """anchor, region and spans of distinct regions (anchor, region, copies, kinds, place, bytes) of groups of several.

    width: how many places of the anchor the strings of a group may have; large groups are split to fewer.
    """
    import pyarrow as pa

    width = width or length - GRAM + 1
    found = sorted_groups(regions.where(F.col("kinds") <= group_regions), length)
    large = regions.where(F.col("kinds") > group_regions)
    if large.isEmpty():
        return found
    step = -(-width // RANGES)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for anchor, region, copies, _, place, data in zip(*(c.to_pylist() for c in batch.columns)):
                starts = len(data) - length + 1
                # The string that starts at s has the anchor at place - s: ranges of that are ranges of s.
                for low in range((place - starts + 1) // step * step, place + 1, step):
                    first, last = max(0, place - low - step + 1), min(starts - 1, place - low)
                    if first <= last:
                        common = data[place - low : place - low - step + 1 + length]
                        piece = data[first : last + length]
                        group, kind = (int.from_bytes(hashlib.blake2b(x, digest_size=8, salt=low.to_bytes(4, "little", signed=True)).digest(), "little", signed=True) for x in (common, piece + (place - first).to_bytes(4, "little", signed=True)))
                        out.append((anchor, region, first, copies, group, kind, place - first, piece))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["anchor", "region", "shift", "copies", "part", "piece", "place", "bytes"])

    pieces = materialize(
        large.select("anchor", "region", "copies", "kinds", "place", "bytes").mapInArrow(split, "anchor long, region long, shift int, copies long, part long, piece long, place long, bytes binary"), "pieces"
    )
    distinct = pieces.groupBy(F.col("part").alias("anchor"), F.col("piece").alias("region")).agg(F.sum("copies").alias("copies"), F.any_value("place").alias("place"), F.any_value("bytes").alias("bytes"))
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    sized = materialize(distinct.join(groups, "anchor").select("anchor", "region", "copies", "kinds", "place", "bytes"), "parts")
    alone = sized.where("kinds = 1 and copies > 1").select("anchor", "region", F.array(F.lit(0), F.octet_length("bytes")).alias("spans"))
    rest = repeated_in_groups(sized.where("kinds > 1"), length, group_regions, step)
    again = alone.unionByName(rest).select(F.col("anchor").alias("part"), F.col("region").alias("piece"), "spans")
    moved = pieces.select("anchor", "region", "shift", "part", "piece").join(again, ["part", "piece"]).select("anchor", "region", F.transform("spans", lambda s: s + F.col("shift")).alias("own"))
    return found.unionByName(moved.groupBy("anchor", "region").agg(F.flatten(F.collect_list("own")).alias("spans")))  # RANGES + 1 pieces a region


def cut_repeats(docs: DataFrame, length: int, id_col: str, text_col: str, group_regions: int, as_text: bool = False) -> tuple[DataFrame, str, str]:
    """The columns of docs, but for the text, with removed spans and what is kept (bytes, or a text without the rest of cut characters), and the names of these two."""
    import pyarrow as pa

    raw_name, key_name, spans_name, removed_name, kept_name, doc_key = free_names(docs.columns, "__raw", "__key", "__spans", "__removed", "__kept", "__doc_key")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn(raw_name, raw.cast("binary")).withColumn(doc_key, F.xxhash64(F.col(id_col).cast("string"), raw_name))
    plain = keyed.select(F.col(doc_key).alias("key"), F.col(raw_name).alias("text"), F.lit(1).cast("long").alias("n"))
    kinds = "anchor long, region long, key long, first int, last int, place int, n long"
    spark = docs.sparkSession
    # Rows repeated whole: one of each, with their number. Keys alone are counted; texts move only where there are such rows.
    by_key = materialize(plain.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "rows-by-key")
    rows, most = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most > 1:
        again = by_key.where("n > 1")
        copies = plain.drop("n").join(again, "key").groupBy("key").agg(F.any_value("text").alias("text"), F.max("n").alias("n"))
        plain = plain.join(again.select("key"), "key", "left_anti").select("key", "text", "n").unionByName(materialize(copies, "copied-rows"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(texts: list[bytes], keys: np.ndarray, n: np.ndarray, shift: int = 0) -> pa.RecordBatch:
            owner, first, last, place, anchor, region = anchored(b"".join(texts), np.array([len(t) for t in texts]), length)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((anchor, pa.int64()), (region, pa.int64()), (keys[owner], pa.int64()), (first + shift, pa.int32()), (last + shift, pa.int32()), (place, pa.int32()), (n[owner], pa.int64()))],
                names=["anchor", "region", "key", "first", "last", "place", "n"],
            )

        for batch in batches:
            keys, texts, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size + len(texts[to]) <= PIECE:
                    size += len(texts[to])
                    to += 1
                if to > at:
                    yield some(texts[at:to], keys[at:to], n[at:to])
                    at = to
                else:  # a longer text, in pieces that overlap by all but one byte of a string
                    for begin in range(0, len(texts[at]) - length + 1, PIECE):
                        yield some([texts[at][begin : begin + PIECE + length - 1]], keys[at : at + 1], n[at : at + 1], begin)
                    at += 1
        give_back()

    def in_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of anchor: those whose anchor a neighbour has too. Keeps one row from batch to batch."""
        held, held_used = None, False
        for batch in batches:
            if not len(batch):
                continue
            anchor = batch.column(0).to_numpy()
            alike = np.concatenate([[False], anchor[1:] == anchor[:-1]])
            if held is not None and held.column(0)[0].as_py() == anchor[0]:
                alike[0] = True
                if not held_used:
                    yield held
            used = alike | np.concatenate([alike[1:], [False]]) | np.isin(anchor, frequent.value) | (batch.column(6).to_numpy() > 1)
            held, held_used = batch.slice(len(batch) - 1, 1), bool(used[-1])
            yield batch.filter(pa.array(used))

    # Anchors that are frequent in a bounded sample are in company, wherever their rows go: they are dealt to many tasks.
    some = plain.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, rows // SAMPLE_DOCS))) == 0)
    often = some.mapInArrow(find, kinds).groupBy("anchor").count().where("count >= 8").orderBy(F.desc("count"), "anchor").limit(HOT_ANCHORS)
    frequent = spark.sparkContext.broadcast(often.select("anchor").toArrow().column(0).to_numpy())  # HOT_ANCHORS at most
    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = np.isin(batch.column(0).to_numpy(), frequent.value)
            salt = np.where(hot, batch.column(2).to_numpy() % HOT_SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt)], names=[*batch.schema.names, "salt"])

    found = plain.mapInArrow(lambda batches: salted(find(batches)), kinds + ", salt int")
    dealt = found.repartition("anchor", "salt").drop("salt").sortWithinPartitions("anchor")
    active = materialize(dealt.mapInArrow(in_company, kinds), "regions")
    release(spark)
    distinct = active.groupBy("anchor", "region").agg(F.sum("n").alias("copies"), F.min(F.struct("key", "first", "last", "place")).alias("r"))
    distinct = materialize(distinct.select("anchor", "region", "copies", "r.*"), "distinct-regions")
    release(spark)
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    sized = distinct.join(groups, "anchor")

    # 2. Groups of equal regions.
    alone = sized.where("kinds = 1 and copies > 1").selectExpr("anchor", "region", f"array(0, last - first + {length}) spans")

    # 3. Groups of several: their texts, cut from the documents that hold them.
    mixed = sized.where("kinds > 1").select("key", F.struct("anchor", "region", "copies", "first", "last", "place", "kinds").alias("x"))
    wanted = mixed.groupBy("key").agg(F.collect_list("x").alias("xs"))
    one = plain.join(wanted, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            flat = [(x, t[x["first"] : x["last"] + length]) for xs, t in zip(rows, texts) for x in xs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x, _ in flat], pa.int64()) for c in ("anchor", "region", "copies", "kinds", "place")] + [pa.array([b for _, b in flat], pa.binary())],
                names=["anchor", "region", "copies", "kinds", "place", "bytes"],
            )

    regions = one.select("text", "xs").mapInArrow(cut, "anchor long, region long, copies long, kinds long, place long, bytes binary")
    regions = materialize(regions, "region-bytes")
    release(spark)
    found = repeated_in_groups(regions, length, group_regions)
    spans = alone.unionByName(found)
    spans = materialize(spans, "spans")
    discard(distinct)
    discard(regions)
    release(spark)
    placed = active.join(spans, ["anchor", "region"]).select("key", F.transform("spans", lambda s: s + F.col("first")).alias("own"))
    by_doc = placed.groupBy("key").agg(F.flatten(F.collect_list("own")).alias(spans_name)).withColumnRenamed("key", key_name)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in pieces_of(b, b.schema.get_field_index(raw_name))):
            merged, kept = [], []
            raws, own = batch.column(batch.schema.get_field_index(raw_name)), batch.column(batch.schema.get_field_index(spans_name))
            for n in range(len(batch)):
                text, got = raws[n].as_py(), own[n].values
                if got is None or not len(got):
                    merged.append([])
                    kept.append(text)
                    continue
                pairs = got.to_numpy().reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                far = np.maximum.accumulate(pairs[:, 1])
                cuts = np.flatnonzero(pairs[1:, 0] > far[:-1])
                begin, end = pairs[np.concatenate([[0], cuts + 1]), 0], far[np.append(cuts, len(far) - 1)]
                merged.append(np.stack([begin, end], 1).ravel().astype(np.int32))
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            rest = [c for name, c in zip(batch.schema.names, batch.columns) if name not in (raw_name, spans_name, key_name, doc_key)]
            names = [name for name in batch.schema.names if name not in (raw_name, spans_name, key_name, doc_key)]
            del raws, own
            shown = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(merged, pa.list_(pa.int32())), shown], names=[*names, removed_name, kept_name])

    joined = keyed.drop(text_col).join(by_doc, F.col(doc_key) == F.col(key_name), "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    out = joined.mapInArrow(merge, (fields + ", " if fields else "") + f"`{removed_name}` array<int>, `{kept_name}` " + ("string" if as_text else "binary"))
    return out, removed_name, kept_name


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, the text without what repeats; of a character that is cut, what is left goes too."""
    left, _, kept = cut_repeats(docs, length, id_col, text_col, GROUP_REGIONS, as_text=True)
    return left.select(*[F.col(f"`{kept}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def repeat_digest(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs."""
    out = remove_repeats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), length)
    kept, n = F.octet_length("kept").cast("long"), F.size("removed_spans")
    gone = F.aggregate("removed_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["s"] + a["sign"] * x).alias("s"), (-a["sign"]).alias("sign")), lambda a: a["s"])
    return out.select("doc_id", (kept + gone).alias("n_bytes"), gone.alias("n_removed"), (n / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
