"""Token ids as binary files, one wavelet matrix a shard, in ascending order of documents.

Documents are put in order by ranges of doc_id, so that each task holds a run of them; it encodes whole texts with the
tokenizers library, appends `end` to each, and closes a file where a document takes it past SHARD_TOKENS. A file that is
written gets a line in a manifest table, which Spark commits: files of tasks that were lost or ran twice are in no line and
are never read. Places of files come from the manifest by sums of parts; nothing but lines of the manifest and the number of
parts reaches one task. Readers take files, not partitions, so that their work is dealt anew.

The library sees a text's words once each: where a single space stands between other characters, the byte-level split has
a border before it, so the ids of a text are those of its pieces from border to border, and pieces are kept in a bounded
cache. A vocabulary whose file asks for anything but the plain byte-level split gets whole texts.

Rows: a null text is empty and has the end id alone. Rows without doc_id stand first. Rows repeated under one doc_id follow each
other in the order of their texts' hashes. Texts are whole, a document lies in one file. An empty table gives no file and an
empty table. Other columns are not read. doc_id has to be a whole number.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import begin, give_back, kept_in_worker, materialize, pieces_of, shared_dir
from .wavelet import WaveletFile, pack

#: Ids of a file, after which it is closed; words of a cache, and their characters; characters encoded at a time;
#: bytes from which a text is encoded alone; bytes of texts whose words are numbered together.
SHARD_TOKENS, CACHE_WORDS, CACHE_CHARS, CHUNK, LONG, SLICE = 1 << 22, 300_000, 40, 1 << 18, 1 << 23, 1 << 23
READ_TASKS = 10_000
#: Words that the library encodes as one text.
TOGETHER = 4_000
DOUBLE = re.compile(r"\s\s")
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Letters that every version of Unicode holds for letters, and marks other than the apostrophe (contractions): where one ends, a piece ends.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
LATIN, MARKED = re.compile(f"[{LETTERS}]+"), re.compile(f"([{LETTERS}]+)([{MARKS}]+)")
LATIN_LETTERS = "".join(chr(n) for n in range(0x250) if LATIN.match(chr(n)))
MARK_CHARS = "".join(chr(n) for n in range(128) if re.match(f"[{MARKS}]", chr(n)))
#: White space as str.strip takes it.
WHITE = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def packed_array(offsets: np.ndarray, data):
    """An Arrow array of binary values that follow each other in `data`, from `offsets`."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def joined_up(entries, which: np.ndarray, cuts: np.ndarray):
    """Values put together from entries: those of which[cuts[n]:cuts[n + 1]] make value n."""
    import pyarrow as pa

    taken = entries.take(pa.array(which))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][: len(which) + 1]
    return packed_array(offsets[cuts], taken.buffers()[2] or b"")


class Kept:
    """A bounded cache of words and their packed ids, in two Arrow arrays: some 40 bytes a word, where a dictionary takes 250."""

    def __init__(self):
        import pyarrow as pa

        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.now = np.zeros(0, np.int64), 0

    def get(self, words, encode):
        """The ids of distinct words; encode(list) gives those of the ones that aren't here."""
        import pyarrow as pa
        import pyarrow.compute as pc

        self.now += 1
        found = pc.index_in(words, value_set=self.words)
        new = words.filter(found.is_null())
        got = encode(new.to_pylist())
        missing = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.used[at[~missing]] = self.now
        at[missing] = len(self.ids) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, got]).take(pa.array(at))
        short = pc.less_equal(pc.utf8_length(new), CACHE_CHARS)
        self.words, self.ids = pa.concat_arrays([self.words, new.filter(short)]), pa.concat_arrays([self.ids, got.filter(short)])
        self.used = np.concatenate([self.used, np.full(len(self.words) - len(self.used), self.now)])
        if len(self.words) > 2 * CACHE_WORDS:  # those used last stay
            stay = np.sort(np.argsort(-self.used, kind="stable")[: 3 * CACHE_WORDS // 2])
            self.words, self.ids, self.used = self.words.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.used[stay]
        return out


class LibraryEncoder:
    """A text's ids as the library gives them, packed; words are encoded once while they stay in a cache.

    Caches hold stems, words without their marks: one for all words of a slice of texts, one, in two generations, for texts
    that are encoded alone.
    """

    def __init__(self, spec: str, end: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        d = json.loads(spec)
        before, after = d.get("pre_tokenizer") or {}, d.get("post_processor") or {"type": "ByteLevel"}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        # Added tokens that neither reach over a space nor hide in letters with marks behind them.
        added = all(re.fullmatch(r"\S*[^\W\d_]\S*", t["content"]) and re.search(rf"[^{LETTERS}][{LETTERS}]", t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in d.get("added_tokens") or [])
        self.by_words = plain and added and not d.get("normalizer") and after["type"] == "ByteLevel" and not d["model"].get("dropout")
        self.kind, self.code = (np.dtype("<u2"), "H") if self.library.get_vocab_size(True) <= 1 << 16 else (np.dtype("<u4"), "I")
        shown = [n for n in range(256) if 33 <= n <= 126 or 161 <= n <= 172 or 174 <= n <= 255]  # bytes that stand for themselves
        hidden = [n for n in range(256) if n not in set(shown)]
        self.letters = {n: n for n in shown} | {n: 256 + i for i, n in enumerate(hidden)}  # the file format's letter for each byte
        vocabulary = self.library.get_vocab(True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t[:1] == chr(self.letters[32])]] = True
        self.by_lines = Tokenizer(self.model)
        self.by_lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.line_letters = np.array([10 if b == 10 else self.letters[b] for b in range(256)], "<u4")
        self.end = end
        self.marks: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept = {" ": Kept(), "": Kept()}
        self.line_end = self.pieces(["\n"])[0]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, in parts."""
        if not self.by_words:
            yield from self.pieces([text] if text else [])
            return
        at = 0
        while at < len(text):
            border = BORDER.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            to = border.start() if border else len(text)
            first, *words = BORDER.split(text[at:to])
            yield b"".join([*self.pieces([first] if first else []), *map(self.known, words)])
            at = to

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts one after another, the end id behind each, and how many each has.

        Arrow splits the texts at spaces and numbers the distinct words, so that each is looked up once a slice; texts in
        which white space meets a space, and long ones, are encoded alone.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string())
        alone: dict[int, bytes] = {}
        if not self.by_words:
            alone = {n: b"".join(self.encode(t.as_py())) for n, t in enumerate(texts)}
        else:
            for n in np.flatnonzero(pc.binary_length(texts).to_numpy() > LONG).tolist():
                alone[n] = b"".join(self.encode(texts[n].as_py()))
        while True:
            rest = texts if not alone else pc.if_else(pa.array([n not in alone for n in range(len(texts))]), texts, "")
            split = pc.split_pattern(rest, " ")
            begins = split.offsets.to_numpy().astype(np.int64)
            begins -= begins[0]
            coded = split.flatten().dictionary_encode()
            which, distinct = coded.indices.to_numpy(), coded.dictionary
            size = pc.binary_length(distinct).to_numpy()
            spaces = (size == 0) | (pc.binary_length(pc.utf8_trim(distinct, characters=WHITE)).to_numpy() < size)
            odd_first, odd_last = spaces[which], spaces[which]
            odd_first[begins[:-1]], odd_last[begins[1:] - 1] = False, False  # a text's own beginning and end are borders
            if not (odd := np.flatnonzero(odd_first | odd_last)).size:
                break
            for n in np.unique(np.searchsorted(begins, odd, side="right") - 1).tolist():
                alone[n] = b"".join(self.encode(texts[n].as_py()))
        used = np.ones(len(which), bool)
        used[begins[:-1]] = False
        after_space = np.zeros(len(distinct), bool)
        after_space[which[used]] = True
        behind, first = distinct.filter(pa.array(after_space)), distinct.take(pa.array(which[begins[:-1]]))
        entries = pa.concat_arrays([self.ids_of(behind), self.units(first, ""), pa.array([*alone.values(), np.array([self.end], self.kind).tobytes()], pa.large_binary())])
        which = (np.cumsum(after_space, dtype=np.int32) - 1)[which]
        which[begins[:-1]] = len(behind) + np.arange(len(texts))
        which[begins[list(alone)]] = len(behind) + len(texts) + np.arange(len(alone))
        whole = joined_up(entries, np.insert(which, begins[1:], len(entries) - 1), begins + np.arange(len(begins)))
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[: len(texts) + 1]
        return np.frombuffer(whole.buffers()[2], self.kind, int(offsets[-1]) // self.kind.itemsize), np.diff(offsets) // self.kind.itemsize

    def ids_of(self, words):
        """The packed ids of a space and each word after it, of an Arrow array of words; a line's end inside a word is a piece of its own."""
        import pyarrow as pa
        import pyarrow.compute as pc

        lined = pc.match_substring(words, "\n").to_numpy(zero_copy_only=False).copy()
        lined[lined] = [not DOUBLE.search(w) for w in words.filter(pa.array(lined)).to_pylist()]
        if not lined.any():
            return self.units(words, " ")
        split = pc.split_pattern(words.filter(pa.array(lined)), "\n")
        cuts, parts, whole = split.offsets.to_numpy().astype(np.int64), split.flatten(), words.filter(pa.array(~lined))
        cuts -= cuts[0]
        first = np.zeros(len(parts), bool)
        first[cuts[:-1]] = True
        behind = pa.concat_arrays([whole, parts.filter(pa.array(first))])
        entries = pa.concat_arrays([self.units(behind, " "), self.units(parts.filter(pa.array(~first)), ""), pa.array([self.line_end], pa.large_binary())])
        which = np.where(first, len(whole) + np.cumsum(first) - 1, len(behind) + np.cumsum(~first) - 1)
        own = joined_up(entries, np.insert(which, np.flatnonzero(~first), len(entries) - 1), cuts + np.concatenate([[0], np.cumsum(~first)])[cuts])
        at = np.where(lined, len(whole) + np.cumsum(lined) - 1, np.cumsum(~lined) - 1)
        return pa.concat_arrays([entries.slice(0, len(whole)), own]).take(pa.array(at))

    def units(self, words, space: str):
        """The packed ids of space and each word: of Latin letters with marks behind them, those of both."""
        import pyarrow as pa
        import pyarrow.compute as pc

        tails = pc.utf8_ltrim(words, characters=LATIN_LETTERS)
        marked = pc.and_(pc.equal(pc.binary_length(pc.ascii_rtrim(tails, characters=MARK_CHARS)), 0), pc.less(pc.binary_length(tails), pc.binary_length(words)))
        coded = pc.if_else(marked, pc.ascii_rtrim(words, characters=MARK_CHARS), words).dictionary_encode()
        tails = pc.if_else(marked, tails, "").dictionary_encode()
        ends = pa.array([m and (self.marks.get(m) or self.after_letters(m)) or b"" for m in tails.dictionary.to_pylist()], pa.large_binary())
        stems = self.kept[space].get(coded.dictionary, self.together if space else lambda new: pa.array([self.spaced(w, "") for w in new], pa.large_binary()))
        return pc.binary_join_element_wise(stems.take(coded.indices), ends.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def together(self, words: list[str]):
        """The packed ids of a space and each word after it, many words a text.

        Words of Latin letters are one piece each and go to the merges without the split.
        """
        import pyarrow as pa

        latin = np.array([LATIN.fullmatch(w) is not None for w in words], bool)
        if latin.all():
            return self.joined(words, self.by_lines)
        one, two = (self.joined([w for w, own in zip(words, mine.tolist()) if own], library) for mine, library in ((latin, self.by_lines), (~latin, self.library)))
        return pa.concat_arrays([one, two]).take(pa.array(np.where(latin, np.cumsum(latin), len(one) + np.cumsum(~latin)) - 1))

    def joined(self, words: list[str], library):
        """The same: each begins with a token that begins with a space, and holds no other."""
        import pyarrow as pa

        out = [pa.array([], pa.large_binary())]
        for at in range(0, len(words), TOGETHER):
            own = words[at : at + TOGETHER]
            if library is self.library:
                text = " " + " ".join(own)
            else:
                text = self.line_letters[np.frombuffer((" " + "\n ".join(own)).encode(), np.uint8)].tobytes().decode("utf-32-le")
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == len(own):
                out.append(packed_array(np.append(begins, len(ids)) * self.kind.itemsize, ids))
            else:
                out.append(pa.array(self.pieces([" " + w for w in own]), pa.large_binary()))
        return pa.concat_arrays(out)

    def known(self, word: str) -> bytes:
        """The ids of a space and the word after it: of letters with marks behind them, those of both."""
        if word.isalpha():
            return self.stems.get(word) or self.spaced(word)
        marked = MARKED.fullmatch(word)
        if marked:
            stem, marks = marked.groups()
            return (self.stems.get(stem) or self.spaced(stem)) + (self.marks.get(marks) or self.after_letters(marks))
        return self.stems.get(word) or self.spaced(word)

    def after_letters(self, marks: str) -> bytes:
        got = self.pieces([marks])[0]
        if len(marks) <= CACHE_CHARS:
            if len(self.marks) >= CACHE_WORDS:
                self.marks.clear()
            self.marks[marks] = got
        return got

    def spaced(self, word: str, space: str = " ") -> bytes:
        """The same of a word that isn't in the newer cache; without a space, of a word after a line's end, not kept."""
        got = self.older.get(word) if space else None
        if got is None:
            if word.isalpha() and LATIN.fullmatch(word):  # one piece for the merges, without the split
                mapped = (space + word).encode().decode("latin-1").translate(self.letters)
                got = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            elif "\n" in word and not DOUBLE.search(word):
                first, *rest = word.split("\n")
                parts = [self.known(first) if space else self.spaced(first, ""), *(self.line_end + self.spaced(x, "") for x in rest)]
                return b"".join(parts)
            else:
                got = self.pieces([space + word])[0] if space or word else b""
        if space and len(word) <= CACHE_CHARS:
            if len(self.stems) >= CACHE_WORDS:
                self.older, self.stems = self.stems, {}
            self.stems[word] = got
        return got


_encoders: dict[int, LibraryEncoder] = kept_in_worker("token_files")


def encoder(spec: str, end: int) -> LibraryEncoder:
    """One a worker and vocabulary."""
    if (key := hash(spec)) not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(spec)
    _encoders[key].end = end
    return _encoders[key]


def even(texts) -> int:
    """Bytes of a slice when texts are cut into equal ones of about SLICE: a look at the cache costs as much for a small one."""
    import pyarrow.compute as pc

    total = pc.sum(pc.binary_length(texts)).as_py() or 0
    return total // max(1, round(total / SLICE)) + 1


def _open(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def wavelet_file(uri: str) -> WaveletFile:
    system, path = _open(uri)
    source = system.open_input_file(path)
    return WaveletFile(lambda at, size: source.read_at(size, at))


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return their manifest: part, seq, file, n_docs, n_tokens; files follow each other by part and seq.

    vocabulary: a driver-side path to the tokenizer's JSON file; its bounded text (a few MB) is broadcast.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark)}/eventloom/tokens-{uuid.uuid4().hex}").rstrip("/")
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("token_files")
        encode = encoder(spec.value, end)
        system, path = _open(folder)
        part, run_id, seq = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # of each slice: document ids, lengths, ids

        def close() -> pa.RecordBatch:
            nonlocal held, seq
            doc_ids, sizes, ids = (np.concatenate([h[i] for h in held]) if i else pa.concat_arrays([h[0] for h in held]) for i in range(3))
            held, seq = [], seq + 1
            name = f"part-{part:06d}-{seq:05d}-{run_id}.wtok"
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(pack(ids, doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), sizes))
            values = ([part], [seq], [f"{folder}/{name}"], [len(sizes)], [len(ids)])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "file", "n_docs", "n_tokens"])

        for batch in (x for b in batches for x in pieces_of(b, 1, even(b.column(1)))):
            if not len(batch):
                continue
            ids, sizes = encode.encode_all(batch.column(1))
            upto, at = np.cumsum(sizes), 0
            while at < len(sizes):
                room = shard_tokens - sum(len(h[2]) for h in held)
                before = upto[at] - sizes[at]
                to = min(int(np.searchsorted(upto, before + room)) + 1, len(sizes))
                held.append((batch.column(0).slice(at, to - at), sizes[at:to], ids[before : upto[to - 1]]))
                if upto[to - 1] - before >= room:
                    yield close()
                at = to
        if held:
            yield close()
        encode.older = {}
        give_back()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(run, MANIFEST), "manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with `start`: the ids in all files before. A line for each part meets in one task, no more."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return inside.join(parts, "part").select("part", "seq", "file", "n_docs", "n_tokens", (F.col("base") + F.col("inside")).cast("long").alias("start"))


def by_file(manifest: DataFrame, read, schema: str) -> DataFrame:
    """read(file, start) -> Arrow batches, for every file; files are dealt to tasks of their own, READ_TASKS at most."""
    lines = materialize(placed(manifest), "placed-files")
    tasks = max(1, min(lines.count(), READ_TASKS))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read(file, start)
        give_back()

    return lines.select("file", "start").repartition(tasks, "file").mapInArrow(run, schema)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, and the ids themselves on demand, from the files alone."""
    import pyarrow as pa

    def read(file: str, start: int) -> Iterator[pa.RecordBatch]:
        whole = wavelet_file(file)
        doc_ids, null, sizes = whole.documents()
        ids = whole.ids().astype("<u4")
        begins = np.concatenate([[0], np.cumsum(sizes)])
        sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        columns = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(begins[:-1] + start), pa.array(sizes), pa.array(sums, pa.int64())]
        for a in range(0, len(sizes), 1024) if with_ids else ():
            b = min(a + 1024, len(sizes))
            own = pa.ListArray.from_arrays(pa.array((begins[a : b + 1] - begins[a]).astype(np.int32)), pa.array(ids[begins[a] : begins[b]].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in columns), own], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
        if not with_ids:
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return by_file(manifest, read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def count_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token and n: how often each of a list of ids stands in all files; two ranks a plane and file."""
    import pyarrow as pa

    def read(file: str, start: int) -> Iterator[pa.RecordBatch]:
        whole = wavelet_file(file)
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([whole.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    found = by_file(manifest, read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    every = manifest.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token long")
    return every.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def find_tokens(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """token, position (among all ids), doc_id and offset of every occurrence of some ids, by select."""
    import pyarrow as pa

    def read(file: str, start: int) -> Iterator[pa.RecordBatch]:
        whole = wavelet_file(file)
        doc_ids, null, sizes = whole.documents()
        begins = np.cumsum(sizes) - sizes
        for token in dict.fromkeys(tokens):
            for at in whole.occurrences(token):
                doc = np.searchsorted(begins, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), token)), pa.array(at + start), pa.array(doc_ids[doc], pa.int64(), mask=null[doc]), pa.array(at - begins[doc])], names=["token", "position", "doc_id", "offset"]
                )

    return by_file(manifest, read, "token long, position long, doc_id long, offset long")


def tokens_at(spark: SparkSession, manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """position and token of positions (a column of that name) among all ids; those beyond the end are left out."""
    import pyarrow as pa

    files = placed(manifest).select("file", "start", (F.col("start") + F.col("n_tokens")).alias("until"))
    edges = [r[0] for r in files.select("start").orderBy("start").collect()]  # a number a file
    shared = spark.sparkContext.broadcast(np.array(edges or [0], np.int64))

    def where(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            own = shared.value[np.maximum(np.searchsorted(shared.value, at, side="right") - 1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=["position", "start"])

    asked = positions.select(F.col("position").cast("long")).where("position >= 0").mapInArrow(where, "position long, start long")

    def look(rows: pa.Table) -> pa.Table:
        start = rows["start"][0].as_py()
        at = rows["position"].to_numpy()
        return pa.table({"position": pa.array(at), "token": pa.array(wavelet_file(rows["file"][0].as_py()).access(at - start))})

    return asked.join(files, "start").where("position < until").groupBy("file").applyInArrow(look, "position long, token long")


def token_digests(docs: DataFrame, vocabulary: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files of docs and return doc_id, start, n_tokens and ids_crc32 as read back from them."""
    return read_tokens(write_tokens(docs, vocabulary, shard_tokens=shard_tokens))
