"""Product codes of vectors with integer codebooks.

Vectors of whole numbers are cut into equal parts, each with a codebook of its own. In a round, Arrow batches compute all
distances of their parts to the broadcast codebooks by norm expansion, |x|^2 - 2 x.c + |c|^2, with exact int64 matrix products
(|x|^2 is the same for all entries and only joins the error); the first least one is a part's entry. A task adds up its
parts by entry, a grouped shuffle merges these sums, and the driver gets a row for each entry of each book, whatever the
input's size. Entries that no part uses stay. A last pass gives codes and errors; errors by label are summed before they
are shuffled and come back by a null-safe join of one row a label.

Rows: vectors that are null or hold null or non-finite components take no part. Shorter vectors, and lengths that `parts`
does not divide, count as padded with zeros to the longest kept one. Rows without an id get codes, but stand last for the
first entries; rows repeated under one id are rows each, the least vector first. With fewer rows than entries the books are
shorter. A null label is a label of its own. An empty table gives an empty table. Other columns are not read. Components are
bounded (vectors.MOST_WHOLE), beyond it is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import finite, whole_matrix, whole_numbers

#: Rows of a distance matrix at a time.
ROWS = 4_096


def nearest_entries(x: np.ndarray, book: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance."""
    which, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), ROWS):
        some = x[a : a + ROWS]
        d = norms - 2 * (some @ book.T)
        best = d.argmin(1)
        which[a : a + ROWS] = best
        error[a : a + ROWS] = d[np.arange(len(some)), best] + (some * some).sum(1)
    return which, error


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and codebooks_sha256 of every vector that takes part."""
    import pyarrow as pa

    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")).where(finite(F.col("v")))
    rows = materialize(own.select("vec_id", whole_numbers(F.col("v"), scale).alias("v"), "label"), "whole-vectors")
    kinds = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], kinds)
    width = max(1, -(-longest // parts))
    dim = width * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # `entries` rows
    start = np.array([r[0] + [0] * (dim - len(r[0])) for r in first], np.int64)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]

    def sums_by_entry(shared):
        def run(batches):
            sums, n = np.zeros((parts, len(start), width), np.int64), np.zeros((parts, len(start)), np.int64)
            norms = [(b * b).sum(1) for b in shared.value]
            for batch in batches:
                x = whole_matrix(batch.column(0), dim)
                for p, book in enumerate(shared.value):
                    own_part = x[:, p * width : (p + 1) * width]
                    which, _ = nearest_entries(own_part, book, norms[p])
                    np.add.at(sums[p], which, own_part)
                    n[p] += np.bincount(which, minlength=len(book))
            part, entry = np.nonzero(n)
            if len(part):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
                )

        return run

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts x entries x width numbers
        partial = rows.select("v").mapInArrow(sums_by_entry(shared), "part int, entry int, n long, sums array<long>")
        merged = partial.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)])
        books = [b.copy() for b in books]
        for part, entry, n, *sums in merged.collect():  # parts x entries rows
            books[part][entry] = [int(s) // n for s in sums]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(books)

    def encode(batches):
        norms = [(b * b).sum(1) for b in shared.value]
        for batch in batches:
            x, digits, error = whole_matrix(batch.column(1), dim), np.zeros((len(batch), parts), np.uint8), np.zeros(len(batch), np.int64)
            for p, book in enumerate(shared.value):
                which, more = nearest_entries(x[:, p * width : (p + 1) * width], book, norms[p])
                digits[:, p] = which
                error += more
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(error), batch.column(2)], names=["vec_id", "code", "error", "label"])

    label = own.schema["label"].dataType.simpleString()
    coded = materialize(rows.mapInArrow(encode, f"vec_id long, code string, error long, label {label}"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("other"), "label_error")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("other"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
