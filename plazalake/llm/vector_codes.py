"""Compression of vectors to codes: exact products of whole numbers by limbs.

Distances decide, so they must be exact: entries are split into limbs so small that
a product of limb matrices in double precision, by BLAS, has sums below 2^53. The
products are put together again in 64 bits, and the first least distance wins.
Codebooks are small (parts x entries); sums for their updates are folded by task and
then by entry, so nothing grows with the number of rows but the map itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot
from .vectors import common_length, matrix, scaled, usable

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows whose distances to all entries are in memory at once.
ROWS = 1024
#: Distinct labels that may be broadcast with their sums.
LABELS = 100_000
LONG = 1 << 63


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed limbs of x as doubles, lowest first: x = sum of limb * 2^(bits * place), each below 2^bits in size."""
    sign, left, out = np.sign(x), np.abs(x), []
    while True:
        out.append((sign * (left & ((1 << bits) - 1))).astype(float))
        left = left >> bits
        if not left.any():
            return out


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y' of whole numbers (..., rows, length) and (..., entries, length), in 64 bits. The true values must fit."""
    bits = (53 - int(x.shape[-1]).bit_length()) // 2
    right = [b.swapaxes(-1, -2) for b in limbs(y, bits)]
    out = 0
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out = out + (np.matmul(a, b).astype(np.int64) << (bits * (i + j)))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts x (part, row, length): place of the nearest entry of book (part, entry, length), of ties the first, and its squared distance.

    Both int64 where that holds all distances, else Python's integers.
    """
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[-1] < LONG:
        products = exact_products(x, book)
        square = np.square(x).sum(-1)
    else:
        x, book = x.astype(object), book.astype(object)
        products = np.stack([a @ b.T for a, b in zip(x, book, strict=True)])
        square = (x * x).sum(-1)
    distance = (book * book).sum(-1)[:, None, :] - 2 * products
    at = distance.argmin(-1)
    return at, np.take_along_axis(distance, at[..., None], -1)[..., 0] + square


def _parts(column, d: int, parts: int) -> np.ndarray:
    """(part, row, length) of an Arrow column of lists; the last part is filled up with zeros."""
    x = matrix(column, d, np.int64)
    wide = -(-d // parts) * parts
    if wide > d:
        x = np.concatenate((x, np.zeros((len(x), wide - d), np.int64)), 1)
    return x.reshape(len(x), parts, wide // parts).swapaxes(0, 1)


def _steps(batches, place: int, d: int, parts: int):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, _parts(piece.column(place), d, parts)


def first_book(rows: DataFrame, d: int, id_col: str, parts: int, entries: int) -> np.ndarray:
    """(part, entry, length): the vectors of the smallest ids, ascending; of one id the smaller vector first, null ids last."""
    first = rows.orderBy(F.asc_nulls_last(id_col), "x").limit(entries).select("x").toArrow()
    return _parts(first.column(0), d, parts)


def improve(rows: DataFrame, d: int, book: np.ndarray) -> np.ndarray:
    """Every entry becomes the floor of the mean of the parts nearest to it; entries without any stay."""
    parts, entries, length = book.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), object)
        for _, x in _steps(batches, 0, d, parts):
            at, _ = nearest(x, book)
            # a product with the 0/1 matrix of assignments, in halves of 26 bits: exact for any batch
            for p in range(parts):
                one = np.equal(at[p][None, :], np.arange(entries)[:, None]).astype(float)
                count[p] += one.sum(1).astype(np.int64)
                low, high = x[p] & ((1 << 26) - 1), x[p] >> 26
                total[p] += (one @ low).astype(np.int64).astype(object) + (one @ high).astype(np.int64).astype(object) * (1 << 26)
        keys = np.flatnonzero(count.ravel())
        sums = total.reshape(-1, length)[keys]
        columns = [pa.array([str(s) for s in sums[:, j]], pa.string()) for j in range(length)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(count.ravel()[keys]), *columns], names=names)

    names = ["key", "n", *[f"s{j}" for j in range(length)]]
    sums = rows.select("x").mapInArrow(run, "key long, n long, " + ", ".join(f"s{j} string" for j in range(length)))
    folded = sums.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(length)])
    out = book.copy().reshape(-1, length)
    for r in folded.collect():  # an entry each
        out[r["key"]] = [int(r[f"s{j}"]) // r["n"] for j in range(length)]
    return out.reshape(book.shape)


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all integers of the codebooks in decimals, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def train(rows: DataFrame, d: int, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    book = first_book(rows, d, id_col, parts, entries)
    for _ in range(rounds):
        book = improve(rows, d, book)
    return book


def encode(rows: DataFrame, d: int, book: np.ndarray) -> DataFrame:
    """rows with code (two hex digits a part, or four where a codebook has over 256 entries) and error in place of x."""
    parts, digits = book.shape[0], 2 if book.shape[1] <= 256 else 4
    others = [f for f in rows.schema.fields if f.name != "x"]
    place = rows.columns.index("x")

    def run(batches):
        for piece, x in _steps(batches, place, d, parts):
            at, error = nearest(x, book)
            raw = np.ascontiguousarray(at.T.astype(">u1" if digits == 2 else ">u2"))
            text, wide = raw.tobytes().hex(), parts * digits
            codes = [text[i * wide : (i + 1) * wide] for i in range(piece.num_rows)]
            total = [int(e) for e in error.astype(object).sum(0)]
            kept = [piece.column(i) for i in range(piece.num_columns) if i != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(codes, pa.string()), pa.array([e if e < LONG else None for e in total], pa.int64())], names=[*(f.name for f in others), "code", "error"])

    return rows.mapInArrow(run, T.StructType([*others, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, book: np.ndarray, d: int, code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """codes with one more column: the vector of doubles that the code stands for; null codes give null."""
    parts, digits = book.shape[0], 2 if book.shape[1] <= 256 else 4
    kept = codes.drop(out_col)
    place = kept.columns.index(code_col)

    def run(batches):
        for batch in batches:
            out = [None if c is None else (book[np.arange(parts), [int(c[i : i + digits], 16) for i in range(0, parts * digits, digits)]].ravel()[:d] / SCALE).tolist() for c in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.ArrayType(T.DoubleType()))]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error, codebooks_sha256 of each usable vector.

    A vector counts if it isn't null, has the most frequent length (of a tie the longest)
    and holds neither nulls nor entries that aren't finite. Its entries become floor(256 x),
    those beyond 2^52 in size count as that; where the length isn't divisible by the number of
    parts, zeros fill up the last. With fewer rows than entries a codebook has as many as
    there are rows; without rows there is no result. Repeated rows count as often as they
    occur. An error that doesn't fit into a long is null and not summed.
    """
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    rows = usable(vectors.select(F.col(id_col), label.alias("_label"), F.col(vector_col).alias("_v")), "_v")
    d = common_length(rows, "_v")
    rows = rows.where(F.size("_v") == (d or 0)).select(id_col, "_label", scaled(F.col("_v"), SCALE).alias("x"))
    if not d:
        empty = rows.select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.where(F.lit(False))
    book = train(rows, d, id_col, parts, entries, rounds)
    coded = cut(encode(rows, d, book).withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("_label").cast("string")), F.lit(""))).drop("_label"), "codes")
    sums = coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    few = sums.limit(LABELS + 1).count() <= LABELS
    found = coded.join(F.broadcast(sums.drop("n")), "_key") if few else join_hot(coded, sums.drop("n"), "_key", sums)
    return found.select(id_col, "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
