"""Scalar functions on sequences, names and small arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a batch whose k-mers are coded at a time.
LETTERS = 4_000_000
_BASE = np.full(256, 4, np.uint8)
_BASE[[65, 67, 71, 84]] = _BASE[[97, 99, 103, 116]] = np.arange(4)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def is_dna(seq: Column, n: bool = True) -> Column:
    """Only A, C, G, T (and N), in either case; an empty sequence is."""
    return seq.rlike("^[ACGTNacgtn]*$" if n else "^[ACGTacgt]*$")


def encode(seq: Column) -> Column:
    """A k-mer of at most 31 letters as its number in base four (A 0, C 1, G 2, T 3); null if it holds another letter."""
    digits = F.translate(F.upper(seq), "ACGT", "0123")
    return F.when((F.length(seq) <= 31) & digits.rlike("^[0-3]+$"), F.conv(digits, 4, 10).cast("long"))


def decode(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmers(seq: Column, k: int, chunk: int = 256) -> Column:
    """All windows of k letters, in order; none for a shorter or null sequence.

    Taken chunk by chunk, since finding a letter in a string takes time in proportion to its place."""
    n = F.length(seq) - k

    def windows(o: Column) -> Column:
        c = F.substring(seq, o + 1, F.lit(chunk + k - 1))
        return F.transform(F.sequence(F.lit(0), F.length(c) - k), lambda i: F.substring(c, i + 1, F.lit(k)))

    return F.when(n >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0)), F.lit(chunk)), windows))).otherwise(F.array().cast("array<string>"))


def explode_kmers(df: DataFrame, seq: str, k: int, name: str = "kmer", chunk: int = 256) -> DataFrame:
    """Every row once per window of k letters of its sequence, in generated code: chunks first, then windows."""
    n = F.length(seq)
    pieces = df.where(n >= k).withColumn("_c", F.explode(F.sequence(F.lit(0), n - k, F.lit(chunk)))).withColumn("_c", F.substring(F.col(seq), F.col("_c") + 1, F.lit(chunk + k - 1)))
    rows = pieces.drop(seq).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_c") - (k - 1))))
    return rows.withColumn(name, F.substring(F.col("_c"), F.col("_i"), F.lit(k))).drop("_c", "_i")


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def slice_of(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases [start, end) of a sequence; of the reverse complement of them if strand is 1."""
    part = F.substring(seq, start + 1, end - start)
    return F.when(strand == 1, reverse_complement(part)).otherwise(part)


def homopolymer(seq: Column, n: int) -> Column:
    """A run of at least ``n`` equal bases."""
    return F.upper(seq).rlike("|".join(f"{b}{{{n}}}" for b in "ACGT"))


def words(text: Column, sep: str = r"\s+") -> Column:
    """Parts between separators (a pattern), without empty ones."""
    return F.filter(F.split(text, sep), lambda w: w != "")


def size_number(text: Column) -> Column:
    """4k, 3M or 2g as a number, in steps of 1024; null for anything else."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*(\d+)[kmgKMG]?\s*$", 1), F.lit("999999999999999999"))
    unit = F.lower(F.regexp_extract(text, r"^\s*\d+([kmgKMG])?\s*$", 1))
    return (number * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)).cast("long")


def numbered(pattern: str, number: Column) -> Column:
    """The pattern with its first {} replaced."""
    head, _, tail = pattern.partition("{}")
    return F.concat(F.lit(head), number.cast("string"), F.lit(tail))


def end_id(read: Column, end: Column) -> Column:
    """A read's end as one signed number: id + 1 for end 0, -id - 1 for end 1."""
    return F.when(end == 0, read + 1).otherwise(-read - 1)


def end_read(eid: Column) -> Column:
    return F.abs(eid) - 1


def end_side(eid: Column) -> Column:
    return F.when(eid > 0, 0).otherwise(1)


def end_reverse(eid: Column) -> Column:
    return -eid


def vector_counts(a: Column, b: Column) -> Column:
    """struct(same, different) of two arrays of -1, 0, 1; a 0 on either side counts for neither."""
    both = F.zip_with(a, b, lambda x, y: x * y)
    return F.struct(F.size(F.filter(both, lambda p: p > 0)).alias("same"), F.size(F.filter(both, lambda p: p < 0)).alias("different"))


def mean_offset(t_pos: Column, q_pos: Column, same: Column) -> Column:
    """The mean offset of a query on a target over shared sites (an aggregate): t - q on the same strand, else t + q."""
    return F.when(F.max(same.cast("int")) == 1, F.call_function("div", F.sum(t_pos - q_pos), F.count(t_pos))).otherwise(F.call_function("div", F.sum(t_pos + q_pos), F.count(t_pos)))


def _codes(letters: np.ndarray, k: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, code) of the windows of k letters A, C, G, T; with ``both`` the smaller code of the two strands."""
    base = _BASE[letters]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ahead, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        digit = (base[i : i + n] & 3).astype(np.int64)
        ahead = (ahead << 2) | digit
        if both:
            back |= (3 - digit) << (2 * i)
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    at = np.flatnonzero(bad[k:] == bad[: n])
    return at, np.minimum(ahead, back)[at] if both else ahead[at]


def _parts(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(letters, row of each window's start or -1, rows) of some sequences at a time, joined by a letter that is no base."""
    texts = batch.column(batch.num_columns - 1).to_pylist()
    held: list[bytes] = []
    rows: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t and len(t) >= k:
            held.append(t.encode("latin-1", "replace"))
            rows.append(i)
            size += len(t) + 1
        if held and (size >= LETTERS or i == len(texts) - 1):
            lens = np.array([len(x) + 1 for x in held])
            yield np.frombuffer(b"-".join(held) + b"-", np.uint8), np.repeat(np.arange(len(held)), lens), np.array(rows)
            held, rows, size = [], [], 0
    if held:
        lens = np.array([len(x) + 1 for x in held])
        yield np.frombuffer(b"-".join(held) + b"-", np.uint8), np.repeat(np.arange(len(held)), lens), np.array(rows)


def count_codes(df: DataFrame, seq: str, k: int, both: bool = True) -> DataFrame:
    """(code, n): how often each k-mer (k to 31, see ``encode``) stands in the sequences, either case; with ``both`` the smaller
    code of the two strands. Counted within a batch first, so codes and counts are shuffled and no strings."""
    if not 1 <= k <= 31:
        raise ValueError("k must lie between 1 and 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, _, _ in _parts(batch, k):
                code, n = np.unique(_codes(letters, k, both)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])

    return df.select(seq).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def read_codes(df: DataFrame, key: str, seq: str, k: int, both: bool = True) -> DataFrame:
    """(key, kmer): the distinct codes of the k-mers of every row; ``key`` is a whole number."""
    if not 1 <= k <= 31:
        raise ValueError("k must lie between 1 and 31")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for letters, row, rows in _parts(batch, k):
                at, code = _codes(letters, k, both)
                pairs = np.unique(np.stack([keys[rows[row[at]]].astype(np.int64), code], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=[key, "kmer"])

    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), seq).mapInArrow(run, f"`{key}` long, kmer long").distinct()
