"""What the training-data operators share: tables, words, and tables kept for later steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.sources.shared import PLACES, forget, kept, new_folder, shared_dir, told_by_bits  # noqa: F401  (used by the operators)

#: Words that a Python worker remembers, over all its tasks.
WORD_CACHE = 1_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def told_apart(docs: DataFrame, name: str = "mark") -> tuple[DataFrame, bool]:
    """The documents with a column that, with doc_id, tells different texts apart, and whether some
    doc_id (null counts as one) repeats: a hash of the text if so, else 0."""
    twice = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.withColumn(name, F.xxhash64("text") if twice else F.lit(0).cast("bigint")), twice


def whole_rows(docs: DataFrame) -> DataFrame:
    """`(row STRUCT of all columns, doc_id, text)`, whatever the columns are called."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def text_slices(batches: Iterable[pa.RecordBatch], size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece is about `size` bytes: memory stays bounded
    however long the texts are. A single longer text is one piece."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        piece = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(piece)) + 1 if len(piece) else np.zeros(0, np.int64)
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def cells(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column without nulls; for many short ones."""
    _, offsets, data = column.buffers()
    kind = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    flat = data.to_pybytes() if data else b""
    return [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a string column, runs without ASCII white space: the distinct ones as binary, the
    place among them of every word of every text, in order, and each text's number of words. A null
    has no words. Arrow splits and numbers the words, so Python sees distinct ones only."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    codes = split.flatten().dictionary_encode()
    distinct, at = codes.dictionary.cast(pa.binary()), np.asarray(codes.indices, np.int64)
    lengths = np.diff(np.asarray(split.offsets, np.int64))
    empty = pc.index(distinct, b"").as_py()  # before or behind white space at a text's ends
    if empty >= 0:
        none = at == empty
        lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[none], minlength=len(lengths))
        at = at[~none]
    return distinct, at, lengths


#: Values that are put together at a time.
TAKEN = 1 << 20


def gathered(values: pa.Array, at: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The binary values at the places `at`, put together for each text of so many places."""
    size = np.asarray(pc.binary_length(values), np.int64)[at]
    ends = np.append(0, np.cumsum(size))[np.cumsum(lengths)].tolist()
    parts = []
    for lo in range(0, len(at), TAKEN):
        if n := int(size[lo : lo + TAKEN].sum()):
            parts.append(memoryview(values.take(pa.array(at[lo : lo + TAKEN])).buffers()[2])[:n])
    data = b"".join(parts)
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def hashed_words(texts: pa.Array, seed: int) -> list[np.ndarray]:
    """The 64-bit hashes of each text's words."""
    import xxhash

    distinct, at, lengths = words_in(texts)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, seed) for w in cells(distinct)), np.uint64, len(distinct))[at]
    return np.split(hashes, np.cumsum(lengths)[:-1]) if len(lengths) else []


class Remembered(dict):
    """Words and what was computed for them, those used lately: a full table becomes the older
    generation, from which words come back when they are used again."""

    older: dict

    def __init__(self, most: int = WORD_CACHE) -> None:
        self.most, self.older = most, {}

    def recall(self, words: list) -> list:
        """What is known of each word, None where it must be computed anew."""
        if len(self) > self.most // 2:
            self.older = dict(self)
            self.clear()
        found = list(map(self.get, words))
        older = self.older.get
        for i in [i for i, x in enumerate(found) if x is None]:
            if (x := older(words[i])) is not None:
                found[i] = self[words[i]] = x
        return found


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """Hashes of all runs of consecutive words of a hashed sequence, by prefix sums modulo 2^64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words)
        if len(Grams.powers) < n + 1:
            size = max(1 << 16, 2 * n)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            Grams.powers = np.cumprod(steps)
            steps[1:] = INVERSE
            Grams.inverses = np.cumprod(steps)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.powers[:n], out=self.sums[1:])

    def every(self, k: int, seed: int = 0) -> np.ndarray:
        """The hash of the k words from each place on."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:n]) * self.inverses[:n] + np.uint64(seed))

    def spans(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverses[start] + np.uint64(seed))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def vocabulary(name: str) -> str:
    """Where the machine keeps a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
