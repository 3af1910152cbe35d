"""Column functions that several operators share. They give the same values in any SQL engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities of 0..4; what lies above counts as 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def bucket32(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts, as text joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


#: Draws are whole numbers below this prime.
DRAWS = 2147483647


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once, however often it is used: the optimizer would
    write an ordinary column out at each place, and again within that. An array of one value that
    is exploded stays a step of its own."""
    return df.withColumn(name, F.explode(F.array(value)))


def with_draw(df: DataFrame, name: str, base: Column, rep: Column) -> DataFrame:
    """The rows with a number below DRAWS that depends on a row's base (see bucket32) and the replicate
    alone: two rounds of multiplying and squaring modulo a prime, so no text is hashed for a
    replicate."""
    y, w = F.col(f"{name}_y"), F.col(f"{name}_w")
    df = fixed(df, f"{name}_y", ((base + rep * 1000003) % DRAWS * 48271 + rep * 40692) % DRAWS)
    df = fixed(df, f"{name}_w", ((y * ((y + 16807) % DRAWS)) % DRAWS * 69621 + base) % DRAWS)
    return fixed(df, name, (w * ((w + 12345) % DRAWS)) % DRAWS).drop(f"{name}_y", f"{name}_w")


def poisson_weight(drawn: Column) -> Column:
    """A Poisson(1) draw from a column of draws (see with_draw)."""
    u = drawn / F.lit(float(DRAWS))
    weight = F.lit(5)
    for k, cut in reversed(list(enumerate(POISSON))):
        weight = F.when(u < cut, k).otherwise(weight)
    return weight


def norm_text(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def norm_url(url: Column) -> Column:
    """Https; no `www.` or `m.`, fragment, `ref` and `utm_` parameters, trailing slash."""
    out = F.regexp_replace(url, r"^http://", "https://")
    out = F.regexp_replace(out, r"^https://(www|m)\.", "https://")
    out = F.regexp_replace(out, r"#.*$", "")
    out = F.regexp_replace(out, r"([?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    out = F.regexp_replace(out, r"&+", "&")
    out = F.regexp_replace(out, r"\?&", "?")
    return F.regexp_replace(out, r"[?&/]+$", "")


def unit_price_e4(extended: Column, discount: Column, quantity: Column) -> Column:
    """Net price of a unit in 1e-4 units: cents x (100 - percent) / quantity, rounded down."""
    cents = F.round(extended * 100).cast("bigint")
    percent = F.round(discount * 100).cast("bigint")
    return F.call_function("div", cents * (F.lit(100) - percent), quantity.cast("bigint"))


def rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation of a group; null where either side is constant."""
    x, y = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece is about `size` bytes: what is made from a piece stays
    bounded however long the texts are. A single longer text is one piece."""
    for batch in batches:
        piece = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)) // size
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for lo, hi in zip(edges, edges[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts whose words stand between single spaces -> the distinct words, the place among them of
    every word of every text, and each text's number of words."""
    split = pc.split_pattern(texts.fill_null(""), " ")
    codes = split.flatten().dictionary_encode()
    at, lengths = np.asarray(codes.indices, np.int64), np.diff(np.asarray(split.offsets, np.int64))
    empty = pc.index(codes.dictionary, "").as_py()
    if empty >= 0:
        lengths -= np.bincount(np.repeat(np.arange(len(lengths)), lengths)[at == empty], minlength=len(lengths))
        at = at[at != empty]
    return codes.dictionary, at, lengths


def word_counts(df: DataFrame, unit: str, text: Column, marked: bool = False) -> DataFrame:
    """`(unit, len, term, tf)`: the words of each unit's text, whose words stand between single spaces, with
    their counts, and the text's length in words; with `marked`, also a row for the empty term of each
    unit that has words. Words are counted within Arrow batches: no row is made for a repeated word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", 1 << 20):  # a word takes some 100 bytes here
            words, at, lengths = numbered_words(batch.column("text"))
            of = np.repeat(np.arange(len(lengths)), lengths)
            keys, counts = np.unique(of * max(1, len(words)) + at, return_counts=True)
            of, at = np.divmod(keys, max(1, len(words)))
            terms = words.take(pa.array(at))
            if marked:
                there = np.flatnonzero(lengths)
                of, counts = np.concatenate([of, there]), np.concatenate([counts, np.zeros(len(there), np.int64)])
                terms = pa.concat_arrays([terms, pa.array([""] * len(there), terms.type)])
            yield pa.RecordBatch.from_arrays([batch.column("unit").take(pa.array(of)), pa.array(lengths[of]), terms, pa.array(counts)], names=["unit", "len", "term", "tf"])

    kind = df.schema[unit].dataType.simpleString()
    return df.select(F.col(unit).alias("unit"), text.alias("text")).mapInArrow(run, f"unit {kind}, len bigint, term string, tf bigint")


BASE = 0x9E3779B97F4A7C15 | 1


def run_hashes(words: np.ndarray, at: np.ndarray, lengths: np.ndarray, n: int, second: bool = False) -> list[np.ndarray]:
    """Hashes of all runs of n consecutive words of each text (see numbered_words), by prefix sums modulo
    2^64 over all texts; a shorter text is one run. The second hash depends on the words in another
    way: both together are a digest of 128 bits."""
    key, base = ("orrery-second-wo", 0xC2B2AE3D27D4EB4F) if second else ("0123456789123456", BASE)
    hashes = pd.util.hash_array(words, hash_key=key, categorize=False)[at] if len(words) else np.zeros(0, np.uint64)
    steps = np.full(len(hashes) + 1, base, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps)
    steps[1:] = pow(base, -1, 1 << 64)
    back = np.cumprod(steps)
    sums = np.append(np.uint64(0), np.cumsum(hashes * powers[:-1]))
    ends = np.cumsum(lengths)
    out = []
    for lo, hi in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
        size = min(n, hi - lo)
        x = (sums[lo + size : hi + 1] - sums[lo : hi - size + 1]) * back[lo : hi - size + 1] if size else sums[:0]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append((x ^ (x >> np.uint64(29))).view(np.int64))
    return out


def word_runs(texts: pa.Array, n: int) -> list[np.ndarray | None]:
    """Hashes of the distinct runs of n words of each text, in the order of their first places; words
    stand between single spaces."""
    distinct, at, lengths = numbered_words(texts)
    out: list[np.ndarray | None] = []
    for valid, x in zip(texts.is_valid().to_pylist(), run_hashes(distinct.to_numpy(zero_copy_only=False).astype(object), at, lengths, n), strict=True):
        _, first = np.unique(x, return_index=True)
        out.append(x[np.sort(first)] if valid else None)
    return out


def run_digests(texts: pa.Array, n: int, bits: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct runs of n words: a hash of `bits` bits, which finds equal runs, and a
    second one of 64, which tells runs apart that the first doesn't. A null text has none."""
    distinct, at, lengths = numbered_words(texts)
    words = distinct.to_numpy(zero_copy_only=False).astype(object)
    mask, out = np.int64((1 << bits) - 1 if bits < 64 else -1), []
    for x, y in zip(run_hashes(words, at, lengths, n), run_hashes(words, at, lengths, n, second=True), strict=True):
        order = np.lexsort((y, x := x & mask))
        x, y = x[order], y[order]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
        out.append((x[new], y[new]))
    return out


def run_rows(df: DataFrame, key: str, text: Column, n: int, bits: int = 64) -> DataFrame:
    """`(key, size, run, checked)`: a row for each distinct run of n words of each text, whose words stand
    between single spaces, and how many runs the text has (see run_digests)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = run_digests(batch.column("text"), n, bits)
            sizes = np.array([len(x) for x, _ in found], np.int64)
            of = pa.array(np.repeat(np.arange(len(found)), sizes))
            columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(of), pa.array(np.repeat(sizes, sizes)), *map(pa.array, columns)], names=["key", "size", "run", "checked"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(run, f"key {kind}, size bigint, run bigint, checked bigint").withColumnRenamed("key", key)


def set_marks(df: DataFrame, key: str, text: Column, n: int) -> DataFrame:
    """`(key, size, mark)`: of each text that has words a digest of its set of runs, which equal sets
    share, and the set's size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text"):
            found = run_digests(batch.column("text"), n)
            some = [i for i, (x, _) in enumerate(found) if len(x)]
            marks = [hashlib.blake2b(found[i][0].tobytes() + found[i][1].tobytes(), digest_size=16).digest() for i in some]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(some, pa.int64())), pa.array([len(found[i][0]) for i in some], pa.int64()), pa.array(marks, pa.binary())], names=["key", "size", "mark"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(run, f"key {kind}, size bigint, mark binary").withColumnRenamed("key", key)


def shingle_set(text: Column, n: int) -> Column:
    """Hashes of the distinct runs of n words of a normalized text, in the order of their first
    places; a shorter text is one run, the empty text none. Taken over Arrow batches: array
    functions of SQL take ten times as long, since they interpret a lambda for each word."""

    @F.pandas_udf("array<bigint>")
    def runs(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        return pd.Series([x for part in byte_slices([batch], "text") for x in word_runs(part.column("text"), n)], dtype=object)

    return runs(text)
