"""Documents drawn towards a target distribution: importance weights over hashed word runs, noise
that turns their order into a weighted draw without replacement, and a radix sort for the ranks.

A text's features are its runs of one to three words, each in the bucket that its CRC-32 names.
The CRC-32 of a run is put together from those of its words: appending n bytes to a text is a linear
map of its checksum, held in tables for each n. So tasks compute checksums of distinct words only,
count buckets in arrays, and score a text by summing an array of gains over its buckets.

Ranks come from a least-significant-digit radix sort whose passes are Spark jobs: rows lie in blocks
of consecutive places; a pass counts the digits of each block, adds up the counts before each
(digit, block) into its offset, and moves every row to offset + its place among the block's rows
with that digit. Each pass is stable, so after the last one the places are the order of the keys.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import cells, forget, kept, text_slices, words_in
from orrery.llm.decontaminate import apart

BUCKETS = 10_000
POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest bit first


@functools.cache
def step_table() -> np.ndarray:
    """What a checksum's lowest byte becomes when a zero byte is appended."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def one_more(c: np.ndarray) -> np.ndarray:
    return (c >> np.uint32(8)) ^ step_table()[c & 255]


@functools.cache
def short_tables() -> np.ndarray:
    """For 0 to 255 appended bytes, and each byte of the checksum, what its values become; flat."""
    maps = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)]
    for _ in range(255):
        maps.append(one_more(maps[-1]))
    return np.concatenate([m.ravel() for m in maps])


def mapped(table: np.ndarray, c: np.ndarray, base: np.ndarray | int = 0) -> np.ndarray:
    parts = [table[base + (256 * b) + (c >> np.uint32(8 * b) & 255).astype(np.int64)] for b in range(4)]
    return parts[0] ^ parts[1] ^ parts[2] ^ parts[3]


@functools.cache
def long_table(k: int) -> np.ndarray:
    """As short_tables, for 2^k appended bytes, k of 8 or more."""
    if k == 8:
        return one_more(short_tables()[-1024:])
    half = long_table(k - 1)
    return mapped(half, half)


def appended(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums of texts -> their part in the checksums after n more bytes each."""
    out = mapped(short_tables(), c, (n & 255) * 1024)
    for k in range(8, int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero(n >> k & 1)
        out[at] = mapped(long_table(k), out[at])
    return out


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each text's number of words; and for runs of one, two and three words the bucket of every run
    and the text that it is in."""
    distinct, at, lengths = words_in(apart(texts))
    crc = np.fromiter(map(zlib.crc32, cells(distinct)), np.uint32, len(distinct))
    size = np.asarray(pc.binary_length(distinct), np.int64)
    spaced = appended(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    c, s, n = crc[at], spaced[at], size[at]
    of = np.repeat(np.arange(len(lengths)), lengths)
    out = [(c, of)]
    run = s  # the run's checksum with a space behind it
    for words in (1, 2):
        longer = appended(run[:-1], n[words:])
        out.append((longer ^ c[words:], np.where(of[:-words] == of[words:], of[words:], -1)))
        if words == 1:
            run = appended(run[:-1], n[1:] + 1) ^ s[1:]
    return lengths, [(x[i >= 0] % buckets, i[i >= 0]) for x, i in out]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`texts(text, ...)` -> `(bucket, n)`: how many features of all texts are in each bucket. A task
    counts what it reads in one array."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            for x, _ in features(batch.column("text"), buckets)[1]:
                total += np.bincount(x, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts `(bucket, n)` of all documents and of the target -> `(bucket, gain)` for every bucket:
    a thousand times the logarithm of the target's smoothed share over the documents', floored."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    both = both.unionByName(raw.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t")))
    one = both.groupBy("bucket").agg(*[F.sum(c).cast("double").alias(c) for c in "st"])
    whole = one.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return one.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(share)).cast("bigint").alias("gain"))  # whole is one row


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, n_words, n_features, weight)`, one row per input row;
    `gain` has a number per bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.astype(np.float64)
        for batch in text_slices(batches):
            n, found = features(batch.column("text"), len(values))
            many = sum(np.bincount(of, minlength=len(n)) for _, of in found)
            sums = sum(np.bincount(of, weights=values[x], minlength=len(n)) for x, of in found)  # whole numbers, exact below 2^53
            columns = [batch.column("doc_id"), *[pa.array(np.asarray(x).astype(np.int64)) for x in (n, many, sums)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel draw that depends on seed and id alone, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


# ---------------------------------------------------------------- radix sort

#: Bits of a digit: a pass holds at most 2^DIGIT digit totals in one task.
DIGIT = 12
#: A block's rows, as powers of two: the least and the most.
LEAST_BLOCK, MOST_BLOCK = 12, 18


def packed(rows: DataFrame, keys: list[tuple[str, bool]]) -> tuple[list[tuple[Column, int]], int]:
    """Integer keys (name, ascending), most significant first -> words of at most 63 bits that
    compare as the keys do, least significant first, each with its bits; and the number of rows.
    Keys count from their least (or greatest) value, so their width is that of their range; nulls
    come last. A key whose range doesn't fit is split into halves."""
    ends = rows.agg(F.count("*").alias("n"), *[f(k).alias(f"{name}{i}") for i, (k, _) in enumerate(keys) for name, f in (("low", F.min), ("high", F.max))]).first()
    parts: list[tuple[Column, int]] = []
    for i, (name, up) in reversed(list(enumerate(keys))):
        low, high = ends[f"low{i}"] or 0, ends[f"high{i}"] or 0
        value = F.col(name).cast("bigint")
        if high - low < (1 << 62):
            far = value - F.lit(low) if up else F.lit(high) - value
            parts.append((F.coalesce(far, F.lit(high - low + 1)), (high - low + 1).bit_length()))
        else:
            order = value.bitwiseXOR(F.lit(-(1 << 63))) if up else F.bitwise_not(value).bitwiseXOR(F.lit(-(1 << 63)))
            parts.append((F.coalesce(order.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)), 32))
            parts.append((F.coalesce(F.shiftrightunsigned(order, 32), F.lit(1 << 32)), 33))
    words: list[tuple[Column, int]] = []
    for column, bits in parts:
        if words and words[-1][1] + bits <= 63:
            below, used = words[-1]
            words[-1] = (below.bitwiseOR(F.shiftleft(column.cast("bigint"), used)), used + bits)
        else:
            words.append((column.cast("bigint"), bits))
    return words, ends["n"]


def radix_ranked(rows: DataFrame, keys: list[tuple[str, bool]], digit: int = DIGIT, block: int | None = None) -> DataFrame:
    """The rows with `rank` 1, 2, 3... in the order of integer `keys` (name, ascending), nulls last;
    rows with equal keys in any order. The rows travel with their keys, so nothing is joined back.

    A pass moves the rows once, by (block, digit), which is at most a block's rows; offsets are one
    row for each digit in a block, summed per digit over blocks. The number of passes is the bits
    of the keys' ranges over `digit`. Each pass is written to the shared folder: a lost executor
    repeats tasks of one pass only."""
    words, n = packed(rows, keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shift = block if block is not None else min(MOST_BLOCK, max(LEAST_BLOCK, (n // (4 * parts)).bit_length()))
    names = [f"_key{i}" for i in range(len(words))]
    now = kept(rows.select("*", *[w.alias(k) for (w, _), k in zip(words, names, strict=True)], F.monotonically_increasing_id().alias("_pos")), "radix")
    for k, bits in [(k, low) for k, (_, width) in zip(names, words, strict=True) for low in range(0, width, digit)]:
        value = F.shiftrightunsigned(k, bits).bitwiseAND(F.lit((1 << digit) - 1))
        placed = now.withColumns({"_digit": value, "_block": F.shiftrightunsigned("_pos", shift)})
        counts = kept(placed.groupBy("_digit", "_block").agg(F.count("*").alias("_n")), "digits")
        before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
        totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n")).select("_digit", before(W.orderBy("_digit")).alias("_base"))  # 2^digit rows at most
        offsets = counts.withColumn("_before", before(W.partitionBy("_digit").orderBy("_block"))).join(F.broadcast(totals), "_digit")
        offsets = offsets.select("_digit", "_block", (F.col("_base") + F.col("_before")).alias("_offset"))
        local = F.row_number().over(W.partitionBy("_block", "_digit").orderBy("_pos"))
        moved = placed.withColumn("_local", local).join(offsets, ["_block", "_digit"])
        last, now = now, kept(moved.select(*rows.columns, *names, (F.col("_offset") + F.col("_local") - 1).alias("_pos")), "radix")
        forget(last, counts)
    return now.select(*rows.columns, (F.col("_pos") + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """`docs(doc_id, text, ...)`, `target(text, ...)` -> `(doc_id, n_features, weight, score, rank)`,
    all bigint, one row per input row of `docs`.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. weight sums the
    gains of a text's runs of one to three words (none: 0); score adds noise from seed and id. Of
    the texts with `least_words` words or more, `percent` in a hundred (rounded down) are drawn, by
    score, ties to the lesser doc_id; rank is their place, null for all others. Null and empty
    texts have no words. Rows without a doc_id share a draw of noise and come last among ties; rows
    that share a doc_id are drawn each for itself, those with equal scores in any order. Either
    table may be empty: its shares are then all equal. Other columns aren't read.
    """
    found = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets).collect()  # a row per bucket
    gain = np.zeros(buckets, np.int64)
    gain[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = kept(scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", "n_features", "weight", "score"), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    ranked = radix_ranked(scored.where(able), [("score", False), ("doc_id", True)])
    columns = ["doc_id", "n_features", "weight", "score"]
    out = ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return out.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank")))
