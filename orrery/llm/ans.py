"""Token ids as binary blocks: static range asymmetric numeral system with interleaved lanes.

One frequency table, counted over all ids, serves every block. A block is coded by many lanes,
each with its own state, which take the block's ids in turn; so numpy codes one id of every lane
at a time. Blocks don't depend on each other: each carries its lanes' final states, its length
and a checksum, and can be decoded alone. The states CHECK steps apart inside a block are its
checkpoints, each with a checksum of the ids up to the next: a reader can begin there, and a
reader of the whole block decodes from all of them at once.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import Remembered, cells, gathered, kept, new_folder, text_slices, words_in

#: Format: shares are of 2^SCALE, states stay in [2^31, 2^63), words of 32 bits.
SCALE, LOW = 20, 1 << 31
MAGIC = b"RANS2\0\0\0"
#: Ids and lanes of a full block, steps between two checkpoints.
BLOCK, LANES, CHECK = 1 << 19, 2048, 128
END = 1


class Table:
    """Shares of the ids, each at least one part of 2^SCALE for an id that occurs."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        seen = np.flatnonzero(counts)
        if len(seen) > 1 << SCALE:
            raise ValueError("too many different ids for the table")
        share = np.zeros(len(counts), np.int64)
        if len(seen):
            rest = (1 << SCALE) - len(seen)
            exact = counts[seen] / counts.sum() * rest
            share[seen] = 1 + np.floor(exact).astype(np.int64)
            left = (1 << SCALE) - int(share.sum())  # to those that lost most by rounding, in order
            order = np.argsort(np.floor(exact) - exact, kind="stable")
            share[seen[order[:left]]] += 1
        self.share = share.astype(np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64) if len(share) else self.share
        self.owner = np.repeat(np.arange(len(share)), share).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: magic, length, lanes, checksum, checkpoints (place in the words, checksum, states), words."""
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        points: list[tuple[int, int, np.ndarray]] = []
        shift, half = np.uint64(SCALE), np.uint64(32)
        total = 0
        for t in range(steps - 1, -1, -1):
            now = ids[t * lanes : (t + 1) * lanes]
            x = state[: len(now)]
            f = self.share[now]
            big = x >= (f << np.uint64(63 - SCALE))
            out = x[big].astype(np.uint32)
            words.append(out)
            total += len(out)
            x = np.where(big, x >> half, x)
            q = x // f
            state[: len(now)] = (q << shift) + (x - q * f) + self.begin[now]
            if t % CHECK == 0:
                own = ids[t * lanes : (t + CHECK) * lanes]
                points.append((total, checksum(own), state.copy()))
        data = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        head = MAGIC + struct.pack("<IIII", n, lanes, checksum(ids), len(points))
        marks = b"".join(struct.pack("<II", total - at, crc) + s.astype("<u8").tobytes() for at, crc, s in points[::-1])
        return head + marks + data.astype("<u4").tobytes()

    def decode(self, block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids of a block from its checkpoint `start` on, up to checkpoint `stop` (None: the
        end). All checkpoints asked for are decoded side by side, each step taking one id of every
        lane of each; what each one gives must have its checksum."""
        if block[:8] != MAGIC:
            raise ValueError("not a block")
        n, lanes, crc, points = struct.unpack_from("<IIII", block, 8)
        if not n:
            return np.zeros(0, np.uint32)
        stop = points if stop is None else stop
        if not 0 <= start < stop <= points:
            raise ValueError("no such checkpoint")
        mark = np.dtype([("at", "<u4"), ("crc", "<u4"), ("state", "<u8", (lanes,))])
        marks = np.frombuffer(block, mark, points, 24)[start:stop]
        words = np.frombuffer(block, "<u4", offset=24 + points * mark.itemsize)
        state, at = marks["state"].astype(np.uint64), marks["at"].astype(np.int64)
        first = np.arange(start, stop) * CHECK * lanes
        out = np.empty((stop - start, CHECK, lanes), np.uint32)
        mask, shift, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for t in range(min(CHECK, -(-(n - int(first[0])) // lanes))):
            slot = state & mask
            now = self.owner[slot.astype(np.int64)]
            out[:, t] = now
            state = self.share[now] * (state >> shift) + slot - self.begin[now]
            low = state < np.uint64(LOW)
            left = n - (int(first[-1]) + t * lanes)
            if left < lanes:  # the last checkpoint's ids end within this step
                low[-1, max(0, left) :] = False
            taken = low.sum(axis=1)
            row, lane = np.nonzero(low)
            if len(row):
                place = at[row] + np.arange(len(row)) - (np.cumsum(taken) - taken)[row]
                if place.max() >= len(words):
                    raise ValueError("the block's words are cut off")
                state[row, lane] = (state[row, lane] << half) | words[place].astype(np.uint64)
                at += taken
        ids = out.reshape(-1)[: n - int(first[0])]
        sizes = np.minimum(CHECK * lanes, n - first)
        if any(checksum(ids[lo - first[0] : lo - first[0] + k]) != c for lo, k, c in zip(first, sizes, marks["crc"], strict=True)):
            raise ValueError("a checkpoint's checksum is wrong")
        if (start, stop) == (0, points) and checksum(ids) != crc:
            raise ValueError("the block's checksum is wrong")
        return ids


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


# ---------------------------------------------------------------- texts to ids


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Marks that are pieces of their own behind a letter or digit, how the vocabulary's
#: file cuts words, the mark of a piece's last token, and the file's settings that all this rests on.
MARKS = ".,!?;:|#$%&*"
CUT, LAST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Words of these letters alone are one piece and stay as they are when the file's rules normalize them.
PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"


class WordTokens:
    """Ids (little-endian, 16 bits) of texts. Under a vocabulary that drops white space, words between
    white space don't affect each other, so each distinct one is given to the tokenizers library
    once and remembered, and Arrow puts the texts' ids together. New words go in as one line; its
    ids are dealt back by the number of pieces that each word has, where the marks of the pieces'
    last tokens confirm the sum; words of plain letters go in without the file's normalizer and
    cut, which leave them as they are. Files with other settings than these are used as they are,
    on whole texts."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer(path)
        settings = json.loads(self.tokenizer.to_str())
        model = settings["model"]
        self.by_word = {k: settings[k] for k in SETTINGS} == SETTINGS and model.get("end_of_word_suffix") == LAST and not model.get("dropout")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(1 + max(vocab.values()), bool)
        self.last[[i for t, i in vocab.items() if t.endswith(LAST)]] = True
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = "|".join(map(re.escape, special)) or r"\A\z."
        self.specials = re.compile(b"|".join(re.escape(t.encode()) for t in special) or b"(?!)").search
        self.cut = regex.compile(CUT).findall
        self.known = Remembered()

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of plain letters: one piece each."""
        found = np.array(self.letters.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u2")
        return dealt(found, np.flatnonzero(self.last[found]) + 1)

    def learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of any other words."""
        texts = [w.decode() for w in words]
        if not any(map(self.specials, words)):
            found = np.array(self.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, "<u2")
            ends = np.flatnonzero(self.last[found])
            formed = (t if t.isascii() else normalize("NFC", t).lower() for t in texts)
            pieces = np.fromiter((1 if t.isalpha() else len(self.cut(t)) for t in formed), np.int64, len(texts))
            if pieces.sum() == len(ends) and len(ends) and ends[-1] == len(found) - 1 and pieces.all():
                return dealt(found, ends[np.cumsum(pieces) - 1] + 1)
        return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids_of(self, words: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of distinct words, learned where they aren't known."""
        found = self.known.recall(words)
        new = np.array([i for i, x in enumerate(found) if x is None], np.int64)
        for some, learn in ((new[plain[new]], self.learn_letters), (new[~plain[new]], self.learn)):
            for lo in range(0, len(some), 5_000):
                part = some[lo : lo + 5_000].tolist()
                for i, x in zip(part, learn([words[i] for i in part]), strict=True):
                    found[i] = self.known[words[i]] = x
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        if not self.by_word:
            return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        # The vocabulary lower-cases anyway; only the special tokens' marks tell cases apart.
        lower = pc.ascii_lower(texts)
        words, at, lengths = words_in(pc.if_else(pc.match_substring_regex(lower, self.marks), texts, lower))
        # Marks behind a letter or digit begin a piece of their own (apostrophes aside): two parts.
        words = words.cast(pa.string())
        stems = pc.ascii_rtrim(words, MARKS)
        cut = pc.and_(pc.not_equal(stems, words), pc.match_substring_regex(stems, "[a-z0-9]$"))
        tails = [w[k:] for w, k in zip(cells(words.filter(cut)), np.asarray(pc.binary_length(stems.filter(cut))).tolist(), strict=True)]
        parts = pa.concat_arrays([pc.if_else(cut, stems, words), pa.array(tails, pa.binary()).cast(pa.string())]).dictionary_encode()
        code = np.asarray(parts.indices, np.int64)
        pair = np.full((len(words), 2), -1, np.int64)
        pair[:, 0] = code[: len(words)]
        pair[np.asarray(cut), 1] = code[len(words) :]
        plain = np.asarray(pc.match_substring_regex(parts.dictionary, PLAIN))
        ids = self.ids_of(cells(parts.dictionary), plain)

        order = pair[at].ravel()
        parts_before = np.append(0, np.cumsum((pair >= 0).sum(1)[at]))[np.append(0, np.cumsum(lengths))]
        return gathered(pa.array(ids, pa.binary()), order[order >= 0], np.diff(parts_before))


def dealt(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids cut behind each of `ends`."""
    ends, data = (2 * ends).tolist(), ids.tobytes()
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One per Python worker, so that later tasks know the words of earlier ones."""
    return WordTokens(path)


def id_blocks(docs: DataFrame, path: str, files: int) -> DataFrame:
    """`docs(doc_id, text)` -> `(file, block, doc_ids, lengths, ids BINARY)`: each text's 16-bit ids
    and the end id, in ascending doc_id order over `files` ranges of doc_ids, as blocks of whole
    documents with about BLOCK ids; a longer document has a block of its own."""
    if tokenizer(path).get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    end = np.array([END], "<u2").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, size = word_tokens(path), 0, 0
        doc_ids: list[object] = []
        held: list[bytes] = []
        file, schema = None, None

        def out() -> pa.RecordBatch:
            row = {"file": [file], "block": [block], "doc_ids": [doc_ids], "lengths": [[len(x) // 2 for x in held]], "ids": [b"".join(held)]}
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in text_slices(batches):
            file = batch.column("file")[0].as_py()  # a task has one range
            schema = schema or pa.schema([("file", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())])
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                n = len(ids) // 2 + 1
                if held and size + n > BLOCK:
                    yield out()
                    block, size, doc_ids, held = block + 1, 0, [], []
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += n
        if held:
            yield out()

    first = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", "text").repartitionByRange(files, first).sortWithinPartitions(first, F.xxhash64("text"))
    return ordered.select(F.spark_partition_id().alias("file"), "doc_id", "text").mapInArrow(run, f"file int, block int, doc_ids array<{kind}>, lengths array<int>, ids binary")


def count_ids(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id below `size` occurs: one partial count per task, summed by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["id", "n"])

    rows = blocks.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary
    counts = np.zeros(size, np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def coded(blocks: DataFrame, table: Table) -> DataFrame:
    """Blocks of ids -> `(file, block, doc_ids, lengths, payload)`."""
    shared = blocks.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [shared.value.encode(np.frombuffer(x.as_buffer(), "<u2")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payload, pa.binary())], names=["file", "block", "doc_ids", "lengths", "payload"])

    kind = blocks.schema["doc_ids"].dataType.simpleString()
    return blocks.mapInArrow(run, f"file int, block int, doc_ids {kind}, lengths array<int>, payload binary")


def write_tokens(docs: DataFrame, path: str, folder: str, files: int) -> None:
    """Encode every text, append the end id, and write the ids to `folder` in ascending doc_id
    order: `blocks` has self-contained blocks as rows of Parquet parts, numbered within ranges of
    doc_ids; `table` the counts of the shared frequency table. Spark's commit makes either
    complete or absent, whichever executors are lost."""
    blocks = kept(id_blocks(docs, path, files), "ids")
    counts = count_ids(blocks, tokenizer(path).get_vocab_size())
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(counts[i])) for i in np.flatnonzero(counts).tolist()], "id int, n bigint").coalesce(1).write.parquet(f"{folder}/table")
    coded(blocks, Table(counts)).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_table(spark: SparkSession, folder: str) -> Table:
    rows = spark.read.parquet(f"{folder}/table").collect()
    counts = np.zeros(1 + max((i for i, _ in rows), default=-1), np.int64)
    for i, n in rows:
        counts[i] = n
    return Table(counts)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The written files -> `(file, block, place, doc_id, ids BINARY)`: 32-bit ids per document,
    end id included. Blocks are decoded where Spark puts them; a wrong checksum is an error."""
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    stored = spark.read.parquet(f"{folder}/blocks")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = np.asarray(batch.column("lengths")[i].values, np.int64)
                ids = shared.value.decode(batch.column("payload")[i].as_py()).astype("<u4")
                parts = [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]
                n = len(parts)
                same = [pa.array([batch.column(c)[i].as_py()] * n, pa.int32()) for c in ("file", "block")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), batch.column("doc_ids")[i].values, pa.array(parts, pa.binary())], names=["file", "block", "place", "doc_id", "ids"])

    return stored.mapInArrow(run, f"file int, block int, place int, doc_id {kind}, ids binary")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: `(doc_id, start, n_tokens, ids_crc32)`, start being the number
    of ids of all documents before it. Documents are summed within their block, blocks within
    their file, files (a row each) over all."""
    from pyspark.sql import Window as W

    ids = read_tokens(spark, folder)
    rows = kept(ids.select("file", "block", "place", "doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "read")
    blocks = rows.groupBy("file", "block").agg(F.sum("n_tokens").alias("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    before = lambda *key: F.coalesce(F.sum("n").over(W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("in_file", before("file", "block")).drop("n").join(F.broadcast(files.select("file", before("file").alias("in_all"))), "file")
    own = F.sum("n_tokens").over(W.partitionBy("file", "block").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(starts, ["file", "block"]).select("doc_id", (F.col("in_all") + F.col("in_file") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """Write the documents' ids and summarize what the files hold (see write_tokens, summary).

    `docs(doc_id, text, ...)`: one row per input row. Null texts count as empty and have only the
    end id. Rows without a doc_id come first; rows that share one lie next to each other, ordered
    by a hash of their text. Other columns aren't read. `files` defaults to one per shuffle
    partition of the session."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = new_folder(spark, "token-files")
    write_tokens(docs, path, folder, files)
    return summary(spark, folder)
