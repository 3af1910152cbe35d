"""Exact removal of long word passages that an earlier document already has.

Every run of `size` consecutive words of a document is an edge of a de Bruijn graph over runs of
size - 1 words. Consecutive edges of one document that share their minimizer (the least hash of
the shorter word runs in them) form a path piece; the pieces of a document hold each of its
edges exactly once, and every copy of an edge lies, wherever it is, in a piece with the same
minimizer. So one row per piece, not per edge, goes through Spark's joins:

* a minimizer that one document alone has needs nothing further;
* of equal pieces the one in the least doc_id is the source; the others repeat it;
* where a minimizer has several pieces (passages begin or end there), the sources' edges are
  compared singly.

What repeats is compacted. An aggregation over all copies of an edge or piece finds its degrees:
how many different neighbours lie before and behind it. Distinct edges that follow on each other
without a branch in between become one path, which is joined to the documents by its first edge
alone; pieces are put together in the same way where they lie. Each path then has the coordinates
of its source, and the words at both places are compared by a 128-bit digest of the
words themselves. Paths that fail (hashes collided) have all their copies compared again, window
by window, by such digests, so the result doesn't rest on the 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orrery.llm.common import Grams, as_bytes, forget, hashed_words, kept, signed, text_slices, told_apart, told_by_bits

#: Words of the runs whose least hash is an edge's minimizer.
MINIMIZER_WORDS = 10
#: Words hashed at a time; longer texts are taken in overlapping stretches.
STRETCH = 1 << 19
#: What tells a document apart: its id, and a hash of its text where ids repeat.
DOC = ["doc_id", "mark"]
SOURCE = ["source_id", "source_mark", "source_start"]


def least_of_next(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place on, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def stretches(words: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents' word hashes, put together to stretches of bounded length. Gives the words, for
    each word its document's number, and its place in the document. A document longer than a
    stretch is continued size - 1 words before the end of the last, so that no edge is lost."""
    held: list[tuple[int, int, np.ndarray]] = []
    n = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(x) for _, _, x in held]
        number = np.repeat([d for d, _, _ in held], lengths)
        place = np.concatenate([np.arange(lo, lo + len(x)) for _, lo, x in held])
        return np.concatenate([x for _, _, x in held]), number, place

    for d, doc in enumerate(words):
        lo = 0
        while len(doc) - lo >= size:
            piece = doc[lo : lo + STRETCH]
            held.append((d, lo, piece))
            n += len(piece)
            if n >= STRETCH:
                yield out()
                held, n = [], 0
            if lo + len(piece) >= len(doc):
                break
            lo += len(piece) - (size - 1)
    if held:
        yield out()


def neighbours(hashes: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of what lies before and behind each, 0 for nothing. `follows` tells for each but
    the last whether the next one comes right behind it in the same document."""
    before, behind = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:] = np.where(follows, hashes[:-1], 0)
    behind[:-1] = np.where(follows, hashes[1:], 0)
    return before, behind


def pieces(docs: DataFrame, size: int, bits: int = 64) -> DataFrame:
    """`docs(doc_id, mark, text)` -> `(minimizer, key, before, behind, doc_id, mark, start, edges)`:
    every path piece, with the hash of its words, its neighbours, its first word's place and its
    number of edges."""
    w = size - MINIMIZER_WORDS + 1
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            for words, number, place in stretches(hashed_words(batch.column("text"), 17), size):
                grams = Grams(words)
                least = least_of_next(grams.every(MINIMIZER_WORDS), w)
                whole = number[: len(least)] == number[size - 1 :]
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                apart = (np.diff(at) > 1) | (np.diff(number[at]) != 0)
                new[1:] = apart | (least[at[1:]] != least[at[:-1]])
                first = np.flatnonzero(new)
                edges = np.diff(np.append(first, len(at)))
                start = at[first]
                key = (grams.spans(start, start + edges + size - 1, seed=1) ^ edges.astype(np.uint64)) & mask
                before, behind = neighbours(key.astype(np.uint32).view(np.int32), ~apart[first[1:] - 1])
                of = pa.array(number[start])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(least[start])), pa.array(signed(key)), pa.array(before), pa.array(behind),
                        batch.column("doc_id").take(of), batch.column("mark").take(of), pa.array(place[start].astype(np.int32)), pa.array(edges.astype(np.int32)),
                    ],
                    names=["minimizer", "key", "before", "behind", *DOC, "start", "edges"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*DOC, "text").mapInArrow(run, f"minimizer bigint, key bigint, before int, behind int, doc_id {kind}, mark bigint, start int, edges int")


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def edges_of(spans: DataFrame, docs: DataFrame, size: int, bits: int = 64, exact: bool = False) -> DataFrame:
    """`spans(doc_id, mark, start, edges)` -> `(key, before, behind, doc_id, mark, start, edges)`: each
    edge in the given spans of the documents, with its hash and neighbours; `exact` takes a digest
    of the words in the place of the hash."""
    mask = np.uint64((1 << bits) - 1)
    asked = spans.groupBy(*DOC).agg(F.collect_list(F.struct("start", "edges")).alias("spans"))  # a document has no more spans than words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans, texts = batch.column("spans"), as_bytes(batch.column("text")) if exact else None
            keys, befores, behinds, number, place = [], [], [], [], []
            for d, words in enumerate(hashed_words(batch.column("text"), 29)):
                part = spans[d].values
                lo, n = np.asarray(part.field("start"), np.int64), np.asarray(part.field("edges"), np.int64)
                at = np.unique(np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()))
                at = at[at + size <= len(words)]
                found = Grams(words).spans(at, at + size, seed=2)
                before, behind = (signed(x) for x in neighbours(found, np.diff(at) == 1))
                found &= mask
                if exact:
                    own = texts[d].split()
                    keys += [digest_of(own[i : i + size]) for i in at.tolist()]
                else:
                    keys.append(signed(found))
                befores.append(before)
                behinds.append(behind)
                place.append(at)
                number.append(np.full(len(at), d))
            of, at = pa.array(np.concatenate(number)), np.concatenate(place).astype(np.int32)
            key = pa.array(keys, pa.binary()) if exact else pa.array(np.concatenate(keys))
            columns = [key, *(pa.array(np.concatenate(x)) for x in (befores, behinds)), batch.column("doc_id").take(of), batch.column("mark").take(of), pa.array(at), pa.array(np.ones(len(at), np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "before", "behind", *DOC, "start", "edges"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    some = told_by_bits(docs.select(*DOC, "text"), spans, DOC)[0]
    return some.join(asked, DOC).mapInArrow(run, f"key {'binary' if exact else 'bigint'}, before bigint, behind bigint, doc_id {kind}, mark bigint, start int, edges int")


def sources(copies: DataFrame, *by: str) -> DataFrame:
    """Of all copies of a key: the source's coordinates, the last doc_id, and whether one neighbour
    alone lies before and behind it."""
    one = lambda c: ((F.min(c) == F.max(c)) & (F.min(c) != 0)).alias(f"one_{c}")
    first = [F.min_by(c, "doc_id").alias(f"source_{c}") for c in ("mark", "start")]
    return copies.groupBy(*by).agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id"), *first, one("before"), one("behind"))


def heads(sources: DataFrame) -> DataFrame:
    """Distinct edges with their sources -> paths that don't branch, each by its first edge: `(key,
    edges, source_id, source_mark, source_start)`. A path lies whole and in a row wherever its first
    edge lies, so no other one has to be looked for in the documents."""
    order = W.partitionBy("source_id", "source_mark").orderBy("source_start")
    last = lambda c: F.lag(c).over(order)
    joined = last("one_behind") & F.col("one_before") & (last("source_start") + 1 == F.col("source_start"))
    begins = sources.withColumn("begins", F.when(joined, 0).otherwise(1))
    paths = begins.withColumn("path", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = [F.min_by("key", "source_start").alias("key"), F.count("*").cast("int").alias("edges"), F.min("source_start").alias("source_start")]
    return paths.groupBy("source_id", "source_mark", "path").agg(*first).select("key", "edges", *SOURCE)


def compacted(copies: DataFrame) -> DataFrame:
    """Copies with their sources, put together to paths where neither branches: `(doc_id, mark,
    start, edges, source_id, source_mark, source_start)`."""
    order = W.partitionBy(*DOC).orderBy("start")
    last = lambda c: F.lag(c).over(order)
    near: Column = (last("start") + last("edges") == F.col("start")) & (last("source_start") + last("edges") == F.col("source_start"))
    joined = last("one_behind") & F.col("one_before") & near & (last("source_id") == F.col("source_id")) & (last("source_mark") == F.col("source_mark"))
    begins = copies.withColumn("begins", F.when(joined, 0).otherwise(1))
    paths = begins.withColumn("path", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return paths.groupBy(*DOC, "path").agg(F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"), *[F.min(c).alias(c) for c in SOURCE]).drop("path")


def refuted(paths: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Those of the paths whose words differ from the words at their source's coordinates."""
    names = [*SOURCE, "edges"]
    own = F.struct(F.col("start").alias("at"), *names)
    source = F.struct(F.col("source_start").alias("at"), *[F.lit(None).cast(paths.schema[c].dataType).alias(c) for c in SOURCE], "edges")
    each = paths.select(*DOC, own.alias("x")).unionByName(paths.select(F.col("source_id").alias("doc_id"), F.col("source_mark").alias("mark"), source.alias("x")).distinct())
    asked = each.groupBy(*DOC).agg(F.collect_list("x").alias("asked"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            asked = batch.column("asked")
            words = [(t or b"").split() for t in as_bytes(batch.column("text"))]
            number = np.repeat(np.arange(len(words)), np.diff(np.asarray(asked.offsets)))
            rows = asked.flatten()
            at, n = (np.asarray(rows.field(c), np.int64) for c in ("at", "edges"))
            found = pa.array([digest_of(words[d][i : i + k + size - 1]) for d, i, k in zip(number.tolist(), at.tolist(), n.tolist(), strict=True)], pa.binary())
            own = [batch.column(c).take(pa.array(number)) for c in DOC]
            yield pa.RecordBatch.from_arrays([*own, *(rows.field(c) for c in ("at", *names)), found], names=[*DOC, "at", *names, "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = paths.select(F.explode(F.array(F.struct(*DOC), F.struct(F.col("source_id").alias("doc_id"), F.col("source_mark").alias("mark")))).alias("x")).select("x.*")
    digests = told_by_bits(docs.select(*DOC, "text"), ends, DOC)[0].join(asked, DOC).mapInArrow(run, f"doc_id {kind}, mark bigint, at int, source_id {kind}, source_mark bigint, source_start int, edges int, words binary")
    digests = kept(digests, "digests")
    there = digests.where("source_id is null").select(F.col("doc_id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("at").alias("source_start"), "edges", F.col("words").alias("there"))
    here = digests.where("source_id is not null").withColumnRenamed("at", "start")
    wrong = kept(here.join(there, names).where("words <> there").select(*DOC, "start", "edges"), "refuted")
    forget(digests)
    return wrong


def repeated_spans(docs: DataFrame, size: int = 50, bits: int = 64) -> DataFrame:
    """`docs(doc_id, mark, text)` -> `(doc_id, mark, start, edges)`: spans of edges whose words a
    document with a smaller doc_id has too. A span covers edges + size - 1 words from `start` on.
    `bits` is the width of the hashes that find them; any width gives the same spans."""
    docs = docs.where("doc_id is not null")
    found = kept(pieces(docs, size, bits), "pieces")
    # The tables that are joined to copies are kept first: Spark then reads both sides from a
    # shuffle of their own, and splits a key that very many documents have.
    shared = found.groupBy("minimizer").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min("key") != F.max("key")).alias("branches"))
    again = kept(found.join(kept(shared.where("a < b").select("minimizer", "branches"), "shared"), "minimizer"), "again")
    forget(found)
    of_pieces = kept(sources(again, "minimizer", "key"), "sources")
    copies = kept(again.join(of_pieces, ["minimizer", "key"]), "copies")
    forget(again, of_pieces)
    columns = ["key", *DOC, "start", "edges", *SOURCE, "one_before", "one_behind"]
    copied = copies.where("doc_id > source_id").select(*columns)

    edges = kept(edges_of(copies.where("branches and doc_id = source_id"), docs, size, bits), "edges")
    of_edges = kept(sources(edges, "key").where("source_id < last_id"), "edge-sources")
    alone = [F.lit(False).alias(c) for c in ("one_before", "one_behind")]  # these paths have all that belongs to them
    singly = edges.drop("edges").join(kept(heads(of_edges), "heads"), "key").where("doc_id > source_id").select(*columns[:-2], *alone)
    rows = kept(copied.unionByName(singly), "repeats")
    paths = kept(compacted(rows), "paths")
    bad = refuted(paths, docs, size)
    spans = paths.select(*DOC, "start", "edges")
    if bad.isEmpty():
        forget(copies, edges, of_edges, rows)
        return spans

    # Hashes collided: all copies of the keys in refuted paths once more, by digests of their words.
    inside = bad.select(*DOC, F.col("start").alias("lo"), (F.col("start") + F.col("edges")).alias("hi"))
    everywhere = copies.select("key", *DOC, "start", "edges").unionByName(edges.select("key", *DOC, "start", "edges"))
    keys = everywhere.join(inside, DOC).where("start >= lo and start < hi").select("key").distinct()
    windows = kept(edges_of(everywhere.join(keys, "key", "left_semi"), docs, size, exact=True), "windows")
    first = kept(windows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b"), "firsts")
    exact = windows.join(first, "key").where("doc_id > a").select(*DOC, "start", "edges")
    return spans.join(bad, [*DOC, "start", "edges"], "left_anti").unionByName(exact)


def covered(n: int, starts: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.minimum(starts, n), 1)
    np.add.at(marks, np.minimum(starts + edges + size - 1, n), -1)
    return np.cumsum(marks[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int = 50, verbatim: bool = False, bits: int = 64) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(row, text, n_words, n_removed)`, one row per input row:
    `row` has the other columns, `text` the words that are left, joined by one space. With
    `verbatim`, texts that lose nothing are returned as they are, with their own white space.

    Words are runs without ASCII white space, unchanged. A word goes if some `size` consecutive
    words around it also begin in a document with a smaller doc_id; within one document, and
    among rows with the same doc_id, nothing counts as repeated. Null texts have no words and
    give an empty text (with `verbatim`: null); texts of fewer than `size` words stay whole. A
    null doc_id is neither before nor after any other: its row stays whole and removes nothing.
    Equal rows are judged alike; rows that share a doc_id with different texts are documents of
    their own. Columns of any other name pass through.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    told, _ = told_apart(docs.select(row.alias("row"), "doc_id", "text"))
    found = repeated_spans(told.select(*DOC, "text"), size, bits)
    spans = found.groupBy(*DOC).agg(F.collect_list(F.struct("start", "edges")).alias("spans"))  # no more spans than words
    some, rest = told_by_bits(told, found, DOC)  # most texts that lose nothing aren't shuffled
    joined = some.join(spans, DOC, "left").select("row", "text", "spans")
    joined = joined.unionByName(rest.select("row", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            total, gone, left = [], [], []
            for text, spans in zip(as_bytes(batch.column("text")), batch.column("spans"), strict=True):
                words = (text or b"").split()
                n = len(words)
                if spans.is_valid:
                    part = spans.values
                    out = covered(n, np.asarray(part.field("start"), np.int64), np.asarray(part.field("edges"), np.int64), size)
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                total.append(n)
                gone.append(n - len(words))
                left.append(text if verbatim and len(words) == n else b" ".join(words))
            more = [pa.array(left, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *more], names=["row", "text", "n_words", "n_removed"])

    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return joined.mapInArrow(run, schema)


def cut_texts(docs: DataFrame, size: int = 50) -> DataFrame:
    """The documents, same columns, with their repeated words removed; n_chars, where there is
    such a column, follows the text."""
    found = remove_repeats(docs, size, verbatim=True)
    columns = {c: F.col("row").getField(c) if c != "text" else F.col("text") for c in docs.columns}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(columns["n_chars"])
    return found.select(*[v.alias(k) for k, v in columns.items()])
