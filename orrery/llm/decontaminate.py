"""Benchmark passages in documents: a prefix-filtered set join of word shingles.

A window (ten consecutive words of an item) occurs in a document only if all its shingles do.
Containment of the whole set makes the necessary prefix one shingle: the window's rarest. So
documents and windows are joined on each window's rarest shingle alone; length and positional
bounds throw out places where the window would not fit into the document; what is left is verified
by the words of the whole window at that place, compared as 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Grams, as_bytes, hashed_words, kept, signed, text_slices, told_apart, whole_rows
from orrery.llm.substring import DOC, digest_of, stretches

#: Word characters are digits, ASCII letters and everything beyond ASCII.
SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
BLANKS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
#: Shingles of a block of benchmark windows that each task holds at once (8 bytes each).
HELD = 2_000_000


def apart(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and a blank for every separator."""
    return pa.array([(t or b"").lower().translate(BLANKS) for t in as_bytes(texts)], pa.binary()).cast(pa.string())


def windows_of(items: DataFrame, window: int, shingle: int, bits: int = 64) -> DataFrame:
    """`items(item_id, text)` -> `(item_id, size, whole BINARY, place, part)`: for each window of each
    item its number of words and their digest, and each of its shingles' places and hashes."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = apart(batch.column("text"))
            for i, (hashes, text) in enumerate(zip(hashed_words(texts, 53), as_bytes(texts), strict=True)):
                n = len(hashes)
                if not n:
                    continue
                size = min(window, n)
                short = min(shingle, size)
                words, parts = text.split(), Grams(hashes).every(short, seed=1000 + size) & mask
                whole = [digest_of(words[k : k + size]) for k in range(n - size + 1)]
                per = size - short + 1
                place = np.tile(np.arange(per), len(whole))
                at = np.repeat(np.arange(len(whole)), per)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(np.full(len(at), i))),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(whole, pa.binary()).take(pa.array(at)),
                        pa.array(place.astype(np.int32)),
                        pa.array(signed(parts[at + place])),
                    ],
                    names=["item_id", "size", "whole", "place", "part"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, size int, whole binary, place int, part bigint")


class Lookup:
    """Which of many hashes are in a sorted set: a bit table first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        bits = max(16, int(np.ceil(np.log2(max(1, len(values))))) + 5)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.values >> self.shift] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[x >> self.shift])
        if not len(at) or not len(self.values):
            return at[:0]
        found = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        return at[self.values[found] == x[at]]


def shingle_hits(docs: DataFrame, sizes: dict[int, np.ndarray], shingle: int, bits: int = 64) -> DataFrame:
    """`docs(doc_id, mark, text)` -> `(doc_id, mark, n_words, hits ARRAY<STRUCT<size, at, part,
    whole>>)`: one row per document with the places where it has a shingle of some benchmark window
    of `size` words; `whole` has the digests of the windows around it, from the one that ends with
    the shingle to the one that begins with it (null where it would not fit)."""
    shared = docs.sparkSession.sparkContext.broadcast(sizes)
    struct = pa.struct([("size", pa.int32()), ("at", pa.int32()), ("part", pa.int64()), ("whole", pa.list_(pa.binary()))])
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {size: Lookup(values) for size, values in shared.value.items()}
        for batch in text_slices(batches):
            texts = apart(batch.column("text"))
            words = hashed_words(texts, 53)
            columns: list[list[np.ndarray]] = [[], [], [], []]
            number: list[np.ndarray] = []
            shifts: list[np.ndarray] = []
            for size, lookup in lookups.items():
                short = min(shingle, size)
                per = size - short + 1
                seen: set[tuple[int, int]] = set()
                for chunk, doc, place in stretches(words, short):
                    grams = Grams(chunk)
                    at = lookup(parts := grams.every(short, seed=1000 + size) & mask)
                    at = at[doc[at] == doc[at + short - 1]]
                    if not len(at):
                        continue
                    # Places of a long document that two stretches share, once; windows by its own words.
                    at = at[np.array([(d, p) not in seen for d, p in zip(doc[at].tolist(), place[at].tolist(), strict=True)], bool)]
                    seen.update(zip(doc[at].tolist(), place[at].tolist(), strict=True))
                    if not len(at):
                        continue
                    number.append(doc[at])
                    for c, v in zip(columns, (np.full(len(at), size), place[at], parts[at]), strict=False):
                        c.append(v)
                    shifts.append(np.full(len(at), per))
            wholes: list[list[bytes | None]] = []
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns[:3]]
            of = np.concatenate(number) if number else np.zeros(0, np.int64)
            order = np.argsort(of, kind="stable")
            flat, of = [c[order] for c in flat], of[order]
            offsets = np.searchsorted(of, np.arange(len(words) + 1))
            for d in np.unique(of).tolist():
                own, n = texts[d].as_py().encode().split(), len(words[d])
                known: dict[tuple[int, int], bytes] = {}  # neighbouring shingles ask for the same windows
                for size, at in zip(flat[0][offsets[d] : offsets[d + 1]].tolist(), flat[1][offsets[d] : offsets[d + 1]].tolist(), strict=True):
                    whole: list[bytes | None] = []
                    for begin in range(at + min(shingle, size) - size, at + 1):
                        fits = begin >= 0 and begin + size <= n
                        if fits and (begin, size) not in known:
                            known[begin, size] = digest_of(own[begin : begin + size])
                        whole.append(known[begin, size] if fits else None)
                    wholes.append(whole)
            hits = pa.StructArray.from_arrays(
                [pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(signed(flat[2].astype(np.uint64))), pa.array(wholes, pa.list_(pa.binary()))],
                fields=list(struct),
            )
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), hits)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), pa.array([len(w) for w in words], pa.int64()), lists], names=[*DOC, "n_words", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*DOC, "text").mapInArrow(run, f"doc_id {kind}, mark bigint, n_words bigint, hits array<struct<size int, at int, part bigint, whole array<binary>>>")


def blocks_of_shingles(windows: DataFrame, held: int) -> list[dict[int, np.ndarray]]:
    """The benchmark's distinct shingles by window size, in blocks of at most about `held`."""
    parts = windows.select("size", "part").distinct()
    blocks = max(1, -(-parts.count() // held))
    out = []
    for b in range(blocks):
        rows = parts.where(F.pmod("part", F.lit(blocks)) == b).groupBy("size").agg(F.collect_list("part").alias("parts")).toLocalIterator()
        out.append({r["size"]: np.array(r["parts"], np.int64).view(np.uint64) for r in rows})
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, held: int = HELD, bits: int = 64) -> DataFrame:
    """`docs(doc_id, text, ...)`, `benchmark(item_id, text, ...)` -> `(doc_id, n_words, n_hit,
    n_items, items_sha256, contaminated)`, one row per input row of `docs`.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is
    `window` consecutive words of an item, or a whole shorter item. n_hit counts the document's
    words inside any occurrence of a window, n_items the items with an occurring window;
    items_sha256 is the hash of their ids, sorted as strings and joined by commas (of none: of the
    empty text). Null and wordless texts have no words and no windows. Repeated rows are judged
    alike; rows of `docs` that share a doc_id (or have none) with different texts are documents of
    their own. Items with a null id can hit, but are not named or counted. Empty tables are
    allowed. Other columns aren't read.

    The benchmark's shingles reach the tasks in blocks of at most `held`; documents are read once
    for each block. Rarity is counted over all documents. `bits` is the width of the shingles'
    hashes, which only bring candidates; any width gives the same result.
    """
    return by_document(told_apart(docs.select("doc_id", "text"))[0], benchmark, window, shingle, held, bits).drop("mark")


def by_document(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, held: int, bits: int) -> DataFrame:
    """contamination, with `mark` beside doc_id in `docs` and in the result."""
    windows = kept(windows_of(benchmark, window, shingle, bits), "windows")
    passes = [kept(shingle_hits(docs, sizes, shingle, bits), "hits") for sizes in blocks_of_shingles(windows, held)]
    hits = reduce(DataFrame.unionByName, [p.select(*DOC, F.explode("hits").alias("h")) for p in passes]).select(*DOC, "h.size", "h.at", "h.part", "h.whole")

    rarity = hits.groupBy("size", "part").agg(F.count("*").alias("n"))
    prefix = (
        windows.join(rarity, ["size", "part"])  # a window with a shingle that no document has can't occur
        .groupBy("size", "whole")
        .agg(F.min(F.struct("n", "part", "place")).alias("rarest"), F.count_distinct("place").alias("there"))
        .where(F.col("there") == F.col("size") - F.least(F.lit(shingle), F.col("size")) + 1)
        .select("size", F.col("whole").alias("wanted"), "rarest.part", "rarest.place")
    )
    found = hits.join(prefix, ["size", "part"])
    # `whole` runs from the window that ends with the shingle to the one that begins with it.
    here = F.element_at("whole", F.size("whole") - F.col("place"))
    found = found.where(here == F.col("wanted")).select(*DOC, "size", "wanted", (F.col("at") - F.col("place")).alias("start")).distinct()
    found = kept(found, "found")
    words = F.count_distinct("word")
    n_hit = found.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("word")).groupBy(*DOC).agg(words.alias("n_hit"))
    names = windows.select("size", F.col("whole").alias("wanted"), "item_id").where("item_id is not null").distinct()
    named = found.select(*DOC, "size", "wanted").distinct().join(names, ["size", "wanted"]).select(*DOC, F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    one = n_hit.join(items, n_hit.doc_id.eqNullSafe(items.doc_id) & (n_hit["mark"] == items["mark"]), "left").select(n_hit.doc_id.alias("hit_id"), n_hit["mark"].alias("hit_mark"), "n_hit", "n_items", "items")
    out = passes[0].select(*DOC, "n_words")
    out = out.join(one, out.doc_id.eqNullSafe(one.hit_id) & (out["mark"] == one.hit_mark), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(*DOC, "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents, with all their columns, that have no benchmark window."""
    told, _ = told_apart(whole_rows(docs))
    found = by_document(told.select(*DOC, "text"), benchmark, window, 5, HELD, 64).where("contaminated")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    return told.join(gone, told.doc_id.eqNullSafe(gone.gone_id) & (told["mark"] == gone.gone_mark), "left_anti").select("row.*")
