"""Near-duplicate documents: SimHash fingerprints linked by a binary-trie self-join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import PLACES, Grams, as_bytes, forget, hashed_words, kept, signed, text_slices, told_apart, told_by_bits, whole_rows
from orrery.operators.graph import connected_components

BITS = 64


# ---------------------------------------------------------------- fingerprints


def shingles(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of words, in order; a shorter text is one run, a wordless one none."""
    import xxhash

    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    m = n - words + 1
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[:m].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, m)


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = bit_counts(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist()))


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text: a bit is 1 if set in over half the XXH64 of its word shingles."""
    return majority(shingles(text, words, seed))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many values have each bit set: bits spread to bytes, added eight lanes at a time."""
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """`docs(doc_id, ..., text)` -> `(doc_id, ..., fp BIGINT)`, one row per input row. Null and
    wordless texts have fingerprint zero."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            values = np.array([fingerprint(t, words) for t in as_bytes(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(values.view(np.int64))], names=[*others, "fp"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.mapInArrow(run, f"{kinds}fp bigint")


# ---------------------------------------------------------------- trie self-join


class Budget:
    """How many differing bits a pair of trie nodes may have gathered by each depth. `inner`
    bits in the first `block` levels, `total` in all."""

    def __init__(self, block: int, inner: int, total: int):
        self.block, self.inner, self.total = block, inner, total

    def at(self, depth: int) -> int:
        return self.inner if depth <= self.block else self.total


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, errors: int, budget: Budget, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of leaves of two sorted fingerprint arrays (right None: of one with itself)
    that differ in at most `budget.total` bits and obey the budget of the first levels.

    Both tries are walked together from `depth` on, where the roots already differ in `errors`
    bits. A trie node is a range of the sorted array. A pair of nodes has up to four pairs of
    children; those under different bits cost one error, and a pair over its budget goes no
    further. Pairs wait on a stack in pieces of `chunk`, so memory doesn't grow with the result.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    one = lambda *x: tuple(np.array([v], np.int64) for v in x)
    stack = [(depth, one(0, len(left), 0, len(right), errors))]
    while stack:
        d, (al, ah, bl, bh, e) = stack.pop()
        if len(al) > chunk:
            for lo in range(0, len(al), chunk):
                stack.append((d, tuple(x[lo : lo + chunk] for x in (al, ah, bl, bh, e))))
            continue
        single = ((ah - al) * (bh - bl) == 1) | (d == BITS)
        if single.any():
            i, j = al[single], bl[single]
            differ = left[i] ^ right[j]
            near = np.bitwise_count(differ) <= budget.total
            near &= np.bitwise_count(differ >> np.uint64(BITS - budget.block)) <= budget.inner
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, e = (x[~single] for x in (al, ah, bl, bh, e))
        if not len(al):
            continue
        am, bm = middle(left, al, ah, d), middle(right, bl, bh, d)
        kids = [(al, am, bl, bm, e), (am, ah, bm, bh, e), (al, am, bm, bh, e + 1)]
        rest = (am, ah, bl, bm, e + 1)
        if own:  # of a node with itself one order is enough
            rest = tuple(x[al != bl] for x in rest)
        kids.append(rest)
        al, ah, bl, bh, e = (np.concatenate(x) for x in zip(*kids, strict=True))
        keep = (ah > al) & (bh > bl) & (e <= budget.at(d + 1))
        if keep.any():
            stack.append((d + 1, tuple(x[keep] for x in (al, ah, bl, bh, e))))


def middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where each node's child under bit 1 begins."""
    shift = np.uint64(BITS - 1 - depth)
    cut = ((values[lo] >> shift) | np.uint64(1)) << shift
    return np.clip(np.searchsorted(values, cut), lo, hi)


def forest(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> np.ndarray:
    """The least index that each of n nodes is linked to, folding pairs in as they come."""
    label = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        while True:
            a, b = label[u], label[v]
            if (a == b).all():
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]

    for i, j in pairs:
        held.append((i, j))
        size += len(i)
        if size >= most:
            fold()
            held, size = [], 0
    if held:
        fold()
    return label


def rotated(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def hamming_links(fps: DataFrame, total: int = 4, blocks: int = 3, cap: int = 8192, leaf: int = 2048) -> DataFrame:
    """Distinct `fps(fp BIGINT)` -> edges `(a, b)` that connect all fingerprints which differ in
    at most `total` bits: of the links found in one piece of work, those of a spanning forest.

    The bits are cut into `blocks`; in some block two linked fingerprints differ in at most
    total // blocks bits. So the trie is built once with each block's bits on top, with that
    smaller budget for its first levels. Spark takes the walk's upper part: a fingerprint goes
    to each pair of subtrees (its own prefix, a prefix within the inner budget). Pairs of
    subtrees with more than `cap` leaves are cut at deeper levels, and below the block, where
    the prefixes no longer part them, into squares of `cap`-sized slices, so that one task never
    has more than 2 x cap leaves. `leaf` is the aimed-at size of a subtree.
    """
    inner = total // blocks
    if inner != 1:
        raise ValueError("the prefix pairs here stand for an inner budget of one bit")
    n = fps.count()
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    widths = [edges[i + 1] - edges[i] for i in range(blocks)]
    width = min(widths)
    first = min(width, max(1, math.ceil(math.log2(max(2, n) / leaf))))
    levels = sorted({*range(first, width, 5), width})
    turns = F.array(*[F.struct(F.lit(r).alias("turn"), rotated(F.col("fp"), edges[r]).alias("key")) for r in range(blocks)])
    rows = fps.select(F.explode(turns).alias("x")).select("x.turn", "x.key", F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("q"))
    done = []
    for k, depth in enumerate(levels):
        prefix = F.shiftrightunsigned("key", BITS - depth)
        flips = F.array(prefix, *[prefix.bitwiseXOR(F.lit(1 << b)) for b in range(depth)])
        if k:  # only pairs that lie below the pair that was too large
            up = depth - levels[k - 1]
            below = lambda y: (F.least(F.shiftright(prefix, up), F.shiftright(y, up)) == F.col("p")) & (F.greatest(F.shiftright(prefix, up), F.shiftright(y, up)) == F.col("q"))
            flips = F.filter(flips, below)  # noqa: B023
        out = rows.select("turn", "key", prefix.alias("own"), F.explode(flips).alias("other"))
        out = out.select("turn", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        sizes = out.groupBy("turn", "p", "q").agg(F.count("*").alias("n"), F.count_if(F.col("own") == F.col("p")).alias("np"))
        sizes = sizes.where("(np > 0 and n > np) or p = q")  # both sides are there
        large = kept(sizes.where(F.col("n") > cap), "large")
        at = F.lit(depth).alias("depth")
        if large.isEmpty():
            done.append(out.select("turn", "p", "q", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "own", at))
            break
        done.append(out.join(large.select("turn", "p", "q"), ["turn", "p", "q"], "left_anti").select("turn", "p", "q", F.lit(0).alias("i"), F.lit(0).alias("j"), "key", "own", at))
        rows = out.join(large, ["turn", "p", "q"]).select("turn", "key", "p", "q", "own", "n")
        if depth == levels[-1]:
            slices = F.ceil(F.col("n") / cap).cast("int")
            mine = F.pmod(F.xxhash64("key"), slices).cast("int")
            cut = rows.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("theirs"))
            low = (F.col("p") == F.col("q")) | (F.col("own") == F.col("p"))
            i = F.when(F.col("p") == F.col("q"), F.least("mine", "theirs")).when(low, F.col("mine")).otherwise(F.col("theirs"))
            j = F.when(F.col("p") == F.col("q"), F.greatest("mine", "theirs")).when(low, F.col("theirs")).otherwise(F.col("mine"))
            done.append(cut.select("turn", "p", "q", i.alias("i"), j.alias("j"), "key", "own", at))
    work = done[0]
    for more in done[1:]:
        work = work.unionByName(more)

    def link(group: pa.Table) -> pa.Table:
        turn, p, q, depth = (group.column(c)[0].as_py() for c in ("turn", "p", "q", "depth"))
        keys = np.sort(np.asarray(group.column("key")).view(np.uint64))
        budget = Budget(widths[turn], inner, total)
        if p == q:
            pairs = walk(keys, None, depth, 0, budget)
        else:
            cut = int(np.searchsorted(keys, np.uint64(q << (BITS - depth))))
            pairs = ((i, j + cut) for i, j in walk(keys[:cut], keys[cut:], depth, int.bit_count(p ^ q), budget))
        label = forest(len(keys), pairs)
        tied = np.flatnonzero(label != np.arange(len(keys)))
        back = np.uint64(edges[turn]), np.uint64((BITS - edges[turn]) % BITS)
        turned = (keys >> back[0]) | (keys << back[1]) if edges[turn] else keys
        return pa.table({"a": turned[tied].view(np.int64), "b": turned[label[tied]].view(np.int64)})

    return work.groupBy("turn", "p", "q", "i", "j").applyInArrow(link, "a bigint, b bigint")


# ---------------------------------------------------------------- operators


def trie_roots(distinct: DataFrame, distance: int) -> DataFrame:
    """Distinct `(fp, ...)` -> the same with `root`, the same for all fingerprints that links reach."""
    roots = kept(connected_components(hamming_links(distinct.select("fp"), distance)), "roots")
    return distinct.join(roots, distinct.fp == roots.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, fingerprint, component_id)`, one row per input row.

    Copies share a fingerprint and are linked through it, once; the trie join sees distinct
    fingerprints only. component_id is the least doc_id that links lead to. Null, empty and
    wordless texts have fingerprint zero and are linked like any other. Rows that repeat a
    doc_id are rows of their own. A null doc_id keeps its row and is never the least; a
    component without any id has a null component_id. Other columns are not read.
    """
    marks = kept(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    distinct = kept(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = trie_roots(distinct, distance)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = kept(rooted.join(least, "root").select("fp", "component_id"), "components")  # Spark can split a hot fingerprint
    return marks.join(by_mark, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by their word runs


def run_hashes(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Hashes of each text's word runs, A-Z lower-cased; a shorter text is one run, a wordless one
    none."""
    found = hashed_words(pc.ascii_lower(texts.fill_null("")), 71)
    return [Grams(x).every(min(words, len(x))) if len(x) else x for x in found]


def listed(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.view(np.int64) for x in sets)])))


def frequent_runs(docs: DataFrame, words: int, share: float = 1e-4, text_bytes: int = 16 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Word runs that about `share` of all documents or more have, and counts for their order:
    `(sorted runs, counts)`. Each piece of about `text_bytes` of text counts all its documents' runs
    and gives those that two or more of them have; Spark adds the pieces' counts. They only order
    runs, and needn't be exact. At most (runs of an average document) / share come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        size = n = 0

        def out() -> pa.RecordBatch:
            runs, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= max(2, math.ceil(share * n))
            return pa.RecordBatch.from_arrays([pa.array(signed(runs[often])), pa.array(count[often].astype(np.int32))], names=["run", "n"])

        for batch in text_slices(batches):
            sets += [np.unique(x) for x in run_hashes(batch.column("text"), words)]
            size, n = size + batch.column("text").nbytes, n + batch.num_rows
            if size >= text_bytes:
                yield out()
                sets, size, n = [], 0, 0
        if sets:
            yield out()

    total = docs.count()
    found = docs.select("text").mapInArrow(run, "run bigint, n int").groupBy("run").agg(F.sum("n").alias("n"))
    found = found.where(F.col("n") >= max(3.0, share * total)).toArrow()
    runs, count = found.column("run").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(runs)
    return runs[order], count[order]


#: Bits of a set's sketch.
SKETCH = 1024


def sketch(runs: np.ndarray) -> np.ndarray:
    """For each of SKETCH cells whether an odd number of the runs fall into it, as 64-bit numbers. Where two
    sketches differ, some run is in one set only: so sets differ in no fewer runs than their sketches in bits."""
    cell = (runs >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def digest(runs: np.ndarray) -> bytes:
    return hashlib.blake2b(runs.tobytes(), digest_size=16).digest()


def run_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The run sets of the documents that `wanted(id, doc_id, mark)` names: `(id, runs)`. A table of
    bits, of fixed size, first lets nearly all other documents go where they are read, so texts
    aren't shuffled; the join then is exact."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "mark"), 64 - PLACES)
    cells = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("cell"))
    found = cells.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()  # at most 2^(PLACES - 6) rows
    table = np.zeros(1 << (PLACES - 6), np.uint64)
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("place"), np.uint64)
            some = batch.filter(pa.array(shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) > 0))
            for part in text_slices([some]):
                sets = [np.unique(x) for x in run_hashes(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), listed(sets)], names=["doc_id", "mark", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.select("doc_id", "mark", "text", place.alias("place")).mapInArrow(run, f"doc_id {kind}, mark bigint, runs array<bigint>")
    same = sets.doc_id.eqNullSafe(wanted.doc_id) & (sets["mark"] == wanted["mark"])
    return sets.join(wanted, same).select("id", "runs").dropDuplicates(["id"])


def run_marks(docs: DataFrame, words: int, least: float) -> DataFrame:
    """`docs(doc_id, mark, text)` -> `(doc_id, mark, key, fp, size, sketch, prefix)`, one row per input
    row: the digest of the set of word runs, the SimHash, the set's size, its sketch, and so many of its
    runs, the first in one order of all runs, that two sets with a Jaccard of `least` or more share one of
    them. Any order finds all pairs; frequent runs come last, so that they bring few together."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_runs(docs, words))

    def first(own: np.ndarray) -> np.ndarray:
        known, count = shared.value
        order = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            order = np.where(known[at] == own, count[at], 0)
        return own[np.lexsort((own, order))[: len(own) - math.ceil(least * len(own) - 1e-6) + 1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            every = run_hashes(batch.column("text"), words)
            sets = [np.unique(x) for x in every]
            fps = np.array([majority(x) for x in every], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array([digest(x) for x in sets], pa.binary()), pa.array(fps), pa.array([len(x) for x in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, listed([sketch(x) for x in sets]), listed([first(x) for x in sets])], names=["doc_id", "mark", "key", "fp", "size", "sketch", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"doc_id {kind}, mark bigint, key binary, fp bigint, size int, sketch array<bigint>, prefix array<bigint>")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components `(node, root)` with more links `(a, b)`; None: of the links alone. Only the links
    between components go through the contraction again."""
    if roots is None:
        return kept(connected_components(links), "roots")
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = kept(connected_components(between), "joined").select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(more, roots.root == more.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = more.join(roots, more.old == roots.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return kept(moved.unionByName(fresh), "roots")


#: What names a bundle: how many runs it has, and hashes of the ids of the sets that have them.
BUNDLE = ("n", "ids", "more_ids")


def bundled(sets: DataFrame) -> DataFrame:
    """`sets(id, size, prefix)` -> `(n, ids, more_ids, id, size, least_pos, most_pos)`: the runs that
    several prefixes have, those of the same sets as one bundle, with their number and, for each set,
    the places of the first and the last of them.

    Of all runs only the hashes are shuffled, to be counted; the rows of most others go by a table of
    bits (see told_by_bits) before the join."""
    shared = kept(sets.select(F.explode("prefix").alias("run")).groupBy("run").agg(F.count("*").alias("m")).where("m > 1").select("run"), "shared")
    rows = told_by_bits(sets.select("id", "size", F.posexplode("prefix").alias("pos", "run")), shared, ["run"])[0]
    rows = kept(rows.join(shared, "run"), "runs")
    names = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(c) for k, c in enumerate(BUNDLE[1:])]
    named = rows.join(kept(rows.groupBy("run").agg(*names), "names"), "run")
    places = named.groupBy(*BUNDLE[1:], "id", "size").agg(F.count("*").alias("n"), F.min("pos").alias("least_pos"), F.max("pos").alias("most_pos"))
    out = kept(places.select(*BUNDLE, "id", "size", "least_pos", "most_pos"), "bundled")
    forget(shared, rows)
    return out


def whole(value: Column) -> Column:
    return F.ceil(value - 1e-6)


def shared_runs(x: Column, y: Column, least: float) -> Column:
    """So many runs are shared by sets of `x` and `y` runs with a Jaccard of `least`."""
    return whole((x + y) * (least / (1 + least)))


def meetings(groups: DataFrame, least: float, sketches: DataFrame | None = None) -> DataFrame:
    """Rows of bundles (see bundled, with `root`) -> `(id, other)`, with repeats: sets of different
    components that have a bundle in common, where sizes and the bundle's place allow the similarity.

    All runs before a pair's first shared one are its own, so in either set that one lies within the
    first size - shared_runs. Its bundle begins there too, so each pair meets by some bundle that does.
    For the smaller of two sets this bound is least strict where both have its size, so rows beyond
    that are never taken for the smaller side: sets of a large family that are alike, but not enough,
    begin with runs of their own, and bring no pairs. `sketches(id, sketch)`, if given, tell of most others that
    meet that they differ in too many runs (see sketch): members of a family that each lack other runs of it."""
    if sketches is not None:
        groups = groups.join(sketches, "id")
    x, y, place, other_place = map(F.col, ("size", "other_size", "least_pos", "other_pos"))
    smaller = groups.where(place <= x - shared_runs(x, x, least)).select(*BUNDLE[1:], "id", "size", "root", "least_pos", *(["sketch"] if sketches is not None else []))
    more = [F.col("sketch").alias("other_sketch")] if sketches is not None else []
    others = groups.select(*BUNDLE[1:], *more, F.col("id").alias("other"), x.alias("other_size"), F.col("root").alias("other_root"), place.alias("other_pos"))
    order = (x < y) | ((x == y) & (F.col("id") < F.col("other")))
    common = shared_runs(x, y, least)
    apart = order & (F.col("root") != F.col("other_root")) & (x >= y * (least - 1e-9)) & (place <= x - common) & (other_place <= y - common)
    if sketches is not None:
        differ = [F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("other_sketch")[i])) for i in range(SKETCH // 64)]
        apart = apart & (sum(differ[1:], differ[0]) <= x + y - 2 * common)
    return smaller.join(others, list(BUNDLE[1:])).where(apart).select("id", "other")


def near_copy_roots(docs: DataFrame, words: int, least: float, stars: int) -> tuple[DataFrame, DataFrame]:
    """`docs(doc_id, mark, text)` -> the documents' marks (see run_marks), and `(key, root)`: the
    component of each set of word runs.

    Equal sets are one row. Candidates are SimHash links first. A pair at 0.8 differs in about
    ten bits, which no trie with a one-bit inner budget finds, so the prefixes of the sets give
    the rest, from those runs that several sets have. Runs that the same sets have, such as those of one
    passage, are one bundle with their number, so sets meet once by it and not run by run. In
    `stars` rounds one set of each bundle that spans components leads it, and each set is held
    against the lead that it shares most runs with; at last come all pairs that lie in different
    components still, where the sizes, the place of the first shared run, the sketches (see meetings) and the
    number of shared runs in their prefixes allow the similarity. So a large group of near copies doesn't cost the square of its size. Every link is
    verified by the exact Jaccard.
    """
    marks = kept(run_marks(docs, words, least), "run-marks")
    sets = kept(marks.dropDuplicates(["key"]).withColumn("id", F.monotonically_increasing_id()), "sets")
    by_mark = kept(sets.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "marks")
    tied = kept(hamming_links(by_mark.select("fp"), 5), "tied")
    star = sets.select("fp", F.col("id").alias("a")).join(by_mark.where("n > 1"), "fp").select("a", F.col("id").alias("b"))
    ends = [by_mark.select(F.col("fp").alias(c), F.col("id").alias(f"{c}_id")) for c in ("a", "b")]
    pairs = star.unionByName(tied.join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).where("a <> b")

    def verified(pairs: DataFrame) -> DataFrame:
        both = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        ids = both.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = kept(sets.select("id", "doc_id", "mark").join(ids, "id", "left_semi"), "wanted")
        own = kept(run_sets(docs, wanted, words), "run-sets")
        x, y = (own.select(F.col("id").alias(c), F.col("runs").alias(f"{c}_runs")) for c in "ab")
        shared = F.size(F.array_intersect("a_runs", "b_runs"))
        all_ = F.size("a_runs") + F.size("b_runs") - shared
        links = kept(both.join(x, "a").join(y, "b").where(shared / all_ >= least).select("a", "b"), "links")
        forget(both, wanted, own)
        return links

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of the bundles that sets of several components have."""
        ends = rows.groupBy(*BUNDLE).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(*BUNDLE)
        return kept(rows.join(kept(ends, "ends"), list(BUNDLE), "left_semi"), "bundles")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, rows.id == roots.node, "left").withColumn("root", F.coalesce("root", "id")).drop("node")

    # Of two sets with x and y runs that agree to `least`, at least `common` are shared. So of either
    # at most x - common others lie before any shared one. That gives the number of shared runs
    # that both prefixes have, and bounds the places of the first and of the last of these.
    x, y = F.col("size"), F.col("other_size")
    common = shared_runs(x, y, least)
    alike = F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)
    met = [F.sum("n").alias("n"), *[f(f"{k}_{c}").alias(f"{k}_{c}") for c in ("pos", "other_pos") for k, f in (("least", F.min), ("most", F.max))]]
    apart = F.col("n") >= common - F.greatest(whole(x * least), whole(y * least)) + 1
    for size, c in ((x, "pos"), (y, "other_pos")):
        apart = apart & (F.col(f"least_{c}") <= size - common) & (F.col(f"most_{c}") - F.col("n") + 1 <= size - common)
    roots = merged(None, verified(pairs))
    bundles = bundled(sets)
    groups = mixed(kept(rooted(bundles, roots), "rooted"))
    places = ("least_pos", "most_pos")
    for i in range(stars):
        lead = F.min_by(F.struct("id", "size", "root", *places), F.xxhash64(F.lit(i), "id")).alias("lead")
        leads = groups.groupBy(*BUNDLE).agg(lead)
        leads = kept(leads.select(*BUNDLE, *[F.col(f"lead.{c}").alias(o) for c, o in (("id", "other"), ("size", "other_size"), ("root", "other_root"), ("least_pos", "least_other_pos"), ("most_pos", "most_other_pos"))]), "leads")
        near = groups.join(leads, list(BUNDLE)).where((F.col("root") != F.col("other_root")) & alike)
        near = near.groupBy("id", "size", "root", "other", "other_size", "other_root").agg(*met).where(apart)
        best = near.groupBy("id").agg(F.max_by("other", "n").alias("other"))  # so candidates grow with the documents
        roots = merged(roots, verified(best.select(F.col("id").alias("a"), F.col("other").alias("b"))))
        before, groups = groups, mixed(rooted(groups.drop("root"), roots))
        forget(before, leads)
    rest = kept(meetings(groups, least, sets.select("id", "sketch")).distinct(), "meetings")
    met_sets = told_by_bits(sets.select("id", "size", "prefix"), rest.select(F.explode(F.array("id", "other")).alias("id")), ["id"])[0]
    ends = [met_sets.select(F.col("id").alias(c), F.col("size").alias(f"{c}_size"), F.col("prefix").alias(f"{c}_prefix")) for c in ("id", "other")]
    held = rest.join(ends[0], "id").join(ends[1], "other").withColumn("n", F.size(F.array_intersect("id_prefix", "other_prefix")))
    needed = shared_runs(F.col("id_size"), F.col("other_size"), least) - whole(F.greatest("id_size", "other_size") * least) + 1
    rest = held.where(F.col("n") >= needed).select(F.col("id").alias("a"), F.col("other").alias("b"))
    roots = merged(roots, verified(rest))
    components = kept(rooted(sets.select("key", "id"), roots).select("key", "root"), "components")
    forget(sets, groups, bundles)
    return marks, components


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, stars: int = 2) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, component_id)`, one row per input row: documents whose
    sets of word runs have a Jaccard of `least` or more are linked, all of them. Wordless and null
    texts are one set. Ids as in near_duplicates."""
    marks, roots = near_copy_roots(told_apart(docs.select("doc_id", "text"))[0], words, least, stars)
    sets = kept(marks.groupBy("key").agg(F.min("doc_id").alias("least")).join(roots, "key"), "rooted")
    ids = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(kept(sets.join(ids, "root").select("key", "component_id"), "ids"), "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, stars: int = 2) -> DataFrame:
    """As drop_near_duplicates, for the components of near_copies."""

    def firsts(told: DataFrame) -> DataFrame:
        marks, roots = near_copy_roots(told, words, least, stars)
        sets = marks.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
        found = kept(sets.join(roots, "key").groupBy("root").agg(F.min("first").alias("first")), "firsts")
        forget(marks)
        return found

    return first_of_each(docs, firsts)


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Keep, with all its columns, the document with the least doc_id of each component, and rows
    without an id. Rows that share a doc_id with different texts are documents of their own, which
    may lie in different components; of equal rows one stays."""

    def firsts(told: DataFrame) -> DataFrame:
        marks = kept(fingerprints(told, words), "fingerprints")
        distinct = marks.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
        return trie_roots(kept(distinct, "distinct"), distance).groupBy("root").agg(F.min("first").alias("first"))

    return first_of_each(docs, firsts)


def first_of_each(docs: DataFrame, firsts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `firsts` names by `first(doc_id, mark)` for documents told apart by their marks.
    Each group's first is found by partial sums and joined by its own id, so no step deals rows by
    their group; rows that surely stay aren't shuffled."""
    told, twice = told_apart(whole_rows(docs))
    keys = ["doc_id", "mark"]
    stay = kept(firsts(told.select(*keys, "text")).select("first.*"), "stay")
    named = told.where("doc_id is not null")
    doubtful = named.select(*keys).join(stay, keys, "left_anti")  # those that go, and equal rows
    if twice:
        doubtful = doubtful.unionByName(named.groupBy(*keys).count().where("count > 1").select(*keys))
    some, rest = told_by_bits(named, doubtful, keys)  # all the rest stays; only some is shuffled
    some = some.join(stay, keys)
    some = some.dropDuplicates(keys) if twice else some
    return some.select("row").unionByName(rest.select("row")).unionByName(told.where("doc_id is null").select("row")).select("row.*")
