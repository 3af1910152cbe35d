"""Importance resampling, source mixing and the conversation trie against plain re-statements."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, PLAIN, SCHEMA, awkward, frame, sha, words_of

from orrery.llm import mixture, prefix_trie, resample


def runs_of(text):
    w = PLAIN.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def drawn(rows, items, percent=5):
    """(doc_id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, items)):
        for x in texts:
            for f in runs_of(x)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    out, able = {}, []
    for i, x in rows:
        n, features = runs_of(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(features), weight, score, None]
        if n >= 20:
            able.append(i)
    for rank, i in enumerate(sorted(able, key=lambda i: (-out[i][2], i))[: percent * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v) for i, v in out.items()}


def test_checksums_of_joined_texts():
    rng = random.Random(4)
    for n in [0, 1, 2, 255, 256, 257, 1000, 70_000]:
        a, b = rng.randbytes(rng.randrange(50)), rng.randbytes(n)
        c = resample.appended(np.array([zlib.crc32(a)], np.uint32), np.array([n]))
        assert int(c[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampling(spark, percent):
    rows = awkward(5) + [(10_000 + i, "ten benchmark words lie here in a row again and again " * 3) for i in range(6)]
    items = ["ten benchmark words lie here", None, "", "Été naïve 日本 w1 w2"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, bucket bigint")
    got = {r[0]: tuple(r[1:]) for r in resample.resample(frame(spark, rows), bench, percent).collect()}
    assert got == drawn(rows, items, percent)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert resample.resample(none, bench).collect() == []
    rows = [(i, "a b c " * 20) for i in range(40)]
    got = resample.resample(frame(spark, rows), bench.limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2]


def test_repeated_and_missing_ids_are_drawn_each(spark):
    rows = [(None, "a b " * 20), (None, "c d " * 20), (7, "a b " * 20), (7, "a b " * 20), (8, None)]
    got = resample.resample(frame(spark, rows), frame(spark, rows), 100).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and len(got) == 5
    best = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.score for r in best] == sorted((r.score for r in best), reverse=True)


@pytest.mark.parametrize("digit, block", [(12, None), (4, 3), (7, 5)])
def test_radix_sort(spark, digit, block):
    rng = random.Random(digit)
    keys = [(rng.choice([-5, 0, 3, 2**40, None]), rng.randrange(-100, 100), i) for i in range(700)]
    rows = spark.createDataFrame(keys, "a bigint, b bigint, i bigint").repartition(5)
    got = sorted(resample.radix_ranked(rows, [("a", False), ("b", True), ("i", True)], digit, block).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 701))
    assert [r.i for r in got] == [k[2] for k in sorted(keys, key=lambda k: (k[0] is None, -(k[0] or 0), k[1], k[2]))]


def test_radix_sort_of_the_widest_keys(spark):
    keys = [-(2**63), 2**63 - 1, 0, -1, None, 2**62, -(2**62)]
    rows = spark.createDataFrame([(k,) for k in keys], "a bigint")
    for up in (True, False):
        got = sorted(resample.radix_ranked(rows, [("a", up)]).collect(), key=lambda r: r["rank"])
        assert [r.a for r in got] == [*sorted((k for k in keys if k is not None), reverse=not up), None]


# ---------------------------------------------------------------- mixing

DOCS = "doc_id bigint, source string, text string, place bigint, copies string, target string, `a.b` int, row string, mark string"


def sources(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "c", "t", 2, "r", "m") for i, s, t in rows], DOCS)


def aims(sizes, weights=(5, 2, 1), share=1.0, most=3):
    """Targets by resharing what is above a cap until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def corpus(seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "", "é", "zz", "Z"]
    rows = [(i, rng.choice(names + ["hot"] * 5), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(600)]
    return rows + [(1000, "tiny", "x"), (1001, "none", None), (1002, "hot", "w " * 9000), (None, "a", "q r"), (None, "a", "q r"), (1003, "b", "u v"), (1003, "b", "other text here")]


@pytest.mark.parametrize("seed, share", [(1, 1.0), (2, 0.3), (3, 2.5)])
def test_mixing(spark, seed, share):
    rows = corpus(seed)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = aims(sizes, share=share)
    got = mixture.mix(sources(spark, rows), share=share).collect()
    again = mixture.mix(sources(spark, rows[::-1]).repartition(7), share=share).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    taken, largest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1e-3
    expected = {s: want[s] / sizes[s] if sizes[s] else 0 for s in sizes}
    assert all(math.floor(expected[r.source] - 1e-9) <= r.copies <= math.ceil(expected[r.source] + 1e-9) for r in got)


def test_the_mix_repeats_whole_rows(spark):
    docs = sources(spark, corpus(4))
    counts = {}
    for r in mixture.mix(docs).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.copies
    found = mixture.mixed(docs)
    assert found.columns == docs.columns
    emitted = {}
    for r in found.collect():
        emitted[r.doc_id] = emitted.get(r.doc_id, 0) + 1
    assert emitted == {k: v for k, v in counts.items() if v}


def test_mixing_without_words(spark):
    assert mixture.mix(sources(spark, [])).collect() == []
    got = mixture.mix(sources(spark, [(1, "a", None), (2, None, "  ")])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in got] == [(0, 0, 0.0, 0)] * 2


# ---------------------------------------------------------------- conversations

TURN = "conv_id bigint, turn bigint, role string, text string, path string, n int, shard string"


def nodes_of(rows):
    """conv_id, depth -> the contract's values, by plain sets."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], set()).add(c)
    kids = {p: {q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p} for p in members}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, sha(ends)))
    return sorted(out, key=str)


def talks(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), 120):
        for t in range(rng.choice([0, 1, 3, 6, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "yes", "no", "é" * 3, None, f"t{rng.randrange(4)}"])))
    rows += [(400 + i, t, "user", f"same {t}") for i in range(0, 50, 5) for t in range(6)]
    rows += [(500, t, "user", f"long {t}") for t in range(90)] + [(505, t, "user", f"long {t}") for t in range(80)]
    rows += [(600, None, "system", "first"), (600, 0, "user", "second"), (601, 3, "user", "only"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    return rows


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "s") for r in rows], TURN)


@pytest.mark.parametrize("seed, held", [(1, 4096), (2, 16), (3, 3)])
def test_trie(spark, seed, held):
    rows = talks(seed)
    found = prefix_trie.trie(prefix_trie.grafted(prefix_trie.sequences(turns(spark, rows))), conversations=held).drop("path", "parent")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == nodes_of(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(prefix_trie.grafted(prefix_trie.sequences(turns(spark, [])))).collect() == []


def test_digests_cross_batches():
    rows = [(b"a", i) for i in range(10)] + [(b"b", 3)] + [(b"c", i) for i in range(5)]
    table = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["path", "conv_id"])
    for size in (1, 3, 100):
        got = [(p.as_py(), s.as_py()) for b in prefix_trie.digested(table.to_batches(size)) for p, s in zip(b["path"], b["ends_sha256"], strict=True)]
        assert got == [(p, sha(",".join(str(i) for q, i in rows if q == p))) for p in (b"a", b"b", b"c")]
