"""Operators on documents against brute force, over awkward rows, repeats and empty tables."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import awkward, components, cut, frame, leaks, sha, simhash, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import ans, bpe, decontaminate, multiset, quality, simhash as op1, substring, token_counts

ROWS = awkward()
BYTES, WORDS, FLAT = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows twice, and rows without an id."""
    return frame(spark, [*ROWS[:25], *ROWS[:25], (None, "one"), (None, None)])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def by_id(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


# ---------------------------------------------------------------- 1


def test_fingerprints_and_components(docs):
    assert by_id(op1.near_duplicates(docs)) == components(ROWS)


def test_bit_counts():
    h = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (op1.bit_counts(h) == [(h >> np.uint64(i) & np.uint64(1)).sum() for i in range(64)]).all()


@pytest.mark.parametrize("cap,leaf", [(8192, 2048), (64, 16)])
def test_links_connect_dense_balls(spark, cap, leaf):
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**63, 4).tolist():
        for _ in range(150):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                x ^= 1 << b
            values.add(x)
    u = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    i, j = np.nonzero(near)
    want = op1.forest(len(u), [(i, j)])
    edges = op1.hamming_links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fp bigint"), cap=cap, leaf=leaf).collect()
    at = {int(x): k for k, x in enumerate(u.view(np.int64))}
    a, b = np.array([at[e.a] for e in edges]), np.array([at[e.b] for e in edges])
    assert (op1.forest(len(u), [(a, b)]) == want).all()


def test_one_document_of_each_group_stays(docs, repeated, empty):
    roots = {v[1] for v in components(ROWS).values()}
    kept = op1.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == roots
    some = components(ROWS[:25])
    rows = op1.drop_near_duplicates(repeated).select("doc_id").collect()
    assert sorted(r[0] for r in rows if r[0] is not None) == sorted({v[1] for v in some.values()}) and sum(r[0] is None for r in rows) == 2
    assert op1.near_duplicates(repeated).count() == 52
    assert op1.near_duplicates(empty).count() == op1.drop_near_duplicates(empty).count() == 0


# ---------------------------------------------------------------- 2


def test_ids_and_text_as_the_library_has_them(docs, empty):
    t = Tokenizer.from_file(BYTES)
    got = by_id(bpe.round_trip(docs, BYTES))
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back)), i
    back = by_id(bpe.decoded(bpe.encoded(docs, BYTES), BYTES))
    assert back == {i: (t or "",) for i, t in ROWS}
    assert bpe.round_trip(empty, BYTES).count() == 0


@pytest.mark.parametrize("text", ["", "aaaaaaaaaaa", " " * 40 + "x", "a  b\n\n\tc \n", "\n", " x", "x ", "<|endoftext|>", "a<|endoftext|> b", "don't I'LL", "é€😀中ı", "\x1c\x85 \xa0x", "!!!!" * 50, "ab" * 2000, "天地玄黄宇宙" * 900, "a" * 5001, "Zm9vYmFyL2Jh+cXV4/" * 500, "xyzzyq" * 700 + " " + "the" * 900])
def test_odd_texts(text):
    ids = np.frombuffer(bpe.Encoder(BYTES)(pa.array([text, None, text]))[2], "<u4").tolist()
    assert ids == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- 3


def test_counts_from_flat_files(docs, repeated, empty):
    encode = token_counts.encoding(FLAT).encode_ordinary
    assert by_id(token_counts.token_counts(docs, FLAT)) == {i: (len(encode(t or "")),) for i, t in ROWS}
    assert token_counts.token_counts(repeated, FLAT).count() == 52
    assert token_counts.token_counts(empty, FLAT).count() == 0


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng, want = np.random.default_rng(0), []
    for k in range(3):
        ids = np.where(rng.random(300 * k + 7) < 0.02, 9, rng.integers(0, 9, 300 * k + 7)).astype("<u2")
        ids.tofile(tmp_path / f"a{k}.bin")
        ends = np.flatnonzero(ids == 9).tolist()
        sizes = [b - a - 1 for a, b in zip([-1, *ends], ends, strict=False)]
        want += [(f"a{k}.bin", i, n, True) for i, n in enumerate(sizes)]
        if tail := len(ids) - 1 - (ends[-1] if ends else -1):
            want.append((f"a{k}.bin", len(sizes), tail, False))
    (tmp_path / "empty.bin").touch()
    assert sorted(map(tuple, token_counts.flat_counts(spark, f"file://{tmp_path}", 9, 2, block).collect())) == sorted(want)


# ---------------------------------------------------------------- 6


def test_repeated_passages_go(docs, repeated, empty):
    want = cut(ROWS)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(docs).select("row.doc_id", "n_words", "n_removed", "text").collect()}
    assert got == {i: (n, k, b" ".join(w).decode()) for i, (n, k, w) in want.items()}
    texts = {r.doc_id: (r.text, r.n_chars) for r in substring.cut_texts(docs).collect()}
    for i, text in ROWS:
        kept = text if not want[i][1] else got[i][2]
        assert texts[i] == (kept, len(kept or "") if want[i][1] else len(text or ""))
    assert substring.cut_texts(docs).columns == docs.columns
    assert substring.remove_repeats(repeated).count() == 52 and substring.remove_repeats(empty).count() == 0


def test_long_documents_are_taken_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(substring, "STRETCH", 90)
    words = [np.arange(n, dtype=np.uint64) for n in (10, 49, 50, 88, 89, 90, 400)]
    seen = []
    for _, number, place in substring.stretches(words, 50):
        seen += [(int(number[p]), int(place[p])) for p in range(len(number) - 49) if number[p] == number[p + 49]]
    assert sorted(seen) == [(d, p) for d, w in enumerate(words) for p in range(len(w) - 49)]


# ---------------------------------------------------------------- 7


def test_quality_on_held_out_labels(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("0.001", "0.01") + "/labels.parquet")
    found = quality.scores(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert np.mean([r.quality == r.predicted for r in rows]) > 0.9
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in found.where("held_out").collect()} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_quality_edges(spark, docs, repeated, empty):
    labels = spark.createDataFrame([(ROWS[0][0], 1, "x"), (ROWS[1][0], 0, "x"), (ROWS[1][0], 0, "x"), (ROWS[2][0], None, "x"), (-5, 1, "x"), (None, 1, "x")], "doc_id bigint, quality int, text string")
    found = quality.scores(repeated, labels).collect()
    assert len(found) == 52 and all(0 <= r.score <= 1 for r in found)
    assert quality.scores(docs, labels.where("doc_id < -9")).where("score between 0 and 1").count() == len(ROWS)
    assert quality.scores(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 1, 4.0]), np.array([4, 4, 4, 4, 4.0]))
    assert y.tolist() == sorted(y.tolist()) and y.tolist() == [0, 5 / 12, 1]


# ---------------------------------------------------------------- 8


def test_edited_texts_and_likeness(docs, repeated, empty):
    order = sorted(ROWS, reverse=True)
    texts = [t or "" for _, t in order]
    got = {r.doc_id: r for r in multiset.fingerprints(docs).collect()}
    assert len(got) == len(ROWS)
    for k, (i, _) in enumerate(order):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        if text == edited:
            assert r.near_edited == 1
        if text == following:
            assert r.near_next == 1
    by_text = {}
    for i, t in ROWS:
        by_text.setdefault(t or "", set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert multiset.fingerprints(repeated).count() == 52 and multiset.fingerprints(empty).count() == 0


def test_multiset_order_insertion_deletion(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e\nf"), (2, "f\na b c\nd e"), (3, "a b c\nd e"), (4, "f"), (5, "f\nf")], "k long, text string")
    v = {r.k: r for r in multiset.vectors(rows, ["k"]).collect()}
    assert v[1].wide == v[2].wide and v[1].lanes == v[2].lanes
    pair = spark.createDataFrame([(v[3].wide, v[4].wide, v[1].wide)], "a array<bigint>, b array<bigint>, c array<bigint>")
    added, taken = pair.select(multiset.combined(F.col("a"), F.col("b")), multiset.combined(F.col("c"), F.col("b"), -1)).first()
    assert added == v[1].wide and taken == v[3].wide
    assert v[4].wide != v[5].wide


# ---------------------------------------------------------------- 9


def test_token_files(docs, repeated, empty):
    t = Tokenizer.from_file(WORDS)
    got, start = by_id(ans.token_files(docs, WORDS, files=5)), 0
    for i, text in sorted(ROWS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    starts = [(r.start, r.n_tokens) for r in ans.token_files(repeated, WORDS).collect()]
    assert len(starts) == 52 and sorted(s for s, _ in starts) == [sum(n for _, n in sorted(starts)[:k]) for k in range(52)]
    assert ans.token_files(empty, WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 600_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 49_000).astype(np.uint16)
    table = ans.Table(np.bincount(ids, minlength=49_408))
    block = table.encode(ids)
    assert (table.decode(block) == ids).all()
    if n > 2 * ans.CHECK * ans.LANES:
        assert (table.decode(block, 1) == ids[ans.CHECK * ans.LANES :]).all()
    for at in np.linspace(24, len(block) - 1, 7).astype(int).tolist() if n else ():
        broken = bytearray(block)
        broken[at] ^= 255
        try:  # a change either shows, or lies in bits that no id comes from
            assert (table.decode(bytes(broken)) == ids).all()
        except (ValueError, IndexError):
            pass
    if n > 1000:
        broken = bytearray(block)
        broken[len(block) // 2] ^= 255
        with pytest.raises((ValueError, IndexError)):
            table.decode(bytes(broken))


def test_shares_fill_the_table():
    for counts in ([], [0, 5], [1] * 1000, [10**9, 1, 0, 3]):
        share = ans.Table(np.array(counts, np.int64)).share
        assert share.sum() in (0, 1 << ans.SCALE) and ((share > 0) == (np.array(counts) > 0)).all()


# ---------------------------------------------------------------- 10


def items():
    long = max(ROWS, key=lambda r: len(r[1] or ""))[1].split()
    return [(1, " ".join(long[5:40])), (22, "Two WORDS!"), (3, "one"), (4, None), (5, " ,. "), (6, "the " * 12), (7, " ".join(long[30:45])), (8, "never seen " * 9), (9, "a b c d")]


@pytest.mark.parametrize("held", [2_000_000, 20])
def test_contaminated_documents(spark, docs, held):
    bench = spark.createDataFrame([(*x, 1) for x in items()], "item_id bigint, text string, doc_id int")
    assert by_id(decontaminate.contamination(docs, bench, held=held)) == leaks(ROWS, items())


def test_decontamination_edges(spark, docs, repeated, empty):
    bench = spark.createDataFrame(items(), "item_id bigint, text string")
    want = leaks(ROWS, items())
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {i for i, v in want.items() if not v[4]}
    assert decontaminate.contamination(repeated, bench).count() == 52
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, bench.where("item_id < 0"))
    assert none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and none.count() == len(ROWS)


def test_helpers_agree():
    assert simhash("") == 0 and op1.fingerprint(b"A b") == simhash("a B")
    assert words_of(None) == [] and math.isclose(sum(quality.statistics(b"")), 0)
