"""The classifier and the fingerprints, recomputed plainly."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import awkward, frame

from orrery.llm import multiset, quality

ROWS = awkward(5)


# ---------------------------------------------------------------- 7


def plain_statistics(text):
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.NAMES)
    n, size = len(words), len(data)
    share = lambda test: sum(map(test, data)) / size
    entropy = lambda counts, total: -sum(c / total * math.log(c / total) for c in counts)
    upper, lower = sum(65 <= b < 91 for b in data), sum(97 <= b < 123 for b in data)
    lengths, often = [len(w) for w in words], sorted(Counter(words).values(), reverse=True)
    mean = sum(lengths) / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    plain, letter = b".,;:'\"-()?", lambda b: 65 <= b < 91 or 97 <= b < 123 or 48 <= b < 58
    blank = lambda b: b in b"\t\n\x0b\x0c\r "
    pairs = {(words[i], words[i + 1]) for i in range(n - 1)}
    return [
        math.log1p(n), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / n), upper / max(1, upper + lower), share(lambda b: 48 <= b < 58), share(blank), share(lambda b: b in plain),
        share(lambda b: b < 128 and not letter(b) and not blank(b) and b not in plain), share(lambda b: b >= 128), entropy(Counter(data).values(), size), len(often) / n, often[0] / n, sum(often[:5]) / n, entropy(often, n),
        math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines), sum(x <= 3 for x in lengths) / n, sum(x >= 12 for x in lengths) / n,
        sum(w[-1] < 128 and not letter(w[-1]) for w in words) / n, sum(65 <= w[0] < 91 for w in words) / n, 1 - len(pairs) / max(1, n - 1), math.log1p(max(lengths)),
    ]


def test_statistics_by_loops():
    for _, text in ROWS:
        assert quality.statistics(None if text is None else text.encode()) == pytest.approx(plain_statistics(text), abs=1e-9)


def test_fit_equals_a_direct_solution(spark):
    """Fourier features, ridge and isotonic steps over all rows at once, without partial sums."""
    texts = [t for _, t in ROWS]
    x = np.array([plain_statistics(t) for t in texts])
    y = np.array([float((i * 7) % 3 > 0) for i in range(len(texts))])
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)], "x array<double>, label int").repartition(5)
    model = quality.fit(rows, waves=32, width=3.0, ridge=1e-2, bins=50, seed=1)

    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    rng = np.random.default_rng(1)
    frequency, phase = rng.normal(size=(x.shape[1], 32)) / 3.0, rng.uniform(0, 2 * np.pi, 32)
    phi = np.column_stack([np.sqrt(2 / 32) * np.cos(np.clip((x - mean) / sd, -6, 6) @ frequency + phase), np.ones(len(x))])
    damp = 1e-2 * len(x) / 32 * np.eye(33)
    damp[-1, -1] = 1e-9
    weight = np.linalg.lstsq(phi.T @ phi + damp, phi.T @ y, rcond=None)[0]
    raw = phi @ weight
    assert model.raw(x) == pytest.approx(raw, abs=1e-6)

    # Isotonic regression by its definition: the greatest of the least means around each bin.
    cell = np.floor((np.clip(raw, -1, 2) + 1) / 3 * 49).astype(int)
    used = np.unique(cell)
    ones, n = np.array([y[cell == c].sum() for c in used]), np.array([(cell == c).sum() for c in used])
    fitted = np.array([max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))])
    at = used / 49 * 3 - 1
    steps_at = np.array([(at * n)[fitted == v].sum() / n[fitted == v].sum() for v in np.unique(fitted)])
    want = 0.999 * np.interp(raw, steps_at, np.unique(fitted)) + 0.001 * np.clip((raw + 1) / 3, 0, 1)
    assert model.score(x) == pytest.approx(want, abs=1e-6)


def test_the_kernel_is_gaussian():
    rng = np.random.default_rng(0)
    d, waves = len(quality.NAMES), 20_000
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, waves)) / 4.0, rng.uniform(0, 2 * np.pi, waves))
    x = rng.normal(size=(6, d))
    phi = model.fourier(x)[:, :-1]
    far = ((x[:, None] - x[None, :]) ** 2).sum(-1)
    assert np.abs(phi @ phi.T - np.exp(-far / (2 * 4.0**2))).max() < 0.03


# ---------------------------------------------------------------- 8


def chained(*values):
    """Spark's xxhash64 of several values: the hash of one is the seed of the next; nulls are skipped."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8 if v > 10 else 4, "little"), h)
    return h


def vector(text):
    wide, lanes, n = [0] * multiset.WIDE, [0] * multiset.LANES, 0
    for paragraph in text.split("\n"):
        for i in range(multiset.WIDE // 2):
            h = chained(i, paragraph.encode())
            wide[2 * i] = (wide[2 * i] + h % 2**32) % 2**32
            wide[2 * i + 1] = (wide[2 * i + 1] + (h >> 32)) % 2**32
        words = [chained(w.encode()) for w in paragraph.split(" ")]
        at = lambda i: words[i] if i < len(words) else None  # noqa: B023, E731
        for i in range(len(words)):
            unit = chained(chained(at(i), at(i + 1)), at(i + 2))
            n += 1
            for s in range(multiset.LANES):
                lanes[s] += unit >> s & 1
    return wide, [*lanes, n], n


def cosine(a, b):
    x, y = a[1], b[1]
    if x == y:
        return 1.0
    p, q = np.array(x[:-1]) * 2.0 - x[-1], np.array(y[:-1]) * 2.0 - y[-1]
    size = np.sqrt(p @ p) * np.sqrt(q @ q)
    return float(np.clip(p @ q / size, 0, 1)) if size else 0.0


def test_fingerprints_and_likeness_by_loops(spark):
    rows = [(i, t) for i, t in ROWS if len(t or "") < 5_000]
    order = sorted(rows, reverse=True)
    texts = [t or "" for _, t in order]
    halves = [len(t) // 2 for t in texts]
    edited = [t[: len(t) - h] + texts[(k + 1) % len(texts)][:h] for k, (t, h) in enumerate(zip(texts, halves, strict=True))]
    own, new = [vector(t) for t in texts], [vector(t) for t in edited]
    written = lambda v: "".join(f"{x:08x}" for x in [*v[0], *v[1]])
    got = {r.doc_id: r for r in multiset.fingerprints(frame(spark, rows)).collect()}
    for k, (i, _) in enumerate(order):
        following = own[(k + 1) % len(own)]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (written(own[k]), written(new[k]))
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((cosine(own[k], new[k]), cosine(own[k], following)), abs=1e-9)
        # Two fingerprints, as they are written, are all that their likeness needs.
        read = [(None, [int(f[8 * p : 8 * p + 8], 16) for p in range(multiset.WIDE, len(f) // 8)]) for f in (got[i].fingerprint, got[i].edited_fingerprint, got[order[(k + 1) % len(order)][0]].fingerprint)]
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((cosine(read[0], read[1]), cosine(read[0], read[2])), abs=1e-9)


def test_likeness_follows_the_shared_triples():
    """The cosine of the lanes estimates that of the multisets of triples, to about 1 / sqrt(LANES)."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    gaps = []
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for _ in range(12):
            a = list(rng.choice(words, 200))
            b = a[: int(200 * share)] + list(rng.choice(words, 200 - int(200 * share)))
            gaps.append(cosine(vector(" ".join(a)), vector(" ".join(b))) - share)
    assert abs(np.mean(gaps)) < 0.06 and np.sqrt(np.mean(np.square(gaps))) < 1.2 / np.sqrt(multiset.LANES)
