"""Plain re-statements of the operators' results, and a table of awkward documents."""

import hashlib
import random
import re

import xxhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, row string, spans string, gone_id bigint, word string"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def awkward(seed=0, n=60):
    """Nulls, empty and blank texts, copies, near copies, shared passages, one very long text,
    repeated rows; extra columns whose names the operators use inside."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["été", "naïve", "日本", "A", "the", "THE"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = text(80), text(200)
    texts = [None, "", " \n\t ", "one", "one", "Two words", "a b c d", base, base, base.replace("w1 ", "w2 ", 1)]
    texts += [text(rng.randint(1, 150)) for _ in range(n)]
    texts += [text(30) + " " + passage + "\n" + text(20) for _ in range(5)] + [passage, passage[: len(passage) // 2], (text(5) + "\n") * 200]
    texts += [text(30_000), "x" * 20_000, "<|endoftext|> a <|startoftext|>", "the " * 300]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", "s", 2, "w") for i, t in rows], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def simhash(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    """doc_id -> (fingerprint, least reachable doc_id)."""
    fp = {i: simhash(t) for i, t in rows}
    ids = sorted(fp)
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and low[b] < low[a]:
                    low[a], moved = low[b], True
    return {i: (f"{fp[i]:016x}", low[i]) for i in ids}


def near_roots(rows, words=5, least=0.8):
    """The least doc_ids of the groups that a Jaccard of `least` or more over word runs links."""
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[p : p + words]) for p in range(max(1, len(w) - words + 1))}
    ids = sorted(sets)
    low = {i: i for i in ids}
    links = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                moved = True
    return {i for i in ids if low[i] == i}


def cut(rows, size=50):
    """doc_id -> (words, removed, kept words)."""
    first = {}
    for i, t in sorted(rows):
        w = words_of(t)
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), i)
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def leaks(rows, items, window=10):
    """doc_id -> (words, hit words, items, hash of the items' ids, contaminated)."""
    tokens = lambda t: PLAIN.findall((t or "").translate(LOWER))
    wanted = {}
    for i, t in items:
        w = tokens(t)
        size = min(window, len(w))
        for p in range(len(w) - size + 1) if size else ():
            wanted.setdefault(tuple(w[p : p + size]), set()).add(i)
    sizes = {len(k) for k in wanted}
    out = {}
    for i, t in rows:
        w, hit, names = tokens(t), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in wanted:
                    hit |= set(range(p, p + size))
                    names |= wanted[k]
        out[i] = (len(w), len(hit), len(names), sha(",".join(sorted(map(str, names)))), bool(hit))
    return out
