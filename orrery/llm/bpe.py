"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from orrery.llm.common import WORD_CACHE, Remembered, cells, gathered, text_slices

#: Fixed values of byte-level BPE files: how texts are cut before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if chr(b) not in letters:
            letters[chr(0x100 + len(letters) - len(plain))] = b
    return letters


#: Bytes of a piece from which on it is merged by itself.
LONG = 1_024


class Merges:
    """A vocabulary with its merges as sorted pair keys, and encoding of many pieces at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model, cut = data["model"], data.get("pre_tokenizer") or {}
        known = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not data.get("normalizer") and model.get("type") == "BPE"
        if not known or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} isn't byte-level BPE with the cut and rules that are built here")
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        tokens = [b""] * self.size
        for token, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.tokens = pa.array(tokens, pa.binary())
        self.start = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.start[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        makes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        _, last = np.unique(keys[::-1], return_index=True)  # of a repeated pair the last counts
        ranks = len(keys) - 1 - last
        self.keys, self.ranks, self.makes = keys[ranks], ranks, makes[ranks]
        # The least rank of a merge that takes a token in: what a merge makes is only taken up
        # later than the merge itself, if that rank is the higher one.
        taken = np.full(self.size, len(keys) + 1, np.int64)
        np.minimum.at(taken, self.keys // self.size, self.ranks)
        np.minimum.at(taken, self.keys % self.size, self.ranks)
        self.at_once = taken[self.makes] > self.ranks

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the pieces one after the other, and how many each piece has. All pieces
        lie in one flat array. In each round every piece applies its lowest-rank pair: at all its
        places from left to right, where that can't bring up a lower rank, else at the first
        place only, as a queue by rank and place would. Pieces without a pair leave the array. Long
        pieces have rounds of their own (see long_piece)."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i in [i for i, p in enumerate(pieces) if len(p) > LONG]:
            ids = self.long_piece(pieces[i])
            done.append((np.full(len(ids), i), ids))
        total = len(pieces)
        pieces = [p if len(p) <= LONG else b"" for p in pieces] if done else pieces
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        none = len(self.keys) + 1
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            found = np.append(np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1), 0)
            known = (self.keys[found[:-1]] == key) & (piece[:-1] == piece[1:])
            rank = np.append(np.where(known, self.ranks[found[:-1]], none), none)
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            length = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            if (over := best == none).any():
                stay = np.repeat(~over, length)
                done.append((piece[~stay], symbols[~stay]))
                symbols, piece, rank, found = symbols[stay], piece[stay], rank[stay], found[stay]
                if not len(symbols):
                    break
                length, best = length[~over], best[~over]
            hit = np.flatnonzero(rank == np.repeat(best, length))
            # In a run of overlapping places (a pair of equal symbols) every other one merges.
            run = np.append(True, np.diff(hit) > 1)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            leading = np.append(True, piece[hit[1:]] != piece[hit[:-1]])
            hit = hit[leading | self.at_once[found[hit]]]
            symbols[hit] = self.makes[found[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, piece = symbols[stay], piece[stay]
        if not done:
            return np.zeros(0, np.int64), np.zeros(total, np.int64)
        piece, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=total)

    def long_piece(self, piece: bytes) -> np.ndarray:
        """Token ids of one long piece. Places wait under the rank of their pair; each round takes the
        lowest rank's and works on these and their neighbours only, so rounds cost what they merge,
        not the piece's length."""
        symbols = self.start[np.frombuffer(piece, np.uint8)].copy()
        n, none = len(symbols), len(self.keys) + 1
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, found = np.full(n, none, np.int64), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[(at >= 0) & alive[at]]
            rank[at] = none
            at = at[after[at] < n]
            key = symbols[at] * self.size + symbols[after[at]]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[where] == key
            at, where = at[known], where[known]
            rank[at], found[at] = self.ranks[where], where
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            ranks, first = np.unique(rank[at], return_index=True)
            for r, places in zip(ranks.tolist(), np.split(at, first[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(places)

        wait(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[alive[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            # In a run of overlapping places (a pair of equal symbols) every other one merges.
            run = np.append(True, after[hit[:-1]] != hit[1:])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            if not self.at_once[found[hit[0]]]:
                if len(hit) > 1:
                    waiting[r] = [hit[1:]]
                    heapq.heappush(queue, r)
                hit = hit[:1]
            right = after[hit]
            symbols[hit] = self.makes[found[hit]]
            alive[right] = False
            rank[right] = none
            after[hit] = after[right]
            inside = after[hit] < n
            before[after[hit][inside]] = hit[inside]
            wait(np.unique(np.concatenate([hit, before[hit]])))
        return symbols[alive]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The texts of lists of ids (little-endian, 32 bits), special tokens included; bytes that
        aren't UTF-8 are replaced."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        texts = gathered(self.tokens, np.frombuffer(b"".join(ids), "<u4").astype(np.int64), lengths)
        return [valid(t) for t in texts]


def valid(text: bytes) -> bytes:
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


#: Words that an encoder remembers. A Python worker keeps them beyond its stage, so in a job of several
#: stages they lie beside all that later ones need.
WORDS = WORD_CACHE // 2


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Encodes texts by words whose ids (little-endian, 32 bits) are remembered.

    A single space or line feed between two characters that aren't white space always begins a
    new piece, which no merge crosses. So a text is split there, and each word with the space or
    line feed before it is cut and encoded once. Texts with other white space around such a
    place, and those that hold a special token, are cut as a whole.
    """

    def __init__(self, path: str):
        import regex

        self.merges = merges(path)
        self.cut = regex.compile(CUT).findall
        special = sorted(self.merges.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.words = Remembered(WORDS)
        self.feed = 4 * len(self.merges.encode([b"\n"])[0])

    def whole(self, text: str) -> bytes:
        """Ids of a text of any form."""
        parts = [text] if self.split is None else [x for x in self.split(text) if x]
        out = []
        for part in parts:
            i = self.merges.special.get(part)
            ids = self.merges.encode([p.encode() for p in self.cut(part)])[0] if i is None else np.array([i])
            out.append(ids.astype("<u4").tobytes())
        return b"".join(out)

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of words that stand by themselves: cut one after the other in a single text."""
        cut = self.cut("".join(words))
        ids, counts = self.merges.encode([p.encode() for p in cut])
        letters = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        last = np.searchsorted(letters, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        ends = (4 * np.cumsum(counts)[last]).tolist()
        data = ids.astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; a null counts as empty. Arrow cuts the texts and
        numbers the words, so Python sees distinct ones only."""
        texts = texts.fill_null("")
        # A line feed before each text makes all of it words with a space or line feed in front.
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("", "\n", texts, ""), "\n", " \n"), " ")
        lengths = np.diff(np.asarray(split.offsets, np.int64)) - 1
        codes = split.flatten().dictionary_encode()
        at = np.delete(np.asarray(codes.indices, np.int64), np.asarray(split.offsets, np.int64)[:-1] - split.offsets[0].as_py())
        words = [w if w[:1] == "\n" else " " + w for w in (c.decode() for c in cells(codes.dictionary))]
        ids = self.words.recall(words)
        new = [i for i, x in enumerate(ids) if x is None]
        special = self.merges.special
        odd = {i for i in new if len(w := words[i]) < 2 or w[1:].strip() != w[1:] or any(t in w for t in special)}
        plain = [i for i in new if i not in odd]
        for lo in range(0, len(plain), 50_000):
            part = plain[lo : lo + 50_000]
            for i, x in zip(part, self.learn([words[i] for i in part]), strict=True):
                ids[i] = self.words[words[i]] = x
        for i in odd:
            ids[i] = b""
        out = [x[self.feed :] for x in gathered(pa.array(ids, pa.binary()), at, lengths)]
        if odd:  # words that can't be taken by themselves: their texts are cut as a whole
            alone = np.zeros(len(words), bool)
            alone[list(odd)] = True
            number = np.repeat(np.arange(len(out)), lengths)
            for d in np.unique(number[alone[at]]).tolist():
                out[d] = self.whole(texts[d].as_py())
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that later tasks know the words of earlier ones."""
    return Encoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, ids BINARY)`: each text's token ids as little-endian
    32-bit integers. Null texts count as empty and have no ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in text_slices(batches):
            ids = encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """`ids(doc_id, ids BINARY)` -> `(doc_id, text)`. Null ids give a null text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = merges(path).decode
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = [x if x is None else t for x, t in zip(ids, decode([x or b"" for x in ids]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, n_tokens, ids_sha256, decoded_sha256)`: every text
    encoded, and its ids decoded again, in one pass. One row per input row, in any order; null
    texts count as empty; other columns aren't read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in text_slices(batches):
            ids = encode(batch.column("text"))
            texts = [digest(t) for t in encode.merges.decode(ids)]
            more = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([digest(x) for x in ids]), pa.array(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
