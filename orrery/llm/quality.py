"""Quality scores: random Fourier features of document statistics, ridge regression from
partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import as_bytes, kept, text_slices, told_apart, whole_rows

LETTERS_UP = np.zeros(256, bool)
LETTERS_UP[65:91] = True
LETTERS_LOW = np.zeros(256, bool)
LETTERS_LOW[97:123] = True
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
BEYOND = np.arange(256) >= 128
MARKS = ~(LETTERS_UP | LETTERS_LOW | DIGITS | BLANKS | BEYOND)
PLAIN = np.zeros(256, bool)
PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True

NAMES = (
    "log_words", "word_mean", "word_sd", "upper", "digit", "blank", "plain_marks", "other_marks", "beyond", "bytes_entropy",
    "distinct_words", "top_word", "top5_words", "word_entropy", "log_lines", "line_mean", "distinct_lines", "lines_closed",
    "short_words", "long_words", "marked_words", "capital_words", "pair_repeats", "longest_word",
)


def statistics(text: bytes | None) -> list[float]:
    """Numbers about a text's form; a null, empty or blank text gives zeros."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    often = np.sort(np.fromiter(seen.values(), np.int64, len(seen)))[::-1]
    q = often / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    closed = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    letters = max(1, int(counts[LETTERS_UP].sum() + counts[LETTERS_LOW].sum()))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), counts[LETTERS_UP].sum() / letters, counts[DIGITS].sum() / size,
        counts[BLANKS].sum() / size, counts[PLAIN].sum() / size, counts[MARKS & ~PLAIN].sum() / size, counts[BEYOND].sum() / size, float(-(p * np.log(p)).sum()),
        len(seen) / n, float(q[0]), float(q[:5].sum()), float(-(q * np.log(q)).sum()), float(np.log1p(len(lines))), float(np.log1p(n / len(lines))), len(set(lines)) / len(lines), closed / len(lines),
        float((lengths <= 3).mean()), float((lengths >= 12).mean()), sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, sum(w[:1].isupper() for w in words) / n, 1 - pairs / max(1, n - 1), float(np.log1p(lengths.max())),
    ]


def features(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`docs(keys..., text, ...)` -> `(keys..., x ARRAY<DOUBLE>)`, one row per input row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            x = [statistics(t) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(x, pa.list_(pa.float64()))], names=[*keys, "x"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, x array<double>")


@dataclass
class Model:
    """Scaling, random frequencies and phases, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated share of label 1, with a thousandth of the raw score to part ties."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, *self.steps) + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return np.asarray(x.flatten(), np.float64).reshape(len(x), -1) if len(x) else np.zeros((0, len(NAMES)))


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ordered bins: where the blocks lie, and their rising shares."""
    blocks: list[list[float]] = []
    for x, k, m in zip(at, ones, n, strict=True):
        blocks.append([x * m, k, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(labelled: DataFrame, waves: int = 256, width: float = 6.0, ridge: float = 1e-3, bins: int = 2000, seed: int = 7) -> Model:
    """`labelled(x ARRAY<DOUBLE>, label INT)` -> the model. All rows count: each task sums its own
    part of the normal equations; Spark adds the parts. What reaches the driver is the sums (one
    row per cell of a waves x waves matrix) and at most `bins` counts, whatever the input's size.
    Without any row, or with one label only, the score is the same for all texts."""
    d = len(NAMES)
    first = labelled.select(*[F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s")).alias(f"c{i}") for i in range(d)]).first()
    mean = np.array([first[i]["m"] or 0.0 for i in range(d)])
    scale = np.array([first[i]["s"] or 1.0 for i in range(d)])
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(size=(d, waves)) / width, rng.uniform(0, 2 * np.pi, waves))

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            phi, y = model.fourier(matrix(batch)), np.asarray(batch.column("label"), np.float64)
            total[:, :-1] += phi.T @ phi
            total[:, -1] += phi.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(waves + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = labelled.select("x", "label").mapInArrow(sums, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    total = np.zeros((waves + 1, waves + 2))
    for i, j, v in cells.groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v
    n = max(1.0, total[-1, -2])
    damp = ridge * n / waves * np.eye(waves + 1)
    damp[-1, -1] = 1e-9
    model.weight = np.linalg.solve(total[:, :-1] + damp, total[:, -1])

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor((np.clip(model.raw(matrix(batch)), -1, 2) + 1) / 3 * (bins - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("label").cast(pa.int64())], names=["bin", "label"])

    rows = labelled.select("x", "label").mapInArrow(binned, "bin int, label bigint").groupBy("bin").agg(F.sum("label").alias("k"), F.count("*").alias("n")).orderBy("bin").collect()
    if rows:
        at = np.array([r["bin"] for r in rows]) / (bins - 1) * 3 - 1
        model.steps = isotonic(at, np.array([r["k"] for r in rows], float), np.array([r["n"] for r in rows], float))
    else:
        model.steps = (np.zeros(1), np.full(1, 0.5))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """`docs(doc_id, text, ...)`, `labels(doc_id, <label> 0/1, ...)` -> `(doc_id, held_out, score,
    predicted)`, one row per input row of `docs`.

    Learned from the labelled documents whose crc32(doc_id as text) mod 5 isn't 0; only the
    text's own statistics are inputs. Null, empty and blank texts have the statistics of nothing
    (zeros) and are scored like any other. Null labels, labels without a document and documents
    without a label don't take part in the fit; repeated labels count each. A null doc_id is
    scored, never learned from, and not held out. Other columns aren't read.
    """
    return judged(docs, labels, label, threshold, ("doc_id",))


def judged(docs: DataFrame, labels: DataFrame, label: str, threshold: float, keys: tuple[str, ...]) -> DataFrame:
    """scores, with further columns of `docs` in its keys beside doc_id in the result."""
    x = kept(features(docs, keys), "features")
    truth = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(kept(x.join(truth, "doc_id").select("x", "label"), "labelled"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(matrix(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(s)], names=[*keys, "score"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    found = x.mapInArrow(run, f"{kinds}, score double")
    return found.select(*keys, held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject. Texts are judged, not
    ids: of rows that share a doc_id, or have none, those with good texts stay."""
    told, _ = told_apart(whole_rows(docs))
    bad = judged(told.select("doc_id", "mark", "text"), labels, label, threshold, ("doc_id", "mark")).where("predicted = 0")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    return told.join(bad, told.doc_id.eqNullSafe(bad.bad_id) & (told["mark"] == bad.bad_mark), "left_anti").select("row.*")
