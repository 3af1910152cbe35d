"""URL verdicts: rules first, then naive Bayes over segmented host and path words.

Words in hosts are often written together. A unigram model, counted over page titles and the
words that hosts and paths themselves keep apart, scores every way to split a run of letters; the
best is found by dynamic programming (Viterbi). The words that can lie in a run come to it by a
join of its substrings with the counts, so no task holds the vocabulary; a bit filter of the
counted words, of fixed size, first drops nearly all substrings that aren't words. Words and runs
may have any length. Multinomial naive Bayes is learned from the pages that a rule decides, and
scores the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Grams, cells, kept, mixed

#: Host suffix and path prefix, and what is done with pages that fit.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bits of the filter of counted words, as a power of two; letters looked through at a time.
FILTER, LETTERS_AT_ONCE = 24, 1 << 20
LETTER = mixed(np.arange(1, 257, dtype=np.uint64))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from
    there up to `?`, `#` or the end. Both empty without `://`."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substring(url, place + 3, F.char_length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.char_length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([a-z]+)"), 1)


def kept_apart(text: Column) -> Column:
    """Letter runs that a hyphen or another such sign parts from another one within the same label of a
    host or segment of a path. A run alone in its label may be joined words, and isn't counted."""
    labels = F.filter(F.split(text, "[./]"), lambda x: x.rlike("[a-z][0-9]*[-_+,~][-_+,~0-9]*[a-z]"))
    return F.flatten(F.transform(labels, letter_runs))


def segment(run: str, cost: dict[str, float], total: float) -> list[str]:
    """The split of a run of letters with the least cost. A part of n letters that isn't a known
    word costs as much as a word seen 10 / 10^n times. That grows evenly with n, so the best split
    that ends in such a part is carried from letter to letter, and parts may have any length."""
    n, letter = len(run), math.log(10)
    first = math.log(total) - letter
    known: dict[int, list[tuple[int, float]]] = {}
    for size in sorted({len(w) for w in cost}, reverse=True):
        for begin in range(n - size + 1):
            if (c := cost.get(run[begin : begin + size])) is not None:
                known.setdefault(begin + size, []).append((begin, c))
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    unknown, since = math.inf, 0  # the best split that ends in an unknown part, and where that begins
    for end in range(1, n + 1):
        unknown += letter
        if (c := best[end - 1] + first + letter) < unknown:
            unknown, since = c, end - 1
        best[end], back[end] = unknown, since
        for begin, c in known.get(end, ()):
            if best[begin] + c < best[end]:
                best[end], back[end] = best[begin] + c, begin
    words, end = [], n
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def letters_of(runs: list[bytes]) -> tuple[Grams, np.ndarray, np.ndarray]:
    """The letters of several runs one after the other, hashed, with each run's begin and end."""
    ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
    return Grams(LETTER[np.frombuffer(b"".join(runs), np.uint8)]), np.append(0, ends[:-1]), ends


def word_filter(counts: DataFrame) -> np.ndarray:
    """A table of 2^FILTER places, true where a counted word's hash falls. Tasks give 64 places a row;
    Spark puts them together, and the driver holds the one table, however many words there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, begin, end = letters_of(cells(batch.column("word")))
            slot = np.unique(grams.spans(begin, end) >> np.uint64(64 - FILTER))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["cell", "bits"])

    rows = counts.select("word").mapInArrow(run, "cell int, bits bigint").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER - 6), np.uint64)
    table[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def words_inside(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct `runs(id, run)` -> `(id, word)`: the distinct substrings that pass the filter of the
    counted words, for the lengths that those have."""
    sizes = sorted(r[0] for r in counts.select(F.char_length("word")).distinct().collect())  # a row per length
    shared = runs.sparkSession.sparkContext.broadcast(word_filter(counts))

    def some(ids: np.ndarray, part: list[bytes]) -> Iterator[pa.RecordBatch]:
        grams, begin, end = letters_of(part)
        number = np.repeat(np.arange(len(part)), end - begin)
        data = b"".join(part)
        for size in sizes:
            found = grams.every(size)
            at = np.flatnonzero(shared.value[found >> np.uint64(64 - FILTER)])
            at = at[number[at] == number[at + size - 1]]
            order = np.lexsort((found[at], number[at]))
            at = at[order]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(number[at]) != 0) | (found[at[1:]] != found[at[:-1]])
            for lo in range(0, len(at := at[new]), 1 << 16):
                own = at[lo : lo + (1 << 16)].tolist()
                words = pa.array([data[i : i + size] for i in own], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[number[own]]), words], names=["id", "word"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part = np.asarray(batch.column("id")), cells(batch.column("run"))
            piece = np.cumsum(np.fromiter(map(len, part), np.int64, len(part))) // LETTERS_AT_ONCE
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(part)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield from some(ids[lo:hi], part[lo:hi])

    return runs.select("id", "run").mapInArrow(run, "id bigint, word string")


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct `runs(run)`, `counts(word, n)` -> `(run, words ARRAY<STRING>)`."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    runs = kept(runs.select("run").withColumn("id", F.monotonically_increasing_id()), "runs")
    inside = words_inside(runs, counts).join(counts, "word")
    known = inside.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for text, have in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True):
                cost = {w: math.log(total) - math.log(n) for w, n in have or ()}
                words.append(segment(text, cost, total))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return runs.join(known, "id", "left").select("run", "known").mapInArrow(run, "run string, words array<string>")


def tokens_of(keys: DataFrame, split: DataFrame, mark: str) -> DataFrame:
    """Distinct `keys(id, key)` -> `(id, token)`: the words of its runs, and `#` for its numbers."""
    runs = keys.select("id", F.explode(letter_runs(F.lower("key"))).alias("run"))
    words = runs.join(split, "run").select("id", F.explode("words").alias("token"))
    numbers = keys.select("id", F.explode(F.regexp_extract_all("key", F.lit("([0-9]+)"), 1)).alias("x")).select("id", F.lit("#").alias("token"))
    return words.unionByName(numbers).select("id", F.concat(F.lit(mark), "token").alias("token"))


def verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, smoothing: float = 1.0) -> DataFrame:
    """`pages(page_id, url, html, ...)` -> `(page_id, host, path, rule, verdict, block_score)`, one
    row per input row.

    A rule fits its host and all its subdomains where the url's path begins with the rule's; the
    longest decides. The other pages are blocked if block_score, naive Bayes' log odds of `block`,
    is above 0; where no page with a rule is blocked, or none allowed, it rests on the smoothing.
    Null urls and urls without `://` have an empty host and path, no words, and only the classes'
    shares as their score. Null html gives no words. Repeated rows and ids are judged alike; other
    columns aren't read. Every page's host and path are scored once per distinct value, so hot
    hosts cost one row; numbers in paths are one token.
    """
    rules = tuple(rules)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("path_key", F.regexp_replace("path", "[0-9]+", "0")).withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
    urls = kept(urls, "urls")
    of = lambda v: F.count_if(F.col("ruled.verdict") == v).alias(v)
    keys = lambda c: urls.groupBy(F.col(c).alias("key")).agg(of("block"), of("allow")).withColumn("id", F.monotonically_increasing_id())
    hosts, paths = kept(keys("host"), "hosts"), kept(keys("path_key"), "paths")

    titles = pages.select(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1).alias("text"))
    apart = hosts.select("key").unionByName(paths.select("key"))
    words = titles.select(letter_runs(F.lower("text")).alias("words")).unionByName(apart.select(kept_apart(F.lower("key")).alias("words")))
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = kept(counts, "counts")
    runs = apart.select(F.explode(letter_runs(F.lower("key"))).alias("run")).distinct()
    split = kept(segmented(runs, counts), "split")

    both = [kept(tokens_of(keys.select("id", "key"), split, mark), "tokens") for keys, mark in ((hosts, "h:"), (paths, "p:"))]
    seen = [t.join(k.drop("key"), "id").groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")) for t, k in zip(both, (hosts, paths), strict=True)]
    seen = kept(reduce(DataFrame.unionByName, seen), "seen")
    sums = seen.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    size, blocked, allowed = (x or 0 for x in sums)
    pages_of = hosts.agg(F.sum("block"), F.sum("allow")).first()
    prior = math.log((pages_of[0] or 0) + smoothing) - math.log((pages_of[1] or 0) + smoothing)
    log = lambda n, total: F.log(F.col(n) + smoothing) - F.lit(math.log(total + smoothing * (size + 1)))
    weight = seen.select("token", (log("block", blocked) - log("allow", allowed)).alias("weight"))
    scored = [k.select("id", "key").join(t.join(weight, "token").groupBy("id").agg(F.sum("weight").alias("score")), "id", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score")) for k, t in zip((hosts, paths), both, strict=True)]
    by_host = scored[0].select(F.col("key").alias("host"), F.col("score").alias("host_score"))
    by_path = scored[1].select(F.col("key").alias("path_key"), F.col("score").alias("path_score"))
    score = F.lit(prior) + F.col("host_score") + F.col("path_score")
    out = urls.join(by_host, "host").join(by_path, "path_key").withColumn("block_score", score)
    other = F.when(F.col("block_score") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "ruled.rule", F.coalesce("ruled.verdict", other).alias("verdict"), "block_score")
