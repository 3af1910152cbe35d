"""Token counts of flat token files: a vectorised search for end-of-document ids, block by block,
stitched by a prefix scan.

A token file is nothing but little-endian ids of a fixed width; each document ends with the end
id. There is no index. Blocks of a file are read and searched anywhere; a block only knows where
its own end ids lie. A scan over each file's blocks, in order, then gives how many documents end
before a block and where the last one ended, which closes documents that cross block edges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.common import as_bytes, kept, new_folder, text_slices

#: Bytes of a written file (a single document may exceed it), and ids searched at a time.
FILE_BYTES, BLOCK_IDS = 8 << 20, 1 << 20


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("orrery", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenize `docs(doc_id, text)` and write 16-bit ids, an end id (the first id beyond the
    vocabulary) after each document, to flat files in `folder`, an address that pyarrow's file
    systems reach from every executor. Gives `(file, place, doc_id, length)`: which document is a
    file's n-th, and the file's bytes. A file gets its name, which has a hash of its content, only when it is whole; a task that
    runs again leaves those that are there. Files that no row of the result names are not read."""
    end = encoding(path).n_vocab
    if end >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem, FileType

        encode = encoding(path).encode_ordinary
        system, root = FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt, file = context.partitionId(), context.taskAttemptId(), 0
        held: list[bytes] = []
        ids: list[object] = []
        size = 0
        kind_of = None

        def out() -> pa.RecordBatch:
            # The name follows from what the file holds, so attempts whose rows differ never mix.
            name = f"part-{part:06d}-{file:05d}-{hashlib.blake2b(b''.join([*held, repr(ids).encode()]), digest_size=8).hexdigest()}.bin"
            if system.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                with system.open_output_stream(f"{root}/_{attempt}-{name}") as stream:
                    stream.write(b"".join(held))
                try:
                    system.move(f"{root}/_{attempt}-{name}", f"{root}/{name}")
                except OSError:  # another attempt was first; some stores don't rename onto a file
                    if system.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                        raise
                    system.delete_file(f"{root}/_{attempt}-{name}")
            n = len(ids)
            columns = [pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array(ids, kind_of), pa.array([size] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "place", "doc_id", "length"])

        for batch in text_slices(batches):
            kind_of = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                data = np.array([*encode((text or b"").decode()), end], "<u2").tobytes()
                if held and size + len(data) > file_bytes:
                    yield out()
                    held, ids, size, file = [], [], 0, file + 1
                held.append(data)
                ids.append(doc_id)
                size += len(data)
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, place bigint, doc_id {kind}, length bigint")


def flat_counts(spark: SparkSession, folder: str, end: int, width: int = 2, block: int = BLOCK_IDS, files: DataFrame | None = None) -> DataFrame:
    """Flat token files in `folder` -> `(file, place, n_tokens, closed)`: a row per document, the
    end id not counted. `files(file, length)` names them with their bytes; without it the folder is
    listed. Ids behind a file's last end id are a document with `closed` false.
    Empty files have no documents; a file that isn't a whole number of ids is an error."""
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    blocks = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (block * width)))).alias("block"))
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(folder)
        for batch in batches:
            rows: list[tuple[int, list[int]]] = []
            for file, length, k in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "block")), strict=True):
                if length % width:
                    raise ValueError(f"{file} has {length} bytes")
                with system.open_input_file(f"{root}/{file}") as stream:
                    stream.seek(k * block * width)
                    ids = np.frombuffer(stream.read(min(block * width, length - k * block * width)), f"<u{width}")
                rows.append((len(ids), np.flatnonzero(ids == end).tolist()))
            ends = pa.array([x for _, x in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array([n for n, _ in rows], pa.int64()), ends], names=["file", "block", "ids", "ends"])

    found = spread.mapInArrow(search, "file string, block bigint, ids bigint, ends array<int>")
    found = kept(found.withColumn("first", F.col("block") * block), "ends")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = F.col("first") + F.element_at("ends", -1)
    scan = found.select(
        "file", "first", "ends", "ids", F.lead("block").over(order).isNull().alias("final"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.when(F.size("ends") > 0, last)).over(before), F.lit(-1)).alias("end_before"),
    )
    at = F.transform("ends", lambda e: F.col("first") + e)
    open_end = F.when(F.col("final"), F.array(F.col("first") + F.col("ids"))).otherwise(F.array().cast("array<bigint>"))
    ends = scan.select("file", "docs_before", "final", F.size("ends").alias("n"), F.concat(F.array("end_before"), at, open_end).alias("at"))
    counts = ends.select("file", "docs_before", "n", "at", F.posexplode(F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1), lambda b, a: b - a - 1)).alias("i", "n_tokens"))
    rows = counts.select("file", (F.col("docs_before") + F.col("i")).cast("bigint").alias("place"), "n_tokens", (F.col("i") < F.col("n")).alias("closed"))
    return rows.where("closed or n_tokens > 0")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """`docs(doc_id, text, ...)` -> `(doc_id, n_tokens)`, one row per input row, from flat token
    files that are written and searched. Null texts count as empty and have no tokens. Null and
    repeated doc_ids are rows as any other; other columns aren't read."""
    folder = new_folder(docs.sparkSession, "flat")
    names = kept(write_flat(docs, path, folder), "names")
    if names.isEmpty():
        return names.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"))
    counts = flat_counts(docs.sparkSession, folder, encoding(path).n_vocab, files=names.groupBy("file").agg(F.max("length").alias("length")))
    return names.join(counts.where("closed"), ["file", "place"]).select("doc_id", "n_tokens")
