"""Other vocabulary files: used as the library uses them, or refused; never silently wrong."""

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from orrery.llm import ans, bpe, token_counts

BYTES, WORDS, FLAT = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
TEXTS = ["", "Hello, World! it's  12.5", "Été\u00a0naïve ΣΑΣ", "<|endoftext|>x", "a.b,,c 日本"]


def changed(tmp_path, path, **settings):
    data = json.load(open(path, encoding="utf-8")) | settings
    out = tmp_path / "changed.json"
    out.write_text(json.dumps(data), encoding="utf-8")
    return str(out)


def test_word_files_with_other_rules_are_used_as_they_are(tmp_path):
    plain = ans.WordTokens(WORDS)
    other = ans.WordTokens(changed(tmp_path, WORDS, normalizer={"type": "NFC"}))
    assert plain.by_word and not other.by_word
    for tokens in (plain, other):
        got = tokens(pa.array(TEXTS))
        assert got == [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in TEXTS]


def test_byte_files_with_other_rules_are_refused(tmp_path):
    assert bpe.Merges(BYTES).size == Tokenizer.from_file(BYTES).get_vocab_size()
    with pytest.raises(ValueError):
        bpe.Merges(changed(tmp_path, BYTES, normalizer={"type": "Lowercase"}))
    with pytest.raises(ValueError):
        bpe.Merges(WORDS)


def test_a_task_that_runs_again_leaves_its_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words " * (i % 7)) for i in range(40)], "doc_id long, text string").coalesce(2)
    folder = f"file://{tmp_path}/flat"
    first = sorted(map(tuple, token_counts.write_flat(docs, FLAT, folder, 60).collect()))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "flat").iterdir()}
    assert sorted(map(tuple, token_counts.write_flat(docs, FLAT, folder, 60).collect())) == first
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "flat").iterdir()} == before and len(before) > 5
