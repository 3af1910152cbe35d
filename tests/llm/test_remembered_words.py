"""What a Python worker remembers of the words it encoded is bounded, and forgetting changes no ids."""

import pyarrow as pa

from orrery.llm import bpe
from orrery.llm.common import WORD_CACHE, Remembered, vocabulary


def test_an_encoder_remembers_fewer_words_than_a_worker_may():
    assert bpe.Encoder(vocabulary("byte_bpe_50k.json")).words.most <= WORD_CACHE // 2


def test_forgotten_words_are_encoded_anew():
    few, all_ = (bpe.Encoder(vocabulary("byte_bpe_50k.json")) for _ in range(2))
    few.words = Remembered(200)
    texts = [pa.array([" ".join(f"word{i % 450}x" for i in range(lo, lo + 60))]) for lo in range(0, 3000, 60)]
    assert [few(t) for t in texts] == [all_(t) for t in texts]
    assert len(few.words) + len(few.words.older) <= 2 * (100 + 60) and len(all_.words) >= 450
