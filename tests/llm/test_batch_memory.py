"""What the batched encoder needs at once doesn't grow with the batch."""

import random
import tracemalloc

from sieveline.llm.bpe import vocabulary
from sieveline.llm.bpe_batch import BatchEncoder
from sieveline.llm.queries import TOKENIZER


def test_encoding_eight_megabytes_needs_little_memory():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(900)]
    encoder = BatchEncoder(vocabulary(TOKENIZER))
    encoder.encode(texts[:1])
    tracemalloc.start()
    try:
        made = encoder.encode(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 900 and peak < 120 << 20
