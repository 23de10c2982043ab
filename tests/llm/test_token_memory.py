"""What the encoder holds at once, besides what it remembers."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm.wavelet import ChunkEncoder


def test_a_slice_of_texts_is_encoded_in_little_memory():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))) for _ in range(2000)]
    texts = [" ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", "."]) for _ in range(5000)) for _ in range(20)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = ChunkEncoder(path)
    ids, each = encoder.batch(data, offsets)
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [k for w in want for k in w] and each.tolist() == [len(w) for w in want]
    tracemalloc.start()
    encoder.batch(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data), peak / len(data)
