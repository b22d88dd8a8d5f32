"""The block encoder gives the codec's ids."""
import random

import numpy as np
import pyarrow as pa
import pytest

from panelkit.llm import bpe, bulk_words
from panelkit.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    spec = bpe.read_spec(tokenizer_path())
    return bpe.BytePairCodec(spec), bulk_words.BulkEncoder(spec)


def test_blocks_of_odd_texts(both, noisy_docs):
    codec, bulk = both
    rng = random.Random(2)
    alphabet = [*"abc xyz\'ÀéßİıſΣςǅ日本ñ\x00\x1c\n\t.,!<|0123١٢ẹe\u0323\u00a0\u3000\u2003🙂\u0301\u212a",
                "<|endoftext|>", "<|startoftext|>", "n't", "'s"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(6000)] + [None, "", " ", "\x00", "\x1c"]
    texts += [t for _, t in noisy_docs]
    assert bulk.encode(pa.array(texts, pa.string())) == [codec.encode(t) for t in texts]
    assert bulk.encode(pa.array([], pa.string())) == []


def test_blocks_cover_a_column():
    texts = pa.array(["a" * n for n in (0, 5, 100, 3, 3)] + [None])
    got = [(at, part.to_pylist()) for at, part in bulk_words.blocks(texts, 8)]
    assert [t for _, part in got for t in part] == texts.to_pylist()
    assert [at for at, _ in got] == np.cumsum([0] + [len(p) for _, p in got])[:-1].tolist()
    assert max(len(p) for _, p in got) < 4


def test_a_vocabulary_that_merges_otherwise_is_refused(both):
    import json
    spec = json.loads(both[0].spec)
    merges = spec["model"]["merges"]
    merges[300], merges[20000] = merges[20000], merges[300]
    with pytest.raises(ValueError):
        bulk_words.BulkEncoder(json.dumps(spec))
