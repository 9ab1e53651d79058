"""Words of a slice are remembered in one step, and forgetting keeps those that were met again."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from fieldmark.llm import packing
from fieldmark.llm.words import Words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_of_a_slice_are_put_at_once(monkeypatch):
    whole = Tokenizer.from_file(PATH)
    monkeypatch.setattr(packing, "_WORDS", 40)
    calls, put = [], packing.WordIds._put
    monkeypatch.setattr(packing.WordIds, "_put", lambda self, *a: calls.append(a) or put(self, *a))
    known = packing.WordIds(PATH)
    for k in range(6):
        texts = [" ".join(f"word{j} Other{j * k}, x" for j in range(30)), None, "", "É ü 漢字 word1"]
        before = len(calls)
        ids, counts = known.ids(Words(pa.array(texts)))
        # one call for the slice, and one to keep what forgetting keeps
        assert len(calls) - before <= 2
        expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


def test_a_remembered_word_takes_few_bytes():
    known = packing.WordIds(PATH)
    known.ids(Words(pa.array(["a 1"])))
    n, tracemalloc_was = 60_000, tracemalloc.is_tracing()
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for k in range(0, n, 10_000):
        known.ids(Words(pa.array([" ".join(f"{j}x" for j in range(k, k + 10_000))])))
    held = tracemalloc.get_traced_memory()[0] - before
    if not tracemalloc_was:
        tracemalloc.stop()
    assert held / n < 110
