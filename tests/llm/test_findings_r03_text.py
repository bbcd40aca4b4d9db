"""Findings on the text operators: work and memory that grew with what is remembered or held."""

import tracemalloc

import numpy as np
import public_tokenizers

from pipeloom.llm.packing import _Ids
from pipeloom.llm.quality import FactorMachine


def test_op5_learning_does_not_walk_the_words_remembered(monkeypatch):
    ids = _Ids(public_tokenizers.path("word_bpe_49k.json"))
    ids.learn([["some", "words", "here,"]])

    def walked(self):
        raise AssertionError("all remembered words are walked")

    monkeypatch.setattr(_Ids, "__iter__", walked)
    ids.learn([["some", "other", "words.", "Here"]])
    for word in ("some", "words", "here,", "other", "words.", "Here"):
        assert dict.__getitem__(ids, word) == np.array(ids.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()


def test_pipeline_the_fit_holds_few_values_at_once():
    rng = np.random.default_rng(5)
    rows, each = 2000, 300
    first = np.arange(0, rows * each + 1, each)
    feature, value = rng.integers(0, 5000, rows * each).astype(np.int32), rng.random(rows * each, np.float32)
    label = (np.arange(rows) % 2).astype(np.int64)
    tracemalloc.start()
    FactorMachine(5000).fit(first, feature, value, label, np.ones(rows), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(value), peak / len(value)
