"""The stored field: made by the training code, right on the corpus's own texts."""

import re

import numpy as np
import pyarrow.parquet as pq

from zonewise.llm import pii

TOKEN = re.compile(r'token = "[0-9a-f]{40}')
#: A word's glued signs may come along.
WHOLE = re.compile(TOKEN.pattern + r'"?[^A-Za-z0-9\s]*')


def test_the_weights_are_those_that_training_gives(tmp_path):
    trained, stored = pii.trained(), pii.stored()
    half = 0.5 * 10**-pii.DIGITS + 1e-6
    assert set(stored.weights) <= set(trained.weights)
    for name, w in trained.weights.items():
        assert np.abs(w - stored.weights.get(name, 0.0)).max() <= half, name
    assert np.abs(trained.moves - stored.moves).max() <= half
    pii.store(trained, tmp_path / "field.json")
    assert (tmp_path / "field.json").read_bytes() == pii.WEIGHTS.read_bytes()


def test_stored_and_trained_field_decide_alike():
    trained, stored = pii.trained(), pii.stored()
    for text, _ in pii.samples(300, seed=5):
        words = [m.span() for m in pii.WORD.finditer(text)]
        assert trained.best(text, words) == stored.best(text, words)


def test_spans_on_corpus_texts():
    """Precision: each span that the field adds is a token or a card. Recall: no token stays."""
    added = tokens = 0
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        base, spans = pii.all_spans(text, pii.stored())
        for kind, a, b in set(spans) - set(base):
            added += 1
            assert (kind == "secret" and WHOLE.fullmatch(text, a, b)) or (kind == "card" and 13 <= b - a <= 19 and pii.luhn(text[a:b])), (kind, text[a:b])
        for m in TOKEN.finditer(text or ""):
            tokens += 1
            assert any(k == "secret" and a <= m.start() and m.end() <= b for k, a, b in spans)
    assert added >= tokens > 0
