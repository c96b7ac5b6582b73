import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from . import helpers as H
from jobtide.llm import words as W


def found(texts):
    flat, bounds = W.text_bytes(pa.array(texts, pa.string()))
    own = W.words_of(flat, bounds)
    return [(int(r), bytes(W.LOWER[flat[s:e]]).decode()) for r, s, e in zip(own.rows, own.starts, own.ends, strict=True)], own


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aZ9é_ -\n’中", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    got, own = found(texts)
    assert got == [(i, w) for i, t in enumerate(texts) for w in H.words(t)]
    by_word = {}
    for (_, word), value in zip(got, own.hashes.tolist(), strict=True):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


def test_segments_do_not_change_words(monkeypatch):
    text = ["one two three " * 40, "x" * 500 + " end", "", "three two one"]
    whole, first = found(text)
    monkeypatch.setattr(W, "SEGMENT", 64)
    W._powers.clear()
    parts, second = found(text)
    W._powers.clear()
    assert whole == parts and np.array_equal(first.hashes, second.hashes)


def test_slices_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 10, 5000, 1, 1, 3000)], "n": [0, 1, 2, 3, 4, 5]})
    parts = list(W.batches(iter([batch, batch.slice(0, 0)]), limit=1000, rows=2))
    assert [x for part in parts for x in part.column("n").to_pylist()] == [0, 1, 2, 3, 4, 5]
    assert max(part.num_rows for part in parts) == 2
