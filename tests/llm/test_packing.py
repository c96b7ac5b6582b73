import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from . import helpers as H
from jobtide.llm import packing


def linear_best_fit(lengths, capacity):
    rooms, out = [], []
    for size in lengths:
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - size)
        else:
            rooms.append(capacity - size)
        out.append(len(rooms))
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(40, 70))
def test_the_tree_finds_what_a_linear_search_finds(lengths, capacity):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset = packing.best_fit(lengths, capacity)
    used = {}
    for size, s, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        assert used.get(s, 0) == at
        used[s] = at + size
    assert sorted(capacity - u for u in used.values()) == linear_best_fit(lengths.tolist(), capacity)


def test_round_trip_of_ids(spark):
    texts = ["", None, "one two", "é ß 中文 😀 <|endoftext|> x", "word and more " * 1500, "a" * 5000, "twin", "twin", " ".join(["x1"] * 1023)]
    docs = H.documents(spark, texts, ids=[*range(7), 6, None], schema=H.DOC + ", piece string, _row int", extra=("p", 3))
    rows = packing.pack(docs, ["doc_id", "piece", "_row"], group_pieces=4).collect()
    assert {r["_row"] for r in rows} == {3}
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in {i: t for i, t in zip([*range(7), None], [*texts[:7], texts[8]], strict=True)}.items():
        ids = np.array(full.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        if doc_id == 6:
            own = own[: len(own) // 2]  # two equal rows
        assert sum(r.length for r in own) == len(ids) and own[0].length in (len(ids) % 1024, 1024)
        assert all(r.length == 1024 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_few_sequences_and_empty_table(spark):
    docs = spark.read.parquet(f"{H.SF}/documents.parquet")
    rows = packing.pack(docs, ["doc_id"]).toPandas()
    assert rows.sequence_id.nunique() <= 1.01 * rows.length.sum() / 1024 + 1
    assert packing.pack(H.documents(spark, []), ["doc_id"]).collect() == []


def test_fast_ids_equal_the_vocabulary_files():
    tokeniser = packing.Tokeniser.get("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=40) | st.text(alphabet=[chr(c) for c in range(0x250)] + list("  \n'sllve"), max_size=40))
    def same(text):
        assert tokeniser.ids(text).tolist() == tokeniser.full.encode(text, add_special_tokens=False).ids

    same()
