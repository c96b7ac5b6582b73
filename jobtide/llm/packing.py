"""Documents as token pieces, packed into as few fixed-size sequences as best-fit decreasing finds.

Every document is tokenised whole and ends with one closing id.  Only a document of more ids than a
sequence holds is cut, into full pieces after a first one that takes the remainder.  Full pieces are
sequences of their own.  The others are dealt at random into groups of a few thousand, and each group is
packed by best-fit decreasing: a segment tree over the remaining capacities finds the fullest open sequence
that still has room, in logarithmic time.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import batches
from .workspace import Workspace

CAPACITY = 1024
CLOSING_ID = 2


class Tokeniser:
    """Ids of a byte-level BPE vocabulary; built once per Python worker.

    Texts of Latin characters without special tokens go through the ranks of the same vocabulary, which give
    the same ids several times faster; all others through the vocabulary file itself.
    """

    _made: dict[tuple[str, str], Tokeniser] = {}
    _OTHER = re.compile("[^\x00-ɏ]|<\\|")

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary))

    @classmethod
    def get(cls, vocabulary: str, ranks: str) -> Tokeniser:
        if (vocabulary, ranks) not in cls._made:
            cls._made[vocabulary, ranks] = cls(vocabulary, ranks)
        return cls._made[vocabulary, ranks]

    def ids(self, text: str) -> np.ndarray:
        if self._OTHER.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


class FitTree:
    """A segment tree over remaining capacities: which capacities have an open sequence."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64).tolist()
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.bins[room].append(sequence)
        node = room + self.leaves
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (sequence, room) with the least room of at least ``size``."""
        node = size + self.leaves
        if not self.open[node]:
            # Up until a right sibling has an open sequence, then down to its leftmost one.
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.open[node]:
                    node += 1
        room = node - self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return self.bins[room].pop(), room


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; ``lengths`` fall."""
    tree, sequences, offsets, opened = FitTree(capacity), [], [], 0
    for size in lengths.tolist():
        found = tree.take(size)
        if found is None:
            found, opened = (opened, capacity), opened + 1
        sequence, room = found
        sequences.append(sequence)
        offsets.append(capacity - room)
        if room > size:
            tree.add(room - size, sequence)
    return np.array(sequences, np.int64), np.array(offsets, np.int64)


def pieces(
    docs: DataFrame, keep: list[str], vocabulary: str, ranks: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID
) -> DataFrame:
    """A row for each piece: the kept columns, piece, start, length, ids_crc32."""
    new = ["piece", "start", "length", "ids_crc32"]
    kept = [c for c in keep if c not in new]
    schema = pa.schema([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser = Tokeniser.get(vocabulary, ranks)
        for batch in batches(frames):
            owner, rows = [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(tokeniser.ids(text.as_py() or ""), np.array([closing_id], "<u4")).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
                for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(row)
                    rows.append((piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(owner)) for c in kept] + columns, names=kept + new)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    kinds += ["piece int", "start long", "length long", "ids_crc32 long"]
    return docs.select(*dict.fromkeys([f"`{c}`" for c in [*kept, "text"]])).mapInArrow(run, ", ".join(kinds))


def pack(
    docs: DataFrame,
    keep: list[str],
    *,
    vocabulary: str = "byte_bpe_50k.json",
    ranks: str = "byte_bpe_50k.tiktoken",
    capacity: int = CAPACITY,
    closing_id: int = CLOSING_ID,
    group_pieces: int = 4096,
) -> DataFrame:
    """A row for each piece: the kept columns, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` ids; the pieces of one stand without gaps from offset 0.  A null text
    is an empty one, and an empty text is its closing id alone.  Repeated rows are packed each for itself.  An
    empty table gives no rows.  Columns of the new names are replaced.  Groups hold about ``group_pieces``
    pieces whatever the size of the corpus; a group wastes at most its few last sequences.
    """
    work = Workspace(docs.sparkSession, "pack")
    new = ["piece", "start", "length", "ids_crc32"]
    kept = {f"in_{i}": c for i, c in enumerate(c for c in keep if c not in (*new, "sequence_id", "offset"))}
    named = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in kept.items()], "text")
    numbered = pieces(named, list(kept), vocabulary, ranks, capacity, closing_id)
    cut = work.settle(numbered.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))

    def pack_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_row", "ascending")])
        sequence, offset = best_fit(table.column("length").to_numpy(), capacity)
        number = (table.column("_group").to_numpy().astype(np.int64) << 24) + sequence
        placed = table.select(["_row"])
        return placed.append_column("_packed", pa.array(number * 2 + 1)).append_column("_offset", pa.array(offset))

    placed = (
        short.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))
        .groupBy("_group")
        .applyInArrow(pack_group, "_row long, _packed long, _offset long")
    )
    joined = cut.join(placed, "_row", "left").select(
        *[F.col(name).alias(c) for name, c in kept.items()],
        *new,
        F.coalesce("_packed", F.col("_row") * 2).alias("sequence_id"),
        F.coalesce("_offset", F.lit(0).cast("long")).alias("offset"),
    )
    return work.finish(joined)
