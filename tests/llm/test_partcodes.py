import collections
import math

import numpy as np
import pytest

from . import helpers as H
from jobtide.llm import anchors, partcodes, queries

KIND = "vec_id long, embedding array<float>, label int, code string, _key int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = []
    for vec_id, x, label in rows:
        if x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda s, book: min((sum((a - b) ** 2 for a, b in zip(s, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(x) for x in zip(*own[i], strict=True)] if i in own else c for i, c in enumerate(books[p])]
    out, by_label = [], collections.Counter()
    for vec_id, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((vec_id, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted(((a, b, c, by_label[d]) for a, b, c, d in out), key=str), np.array(books)


def compressed(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    coded, books = partcodes.compress(df, **options)
    return sorted((tuple(r) for r in coded.select("vec_id", "code", "error", "label_error").collect()), key=str), books


@pytest.mark.parametrize("scale", [0.02, 1.0, 300.0])
def test_equals_brute_force(spark, scale):
    random = np.random.default_rng(4)
    centres = random.normal(size=(12, 32)) * scale
    rows = [(i, (centres[i % 12] + random.normal(size=32) * scale / 5).astype(np.float32).tolist(), i % 3 if i % 7 else None) for i in range(600)]
    rows += [(1000 + i, rows[3][1], 9) for i in range(1500)]  # a hot vector under a hot label
    rows += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 30, 1), (2002, [math.nan] * 32, 1), (2003, [-math.inf] * 32, 1)]
    rows += [(None, rows[5][1], 1), (None, [0.0] * 32, None), rows[0], rows[0]]
    got, books = compressed(spark, rows, block=256)
    want, expected = brute(rows)
    assert got == want and np.array_equal(books, expected)


def test_few_rows_and_equal_entries(spark):
    rows = [(i, [float(i // 2)] * 16, 1) for i in range(10)]
    got, books = compressed(spark, rows)
    want, expected = brute(rows)
    assert got == want and np.array_equal(books, expected)
    assert compressed(spark, []) == ([], None) and compressed(spark, [(1, None, 1)]) == ([], None)


@pytest.mark.parametrize("rows", [[(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 17, 1)], [(1, [1e9] * 16, 1)]])
def test_shapes_that_cannot_be_coded_are_refused(spark, rows):
    with pytest.raises(ValueError, match="vectors of|a component"):
        compressed(spark, rows)


def test_trees_cover_their_points_and_own_whole_balls():
    random = np.random.default_rng(6)
    for size, spread in ((1, 9), (30, 0), (700, 3), (2048, 40)):
        centres = random.integers(-5000, 5000, (9, 4))
        points = centres[random.integers(0, 9, size)] + random.integers(-spread, spread + 1, (size, 4))
        tree = anchors.build(points)
        assert sorted(tree.order.tolist()) == list(range(size))
        for ball in range(len(tree.lo)):
            own = points[tree.order[tree.lo[ball] : tree.hi[ball]]]
            assert (tree.sums[ball] == own.sum(0)).all()
            assert np.sqrt(((own - tree.centre[ball]) ** 2).sum(1)).max() <= tree.radius[ball] + 1e-6
            if tree.left[ball] >= 0:
                l, r = tree.left[ball], tree.right[ball]
                assert (tree.lo[l], tree.hi[l], tree.hi[r]) == (tree.lo[ball], tree.lo[r], tree.hi[ball])
        book = np.concatenate([centres, centres[:2], points[:3]])
        found = anchors.assign(tree, points, book)
        exact = ((points[:, None] - book[None]) ** 2).sum(2)
        assert (found.entries == exact.argmin(1)).all() and found.counts.sum() == size
        assert all((found.sums[e] == points[found.entries == e].sum(0)).all() for e in range(len(book)))
        assert size < 100 or found.owned > 0


@pytest.mark.parametrize("sf", [H.SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    got, want = H.against_sql(spark, queries.op12_part_codes(spark, sf), partcodes.codes_sql(), embeddings=spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert got == want and got
