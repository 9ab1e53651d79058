"""Heap Lloyd against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from fieldmark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string, code string, error long, item long, vector string, block long, label_error string"


def whole(v):
    top = 1 << 62
    return [max(-top, min(top, math.floor(4096 * Fraction(x)))) for x in v]


def lloyd(rows, parts=8, size=16, rounds=6):
    """Rows (vec_id, vector, label) by the contract."""
    kept = [(i, whole(v), label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    least = [r for r in kept if r[0] == kept[0][0]]
    n = min(len(r[1]) for r in least)
    if n % parts:
        return []
    kept = sorted((r for r in kept if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = n // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:size]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for x in cut:
                groups.setdefault(nearest(x[p], book)[1], []).append(x[p])
            for e, own in groups.items():
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    most = (1 << 63) - 1
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + min(e, most)
    return sorted([(i, "".join(f"{e:02x}" for _, e in f), min(err, most), min(total[label], most), sha) for (i, _, label), f, err in zip(kept, found, errors, strict=True)], key=repr)


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, label, "c", 1, 2, "v", 3, "l") for i, v, label in rows], SCHEMA)
    found, books, measured = vector_codes.compress(df, "vec_id", "embedding", "label", **options)
    out = vector_codes.with_label_error(found, "label")
    return sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256() if books else "") for r in out.collect()], key=repr), measured


def made(seed, n, length, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, length))
    return [(int(i), [float(np.float32(x)) for x in centres[rng.integers(20)] + spread * rng.normal(size=length)], rng.choice(["a", "b", None])) for i in rng.permutation(n)]


@pytest.mark.parametrize("block", [7, 50, 16_384])
def test_equals_plain_rounds(spark, block):
    rows = made(block, 400, 24, 0.3)
    found, measured = coded(spark, rows, block=block)
    assert found == lloyd(rows)
    assert measured[0] == 8 * len(rows) and all(m < measured[0] for m in measured[1:])


def test_heaps_spare_parts(spark):
    rows = made(2, 3000, 16, 0.02)
    found, measured = coded(spark, rows)
    assert found == lloyd(rows)
    assert measured[-1] < measured[0] / 4


def test_ties_and_whole_numbers(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 0, 1]) / 4096 for _ in range(8)], "x") for k in range(300)] + [(300 + k, [0.0] * 8, None) for k in range(200)]
    assert coded(spark, rows)[0] == lloyd(rows)
    large = [(k, [rng.choice([-3e38, 3e38, 1e15, -7.5, 1e9]) for _ in range(16)], "x") for k in range(60)]
    large = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in large]
    assert coded(spark, large)[0] == lloyd(large)
    wide = [(k, [float(rng.randrange(-40000, 40000)) for _ in range(16)], "x") for k in range(60)]
    assert coded(spark, wide)[0] == lloyd(wide)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(k, [k / 8 + j for j in range(8)], "a" if k % 2 else None) for k in range(5)]
    odd = [(-1, None, "a"), (-2, [], "a"), (-3, [None] * 8, "a"), (-4, [nan] * 8, "a"), (-5, [1.0] * 7 + [-inf], "a"), (9, [1.0] * 16, "a"), (10, [1.0] * 7, "a")]
    again = [(3, [0.5] * 8, "b"), (3, [0.5] * 8, "b"), (None, [2.0] * 8, "b"), (None, [2.5] * 8, None)]
    assert coded(spark, fine + odd + again)[0] == lloyd(fine + odd + again)
    assert coded(spark, [])[0] == coded(spark, odd[:5])[0] == []
    assert coded(spark, [(1, [1.0] * 7, "a"), (2, [1.0] * 8, "a")])[0] == []
    assert coded(spark, [(1, [1.0] * 8, "a")])[0] == lloyd([(1, [1.0] * 8, "a")])


def test_rounds_need_no_exchange(spark):
    df = spark.createDataFrame([(i, v, label, "c", 1, 2, "v", 3, "l") for i, v, label in made(6, 3000, 16)], SCHEMA)
    found, _, _ = vector_codes.compress(df, "vec_id", "embedding")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
