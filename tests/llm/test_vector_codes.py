"""Operator 12 against brute force in Python's integers, and its edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import vector_codes as vc
from tessera.llm.common import Scratch

VEC = "vec_id long, embedding array<double>, label int"


def brute(rows, entries=256, rounds=4):
    """(vec_id, label, code, error) and the codebooks, one part after the other."""
    kept = [(i, [math.floor(1024 * c) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    cut = lambda v: [v[p.start : p.stop] for p in vc.widths(len(v))]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x)[p] for _, x, _ in first] for p in range(4)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            members = {}
            for _, x, _ in kept:
                members.setdefault(near(cut(x)[p], books[p])[1], []).append(cut(x)[p])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])]
    out = []
    for i, x, label in kept:
        best = [near(part, book) for part, book in zip(cut(x), books, strict=True)]
        out.append((i, label, [b[1] for b in best], sum(b[0] for b in best)))
    return out, books


def plain(coded):
    return sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in coded.collect()), key=repr)


@pytest.mark.parametrize("d", [8, 10, 3])
def test_against_brute_force(spark, d):
    draw = random.Random(d)
    rows = [(i, [draw.choice([-1.0, 1.0]) * draw.random() ** 3 for _ in range(d)], i % 3) for i in range(500)]
    rows += [(i + 500, rows[i % 7][1], None) for i in range(40)]  # equal vectors
    rows += [(3, rows[9][1], 1), (None, rows[4][1], 1), (900, [0.0] * d, 0), (901, [-0.0] * d, 0)]
    bad = [(910, None, 0), (911, [float("nan")] * d, 0), (912, [0.5] * (d - 1) + [None], 0), (913, [float("inf")] + [0.1] * (d - 1), 1), (914, [], 1), (915, [0.1] * (d + 1), 1)]
    got, books = vc.compress(spark.createDataFrame(rows + bad, VEC).repartition(5), entries=40)
    want, wanted = brute(rows, entries=40)
    assert [b.tolist() for b in books] == wanted
    assert plain(got) == sorted(want, key=repr)


def test_only_the_annulus_is_evaluated():
    draw = np.random.default_rng(1)
    book = draw.integers(-500, 500, (256, 8)) * draw.integers(1, 40, 256)[:, None]
    x = book[draw.integers(0, 256, 4000)] + draw.integers(-50, 50, (4000, 8))
    search = vc.Annuli(book)
    at, best = search.nearest(x)
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (best == whole.min(1)).all()
    assert search.met < 0.4 * len(x) * len(book)


def test_ties_go_to_the_lower_index():
    book = np.array([[5, 0], [0, 5], [-5, 0], [0, 5], [3, 4], [0, 0]])
    x = np.array([[0, 5], [0, 0], [4, 4], [-5, 5], [1000, 0]])
    at, best = vc.Annuli(book).nearest(x)
    assert at.tolist() == [1, 5, 4, 1, 0] and best.tolist() == [0, 0, 1, 25, 995**2]


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**40 * (i % 5), 1.5, -(2.0**44), i / 7], i % 2) for i in range(60)] + [(70, [1e300, 0.0, 0.0, 0.0], 0)]
    got, books = vc.compress(spark.createDataFrame(rows, VEC), entries=3)
    want, wanted = brute(rows[:-1], entries=3)
    assert [b.tolist() for b in books] == wanted
    assert plain(got) == sorted(((i, l, c, e if e <= vc.LONG else None) for i, l, c, e in want), key=repr)
    assert any(e > vc.LONG for *_, e in want)
    summed = {r["label"]: r["label_error"] for r in vc.with_label_error(Scratch(spark, "t").put(got)).collect()}
    assert summed == {0: None, 1: None}


def test_label_errors_with_a_hot_label(spark, monkeypatch):
    coded = Scratch(spark, "t").put(spark.createDataFrame([(i, None if i % 3 else i % 5, [0], i) for i in range(300)], "vec_id long, label int, code array<int>, error long"))
    want = {}
    for i in range(300):
        want[None if i % 3 else i % 5] = want.get(None if i % 3 else i % 5, 0) + i
    check = lambda: {(r["vec_id"], r["label_error"]) for r in vc.with_label_error(coded).collect()} == {(i, want[None if i % 3 else i % 5]) for i in range(300)}
    assert check()
    monkeypatch.setattr(vc, "bounded", lambda df: False)
    assert check()


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], VEC)
    coded, books = vc.compress(none)
    assert coded.count() == 0 and books == [] and vc.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(i, [float(i), 0.5, -0.5, 2.0], 1) for i in range(5)]
    plain_rows = spark.createDataFrame(rows, VEC)
    more = plain_rows.selectExpr("*", "'x' AS x", "1 AS code", "2 AS error", "3 AS d", "4 AS slot")
    assert plain(vc.compress(more)[0]) == plain(vc.compress(plain_rows)[0])
