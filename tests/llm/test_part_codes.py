import hashlib
import math
import random

import numpy as np

from revlens.llm import part_codes as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Plain Python over all entries of every part."""
    ok = [(v is None, v or 0, [math.floor(4096 * float(x)) for x in e], l) for v, e, l in rows
          if e and all(x is not None and math.isfinite(x) and abs(x) < C.DOMAIN / C.SCALE for x in e)]
    ok.sort(key=lambda r: r[:3])
    if not ok:
        return {}, None
    width = len(ok[0][2])
    ok = [r for r in ok if len(r[2]) == width]
    cut = [k * width // parts for k in range(parts + 1)]
    books = [[r[2][a:b] for r in ok[:entries]] for a, b in zip(cut, cut[1:])]

    def nearest(k, x):
        return min((sum((p - q) ** 2 for p, q in zip(x[cut[k]:cut[k + 1]], y)), e) for e, y in enumerate(books[k]))
    for _ in range(rounds):
        for k in range(parts):
            held = [[] for _ in books[k]]
            for _, _, x, _ in ok:
                held[nearest(k, x)[1]].append(x[cut[k]:cut[k + 1]])
            books[k] = [[sum(c) // len(h) for c in zip(*h)] if h else y for h, y in zip(held, books[k])]
    digest = hashlib.sha256(",".join(str(v) for b in books for y in b for v in y).encode()).hexdigest()
    out, by = [], {}
    for null, v, x, label in ok:
        near = [nearest(k, x) for k in range(parts)]
        error = sum(d for d, _ in near)
        by[label] = by.get(label, 0) + error
        out.append((None if null else v, "".join(f"{e:02x}" for _, e in near), error, label))
    return sorted((v, c, e, by[label]) for v, c, e, label in out if v is not None), digest


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as code", "1 as error", "array(1) as vec", "2 as _label")
    got = C.report(table).collect()
    want, digest = plain(rows)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got if r.vec_id is not None) == (want or [])
    assert {r.codebooks_sha256 for r in got} == ({digest} if want else set())
    return got


def test_report_against_plain_python(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, .2) for _ in range(64)], r.choice([0, 1, None])) for i in r.sample(range(1000), 120)]
    rows += [(2000, None, 1), (2001, [None] + [0.1] * 63, 1), (2002, [float("nan")] * 64, 1), (2003, [float("inf")] + [0.0] * 63, 1),
             (2004, [0.5] * 32, 1), (2005, [], 2), (2006, [1e30] * 64, 2), (2007, [30000.0, -30000.0] * 32, 2), (-5, [-0.0001] * 64, 0)]
    assert len(check(spark, rows + rows[:3])) == 125  # repeated rows count each


def test_few_vectors_ties_and_odd_lengths(spark):
    check(spark, [(1, [0.5] * 20, 1), (2, [0.25] * 20, 1), (3, [0.5] * 20, None)])
    check(spark, [(k, [float(k % 3), 1.0, -1.0], 1) for k in range(40)])
    check(spark, [(7, [0.1 * k] * 8, k) for k in range(30)])  # one id


def test_empty_tables(spark):
    assert check(spark, [(1, None, 1)]) == []
    assert C.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_keep_every_nearest_entry():
    g = np.random.default_rng(3)
    for scale, dims in ((50, 3), (600, 8), (40_000, 8), (3_000_000, 2), (C.DOMAIN - 1, 9)):
        book = g.integers(-scale, scale, (16, dims))
        book[5] = book[2]  # equal entries: the lower index
        points = np.concatenate([g.integers(-scale, scale, (3000, dims)), book])
        far = ((points[:, None] - book[None]) ** 2).sum(2)
        for cell in (64, 256, 4096):
            grid = C.Cells(book, cell)
            for _ in range(2):  # computed, then cached
                entry, best = grid.assign(points)
                assert (entry == far.argmin(1)).all() and (best == far.min(1)).all()


def test_dominated_entries_are_left_out():
    book = np.array([[0, 0], [30_000, 30_000]])
    grid = C.Cells(book, 256)
    assert grid.masks_of(np.array([[10, 20], [29_000, 29_000], [15_000, 15_000]])).tolist()[:2] == [1, 2]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "CELLS", 10)
    grid = C.Cells(np.array([[0], [5000]]), 16)
    grid.assign(np.arange(0, 5000)[:, None])
    assert len(grid.masks) <= 10
    assert (grid.assign(np.arange(0, 5000)[:, None])[0] == (np.arange(0, 5000) > 2500)).all()


def test_decode_names_entries(spark):
    rows = [(i, [float(i % 5)] * 16, 0) for i in range(20)]
    ints = C.kept(spark.createDataFrame(rows, SCHEMA))
    books, width = C.trained(ints)
    back = {r.vec_id: r.vec for r in C.decode(C.encode(ints, books, width), books).collect()}
    assert back == {r.vec_id: list(r.vec) for r in ints.collect()}  # five distinct vectors: no error


def test_a_hot_label_is_summed_before_the_shuffle(spark):
    rows = [(i, [0.01 * (i % 7)] * 8, 1 if i % 3 else i) for i in range(300)]
    check(spark, rows)
