import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vedette.operators import points as P
from vedette.operators.fold import Fold, fit_groups, numbered

#: name, points, radius, factor, (centroid, population, radius) expected
GOLDEN = [
    ("mixed", [0, 0.5, 3, 3.5, 0.2], 1, 0.1, [(0.7 / 3, 3, 1.22), (3.25, 2, 0.95)]),
    ("boundary is a hit", [0, 1], 1, 0.1, [(0.5, 2, 0.9)]),
    ("clamp at zero", [0, 0.5, 0.25], 1, 3, [(0.25, 3, 0)]),
    ("all miss", [0, 1, 3], 0.1, 0.1, [(0, 1, 0.2), (1, 1, 0.3), (3, 1, 0.1)]),
    ("tie to the lowest", [0, 2, 1], 0.5, 0.1, [(0, 1, 0.8), (2, 1, 0.5), (1, 1, 0.5)]),
    ("single", [7], 1, 0.1, [(7, 1, 1)]),
]


@pytest.mark.parametrize("name,x,radius,factor,expected", GOLDEN)
def test_golden(name, x, radius, factor, expected):
    o, p, r = Fold(radius, factor).feed(np.array(x, float)[:, None]).rows()
    assert len(p) == len(expected)
    for got, want in zip(zip(o[:, 0], p, r, strict=True), expected, strict=True):
        assert got == pytest.approx(want)


def test_two_dimensions():
    o, p, r = Fold(2, 0.1).feed(np.array([[0, 0], [3, 4], [0, 1], [3, 3]], float)).rows()
    assert o.tolist() == [[0, 0.5], [3, 3.5]] and p.tolist() == [2, 2] and r == pytest.approx([2.4, 1.9])


def test_nan_radius_absorbs_only_duplicates():
    o, p, r = Fold(math.nan).feed(np.array([[1.0], [2.0], [1.0]])).rows()
    assert len(p) == 2 and p.tolist() == [2, 1] and r[0] == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=40), st.floats(0.01, 50), st.floats(0, 1))
def test_invariants(x, radius, factor):
    o, p, r = Fold(radius, factor).feed(np.array(x)[:, None]).rows()
    assert p.sum() == len(x) and (r >= 0).all() and len(p) <= len(x)


def test_no_factor_and_endless_radius_give_the_mean():
    x = np.random.default_rng(0).normal(size=(50, 3))
    o, p, _ = Fold(math.inf, 0.0).feed(x).rows()
    assert len(p) == 1 and o[0] == pytest.approx(x.mean(axis=0))


def test_chunks_are_independent_fits(spark):
    x = np.random.default_rng(1).normal(size=(40, 2))
    df = P.in_order(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"))
    got = numbered(fit_groups(P.with_batches(df, 40, 13), "batch", 1.0)).orderBy("oid").collect()
    want = [row for part in np.array_split(x, 3) for row in zip(*Fold(1.0).feed(part).rows(), strict=True)]
    assert [g.oid for g in got] == list(range(len(want)))
    for g, (o, p, r) in zip(got, want, strict=True):
        assert g.o == pytest.approx(o.tolist()) and g.population == p and g.radius == pytest.approx(r)


@pytest.mark.parametrize("n,chunk,sizes", [(10, 4, [5, 5]), (11, 3, [4, 4, 3]), (3, 10, [3]), (5, None, [5])])
def test_batch_sizes(spark, n, chunk, sizes):
    df = P.with_batches(spark.range(n).withColumnRenamed("id", "seq"), n, chunk)
    assert [r["count"] for r in df.groupBy("batch").count().orderBy("batch").collect()] == sizes


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_partitions_do_not_matter(spark, parts):
    x = np.random.default_rng(2).normal(size=(60, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(parts)
    got = fit_groups(P.with_batches(P.in_order(df), 60, None), "batch", 1.0).orderBy("oid").collect()
    o, p, _ = Fold(1.0).feed(x).rows()
    assert [g.population for g in got] == p.tolist() and got[0].o == pytest.approx(o[0].tolist())
