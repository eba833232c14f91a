"""Kernels on blocks with halos against sums over offsets on the whole array."""

import itertools

import numpy as np
import pytest

from voxelia.operators import blocks

RULE = {"wrap": "wrap", "reflect": "reflect", "replicate": "edge", "zero": "constant"}


def plain(a, k, border):
    reach = [n // 2 for n in k.shape]
    wide = np.pad(a, [(r, r) for r in reach], mode=RULE[border])
    out = np.zeros(a.shape, complex)
    for d in itertools.product(*map(range, k.shape)):
        out += k[d] * wide[tuple(slice(i, i + n) for i, n in zip(d, a.shape, strict=True))]
    return np.abs(out) if np.iscomplexobj(k) and k.imag.any() else out.real


def frame(spark, arrays):
    rows = [(g, *map(int, at), float(a[at]), "x") for g, a in arrays.items() for at in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"g string, {', '.join(f'{c} long' for c in 'zyx'[-next(iter(arrays.values())).ndim:])}, v double, p string")


@pytest.mark.parametrize("border", blocks.BORDERS)
def test_images(spark, border):
    r = np.random.default_rng(2)
    arrays = {"a": r.random((13, 9)), "b": r.random((13, 9))}
    kernels = {"wide": r.random((7, 5)) - 0.5, "one": np.ones((1, 1)), "wave": blocks.gabor(0.3, 0.7, 1.0)}
    got = blocks.correlated(frame(spark, arrays), kernels, {"y": 13, "x": 9}, border, ("g",), block=4).collect()
    assert len(got) == 2 * 13 * 9
    for g, a in arrays.items():
        for name, k in kernels.items():
            wanted = plain(a, k, border)
            assert all(abs(x[name] - wanted[x.y, x.x]) < 1e-9 for x in got if x.g == g), (name, border)


def test_volume_and_ball(spark):
    a = np.random.default_rng(3).random((6, 7, 8))
    sizes = {"z": 6, "y": 7, "x": 8}
    kernel = blocks.ball(sizes, 10)
    assert kernel.sum() == 6 * 7 * 8  # the ball holds the whole volume once
    got = blocks.less_ball_mean(frame(spark, {"a": a}), 2.5, sizes, ("g",), block=3).collect()
    small = blocks.ball(sizes, 2.5)
    wanted = a - np.abs(plain(a, small / small.sum(), "wrap"))
    assert len(got) == a.size and all(abs(x.v - wanted[x.z, x.y, x.x]) < 1e-9 for x in got)
    flat = blocks.less_ball_mean(frame(spark, {"a": np.full((6, 7, 8), 3.0)}), 2, sizes, ("g",))
    assert {x.v for x in flat.collect()} == {0.0}


def test_kernels():
    k = blocks.gabor(0.9, 0.0, 1.0)
    assert k.shape == (7, 7) and abs(k[3, 3] - 1 / (2 * np.pi)) < 1e-12
    ring = blocks.ring_cosine(2.0, 3.0)
    assert ring.shape == (7, 7) and abs(ring.sum() - 1) < 1e-12 and np.allclose(ring, ring.T)
    assert len(blocks.bank()) == 35


def test_edges(spark):
    with pytest.raises(ValueError, match="odd"):
        blocks.correlated(frame(spark, {"a": np.ones((3, 3))}), {"k": np.ones((2, 3))}, {"y": 3, "x": 3}, "zero", ("g",))
    with pytest.raises(ValueError, match="border"):
        blocks.correlated(frame(spark, {"a": np.ones((3, 3))}), {"k": np.ones((3, 3))}, {"y": 3, "x": 3}, "other", ("g",))
    gaps = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, None), ("a", 2, 2, float("nan"))], "g string, y long, x long, v double")
    got = {(r.y, r.x): r.k for r in blocks.correlated(gaps, {"k": np.ones((3, 3))}, {"y": 3, "x": 3}, "zero", ("g",)).collect()}
    assert len(got) == 9 and abs(got[1, 1] - 1.0) < 1e-12 and abs(got[2, 2]) < 1e-12
    assert blocks.correlated(gaps.limit(0), {"k": np.ones((3, 3))}, {"y": 3, "x": 3}, "zero", ("g",)).count() == 0
