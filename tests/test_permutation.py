"""Keyed permutations of places, and the test that uses them."""

import numpy as np
import pandas as pd

from barloom.operators.inference import permutation_test, shuffle_keys, shuffled_places


def test_one_to_one_on_any_size():
    for n in (1, 2, 3, 7, 100, 1001):
        seen = [shuffled_places(np.arange(n), np.full(n, n), keys) for keys in shuffle_keys(30)]
        assert all(sorted(s) == list(range(n)) for s in seen)
    assert len({tuple(s) for s in seen}) == 30
    big = shuffled_places(np.arange(10**6) * 5, np.full(10**6, 5 * 10**12), shuffle_keys(1)[0])
    assert len(np.unique(big)) == 10**6 and big.max() < 5 * 10**12


def test_places_are_even():
    """Every place is reached about equally often, and neighbours do not stay neighbours."""
    n = 50
    seen = np.array([shuffled_places(np.arange(n), np.full(n, n), keys) for keys in shuffle_keys(2000, 7)])
    counts = np.array([np.bincount(seen[:, i], minlength=n) for i in range(n)])
    assert 0.8 < ((counts - 40) ** 2 / 40).mean() < 1.2  # chi-squared per cell, 1 for a fair draw
    assert abs((np.abs(np.diff(seen, axis=1)) == 1).mean() - 2 / n) < 0.01


def test_null_distribution(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"fold": np.arange(3000) % 3, "symbol": np.arange(3000), "date": 1, "y": rng.normal(size=3000)})
    d["p"] = np.where(d.fold == 0, d.y + rng.normal(size=3000), np.where(d.fold == 1, rng.normal(size=3000), 1.0))
    got = {r.fold: r for r in permutation_test(spark.createDataFrame(d).repartition(4), "y", "p", 200).collect()}
    assert got[0].p_one_sided == 0 and got[0].observed_ic > 0.5
    assert 0.01 < got[1].p_two_sided <= 1 and got[2].observed_ic == 0
    for fold in (0, 1):  # the rank correlation of n random pairs has deviation 1 / sqrt(n - 1)
        assert abs(got[fold].null_mean) < 4 * 0.0316 / np.sqrt(200) and abs(got[fold].null_std / 0.0316 - 1) < 0.25
    again = {r.fold: r for r in permutation_test(spark.createDataFrame(d).repartition(9), "y", "p", 200).collect()}
    assert all(abs(again[f].null_mean - got[f].null_mean) < 1e-12 for f in got)
    assert permutation_test(spark.createDataFrame(d).filter("false"), "y", "p", 3).count() == 0


def test_tiles_hold_parts_of_a_key(spark, monkeypatch):
    """Pieces, shares and holders of a few rows give the sums of whole keys, and ranks are moved once per share, not per shuffle."""
    from barloom.operators import inference

    rng = np.random.default_rng(4)
    d = spark.createDataFrame(pd.DataFrame({"fold": [None if i % 3 == 0 else i % 3 for i in range(700)], "symbol": np.arange(700), "date": 1,
                                            "y": rng.normal(size=700), "p": rng.integers(0, 20, 700).astype(float)}), "fold double, symbol long, date long, y double, p double")
    whole = permutation_test(d, "y", "p", 40).toPandas().sort_values("fold").reset_index(drop=True)
    for name, value in (("PIECE", 8), ("HELD", 5), ("TAKEN", 3)):
        monkeypatch.setattr(inference, name, value)
    plan = permutation_test(d, "y", "p", 40)
    parts = plan.toPandas().sort_values("fold").reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, parts, rtol=1e-12)
    assert list(parts.fold) == [1, 2]


def test_places_of_one_size_in_fewer_bits():
    """One size for all places takes 32-bit numbers up to 2^31, and gives the places of the general form."""
    from barloom.operators import inference

    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 65537, 10**6, 2**30 + 7, 2**31 - 1, 2**31, 10**12):
        k = np.unique(rng.integers(0, n, 2000))
        for keys in shuffle_keys(5, n % 97):
            want = shuffled_places(k, np.full(len(k), n), keys)
            assert (shuffled_places(k, np.int64(n), keys) == want).all()
            assert n >= 2**31 or (inference._small_places(k, n, keys) == want).all()
