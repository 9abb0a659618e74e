"""The low-pass works in proportion to a stretch, not to the memory of its slowest filter."""

import numpy as np
import pytest

from kerbline.operators import motion


def _recursion(x, hz, cutoff):
    """The filter one sample a step, after a long past of the first value."""
    warped = 2 * hz * np.tan(np.pi * cutoff / hz)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, 5) + 3) / 8)
    z = (2 * hz + poles) / (2 * hz - poles)
    a = np.real(np.poly(z))
    b = np.poly(-np.ones(4)) * np.real(np.prod(1 - z)) / 16
    past = len(motion._impulse(hz, cutoff)) * 2
    lead = np.concatenate([np.full(past, x[0]), x])
    y = np.full(len(lead), x[0])
    for k in range(4, len(lead)):
        y[k] = (b * lead[k - 4:k + 1][::-1]).sum() - (a[1:] * y[k - 4:k][::-1]).sum()
    return y[past:]


@pytest.mark.parametrize("cutoff", [0.4, 1.0])
@pytest.mark.parametrize("size", [12, 400, 3000])
def test_one_way_equals_recursion(cutoff, size):
    x = np.random.default_rng(size).normal(size=(3, size)).cumsum(axis=1)
    got = motion._one_way(x, motion._impulse(50.0, cutoff))
    for row, want in zip(got, x):
        assert np.allclose(row, _recursion(want, 50.0, cutoff), atol=1e-6)


def test_short_stretches_are_not_padded_to_the_filters_memory(monkeypatch):
    sizes, rfft = [], np.fft.rfft

    def seen(x, n=None, *more, **named):
        sizes.append(n)
        return rfft(x, n, *more, **named)

    monkeypatch.setattr(np.fft, "rfft", seen)
    h = motion._impulse(50.0, 0.1)
    assert len(h) > 5000
    motion._zero_phase(np.arange(100.0), h, False, False)
    assert sizes and max(sizes) <= 512


def test_unset_values_and_short_stretches_give_null(spark):
    rows = [("A", 0, float(n) / 50, 1.0 + n % 3, n) for n in range(40)] + [("B", 0, float(n) / 50, None if n == 5 else 2.0, n) for n in range(40)] + [("C", 0, float(n) / 50, 2.0, n) for n in range(4)]
    size = {"A": 40, "B": 40, "C": 4}
    samples = spark.createDataFrame([(t, s, at, v, n, 0, size[t] - 1, size[t], 0.0, (size[t] - 1) / 50, 50.0) for t, s, at, v, n in rows],
                                    "trip_id string, seg_no long, t double, ax double, n long, seg_n0 long, seg_n1 long, seg_size long, seg_first double, seg_last double, hz double")
    out = motion.lowpass(samples, {"ax_lp": ("ax", 1.0), "ax_g": ("ax", 0.1)}).collect()
    assert len(out) == len(rows)
    assert all((r.ax_lp is not None and r.ax_g is not None) == (r.trip_id == "A") for r in out)
    assert {(r.trip_id, r.n): r.ax for r in out} == {(t, n): v for t, _, _, v, n in rows}
