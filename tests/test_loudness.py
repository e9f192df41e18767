import math
from collections import Counter

import __spark_entry__
import pytest
from tonearm.operators import loudness
from tonearm.plans import streams as plans


def _plain(samples, w):
    bins = Counter()
    for k in range(0, len(samples) - w + 1, w):
        p = sum(float(x * x) for x in samples[k : k + w])
        bins[min(11999, max(0, int(1000 * math.log10((p + p) / w * 0.5 + 1e-37))))] += 1
    upper = math.ceil(sum(bins.values()) * (1.0 - 0.95))
    for b in sorted(bins, reverse=True):
        upper -= bins[b]
        if upper <= 0:
            return 64.82 - b / 100
    return None


def test_gain_of_the_entry(spark):
    assert "gain_percentile" in __spark_entry__.queries()
    d = "/root/testdata/sf0.001"
    streams = {}
    for r in sorted(plans.samples(spark, d).collect()):
        streams.setdefault(r.user_id, []).append(r.sample)
    got = {r.user_id: r.gain_db for r in __spark_entry__.entry(spark).collect()}
    assert got == pytest.approx({u: _plain(x, plans.WINDOW_FRAMES) for u, x in streams.items()})


def test_twenty_windows_and_none(spark):
    rows = [("a", k, 10 * (1 + k)) for k in range(20)] + [("b", 0, 5)]
    df = spark.createDataFrame(rows, "s string, frame_idx int, sample bigint")
    got = {r.s: r.gain_db for r in loudness.gain_percentile(df.filter("s = 'a'"), "s", 1).collect()}
    assert got["a"] == pytest.approx(_plain([r[2] for r in rows[:20]], 1))
    assert loudness.gain_percentile(df.filter("s = 'b'"), "s", 2).collect()[0].gain_db is None
