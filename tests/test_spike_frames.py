"""Spikes per unit and frame without a session key, over several arrays of frames."""

import collections
import random

from engram.operators import joins as J
from engram.plans.catalog import ORACLE, QUERIES


def test_frames_meet_the_spikes_of_all_units(spark, monkeypatch):
    monkeypatch.setattr(J, "FRAMES", 4)
    draw = random.Random(2)
    spikes = [(draw.randrange(4), draw.randrange(200)) for _ in range(120)] + [(1, None)] + [(None, 5 * i) for i in range(30)]
    frames = sorted({(draw.randrange(220), float(draw.randrange(3))) for _ in range(70)})
    got = J.join_spike_position(spark.createDataFrame(spikes, "u int, t bigint"), spark.createDataFrame([*frames, (None, 1.0)], "ft bigint, x double"), [], "u", "t", "ft", 60)
    want = collections.Counter((u, ft, x) for u, t in spikes for ft, x in frames if t is not None and ft - 60 < t <= ft)
    assert {(r["u"], r["ft"], r["x"]): r["spikes"] for r in got.collect()} == dict(want) and got.count() == len(want)


def test_the_query_has_no_session_cut(spark):
    assert QUERIES["join_spike_position"](spark, "/root/testdata/sf0.001").columns == ["unit_id", "frame_t", "x", "spikes"]
    assert "session" not in ORACLE["join_spike_position"]
