"""Calls to the state of a stream."""

from types import SimpleNamespace

import pandas as pd

from pacelake.streaming import contacts as stream


class _Value:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_frames_of_a_leg_wait_as_one_value():
    """A batch of frames that the watermark has not reached takes a few calls to the state, whatever their number."""
    calls, timers = [], []
    handle = SimpleNamespace(getValueState=lambda name, schema: _Value(calls), registerTimer=timers.append, deleteTimer=timers.remove)
    p = stream.ContactProcessor(2.0, 60.0, 2.0, 60_000)
    p.init(handle)
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    pdf = pd.DataFrame({"frame": range(500), "at_ms": [1000 + 16 * t for t in range(500)], "comp": [None if t % 9 == 0 else float(t % 40) * 5 for t in range(500)], "vis": [0.9] * 500})
    assert list(p.handleInputRows((1, "L"), iter([pdf]), now)) == []
    assert len(calls) <= 6 and timers == [1000 + 16 * 499 + 60_000]
    found = list(p.handleExpiredTimer((1, "L"), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6), SimpleNamespace(getExpiryTimeInMs=lambda: timers[0])))
    detector = stream.Detector(stream.Leg(), 2.0, 60.0, 2.0)
    for c, v in zip(pdf["comp"], pdf["vis"]):
        detector.push(None if pd.isna(c) else c, v)
    detector.finish()
    assert [tuple(r) for r in found[0][["frame", "confidence", "toe_off", "gct_ms"]].itertuples(index=False)] == detector.out
    assert all(v.value is None for v in (p.leg, p.waiting, p.ends))
