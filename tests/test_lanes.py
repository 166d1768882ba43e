"""Sessions share calls, not state."""

import pandas as pd

from utterscope.streaming.capture import CaptureGate
from utterscope.streaming.state import ENDED, by_session


class Map(dict):
    getValue, containsKey, updateValue = dict.get, dict.__contains__, dict.__setitem__

    def removeKey(self, key):
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.maps = {}

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())


def test_rows_come_by_session_in_order_without_repeats():
    rows = pd.DataFrame({"session": ["b", None, "a", "b", "b", "a"], "place": [2, 7, 5, 1, 2, 4], "x": [1, 2, 3, 4, 5, 6]})
    assert [(s, c["place"].tolist(), c["x"].tolist()) for s, c in by_session(rows, "place")] == [("b", [1, 2], [4, 1]), (None, [7], [2]), ("a", [4, 5], [6, 3])]


def test_a_call_takes_many_sessions_and_leaves_others_alone():
    gate, handle = CaptureGate(), Handle()
    gate.init(handle)

    def call(rows):
        frame = pd.DataFrame(rows, columns=["session", "place", "command", "samples"]).astype(object)
        frame = frame.astype({"place": "int64"}).assign(**{ENDED: False}, lane=3)
        return [tuple(r) for r in next(gate.handleInputRows((3,), iter([frame]), None))[["session", "finished_at", "began_at", "n_samples"]].itertuples(index=False)]

    names = [f"s{i}" for i in range(50)]
    assert call([(n, p, c, s) for n in names for p, c, s in ((0, "begin", None), (1, None, [1, 2]))]) == []
    call([(names[0], 2, None, [3])])
    assert handle.maps["heads"][("s1",)] == (1, 0, 1) and handle.maps["heads"][("s0",)] == (2, 0, 2)
    assert call([(n, 3, "finish", None) for n in names]) == [(n, 3, 0, 3 if n == "s0" else 2) for n in names]
    assert handle.maps["parts"] == {} and len(handle.maps["heads"]) == 50
