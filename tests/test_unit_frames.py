"""Complete units leave a call as one frame, and rows of a session that ends in the call never enter the state."""

import numpy as np
import pandas as pd

from handtrace.streaming import online


class Value:
    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Rows:
    def __getattr__(self, name):
        raise AssertionError(f"{name} on the open rows of a session that came whole")


def test_one_frame_a_call():
    n = 64
    whole = pd.DataFrame({
        "session_id": "s", "seq": [*range(n), -1, 2 ** 62], "type": ["mouse_move"] * n + ["__session__", "__end__"],
        "t": [*np.arange(n) * 100.0, np.nan, np.nan], **{c: 1.0 for c in ("x", "y", "dx", "dy")}, "pressed": None, "key": None,
        "sensitivity": 1.0, "dpi": 1600.0, "polling_rate": np.nan})
    units = online.SessionUnits(1000.0, 16, None)
    units.session, units.open_rows = Value(), Rows()
    frames = list(units.handleInputRows(("s",), iter([whole]), None))
    assert len(frames) == 1
    assert frames[0]["kind"].value_counts().to_dict() == {"window": 64, "chunk": 64, "trigger": 11, "end": 1}
    assert set(frames[0]["norm_factor"]) == {2.0} and units.session.value[2] == n
