"""How often the keyed processors call the state, which is a round trip each, and when their timers end it."""

from types import SimpleNamespace

from pyspark.sql import Row

from agrarium.streaming import keyed


class State:
    """A map state and a list state that count their calls."""

    def __init__(self):
        self.held, self.rows, self.timers, self.calls = {}, [], [], 0

    def _called(self, out=None):
        self.calls += 1
        return out

    def getValue(self, k): return self._called(self.held.get(k))
    def containsKey(self, k): return self._called(k in self.held)
    def updateValue(self, k, v): self._called(self.held.__setitem__(k, v))
    def removeKey(self, k): self._called(self.held.pop(k, None))
    def keys(self): return self._called(iter(list(self.held)))
    def iterator(self): return self._called(iter(list(self.held.items())))
    def get(self): return self._called(iter(self.rows))
    def put(self, rows): self._called(self.__dict__.update(rows=rows))
    def clear(self): self._called(self.rows.clear())
    def registerTimer(self, at): self._called(self.timers.append(at))
    def getMapState(self, *_): return self
    getListState = getMapState


def begun(processor):
    state = State()
    processor.init(state)
    return state


def at(watermark):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark, getExpiryTimeInMs=lambda: watermark)


def test_cache_reads_and_writes_an_entry_once_a_batch():
    cache = keyed._Cache("space")
    state = begun(cache)
    rows = [Row(t=float(i), id=i, op=("set", "get", "delete", "set")[i % 4], key=f"u{i % 3}", value=str(i), ttl=5.0 + i % 3) for i in range(600)]
    out = list(cache.handleInputRows(("s",), iter(rows[::-1]), at(0)))
    want, held = {}, {}
    for r in rows:
        if r.op == "set":
            held[r.key] = (r.value, r.t + r.ttl)
        elif r.op == "delete":
            held.pop(r.key, None)
        else:
            want[r.id] = held[r.key][0] if r.key in held and r.t <= held[r.key][1] else None
    assert {r.id: r.value for r in out} == want and {k[0]: v for k, v in state.held.items()} == held
    assert state.calls <= 8 and state.timers == [int(min(e for _, e in held.values()) * 1000) + 1]
    while state.timers:
        first = state.timers.pop()
        list(cache.handleExpiredTimer(("s",), at(first), at(first)))
        assert all(e >= first / 1000 for _, e in state.held.values())
    assert not state.held


def test_prefix_reaches_entries_of_this_batch_and_before():
    cache = keyed._Cache("space")
    state = begun(cache)
    row = lambda t, op, key: Row(t=float(t), id=t, op=op, key=key, value="v", ttl=None)
    list(cache.handleInputRows(("s",), iter([row(0, "set", "a0"), row(1, "set", "b0")]), at(0)))
    out = list(cache.handleInputRows(("s",), iter([row(2, "set", "a1"), row(3, "prefix", "a"), row(4, "get", "a0"), row(5, "get", "a1"), row(6, "get", "b0"), row(7, "set", "a1")]), at(0)))
    assert [r.value for r in out] == [None, None, "v"] and set(state.held) == {("b0",), ("a1",)} and not state.timers


def test_windows_are_read_and_written_once_a_batch():
    fixed = keyed._Fixed(2, 10.0, "k")
    state = begun(fixed)
    rows = [Row(t=float(i), id=i) for i in range(300)]
    out = list(fixed.handleInputRows(("u",), iter(rows), at(0)))
    assert [r.id for r in out if r.allowed] == [i for i in range(300) if i % 10 < 2] and state.calls <= 3 and state.timers == [300_000]
    # Rows that are older than this batch's watermark still meet their window's count; then it goes.
    late = list(fixed.handleInputRows(("u",), iter([Row(t=5.5, id=900)]), at(295_000)))
    assert [r.allowed for r in late] == [False] and state.rows == [(29, 10)] and state.timers == [300_000]
    list(fixed.handleExpiredTimer(("u",), at(300_000), at(300_000)))
    assert not state.rows


def test_sliding_keeps_its_timer():
    sliding = keyed._Sliding(1, 10.0, "k")
    state = begun(sliding)
    assert [r.allowed for r in sliding.handleInputRows(("u",), iter([Row(t=0.0, id=1), Row(t=3.0, id=2)]), at(0))] == [True, False] and state.calls == 3
    assert [r.allowed for r in sliding.handleInputRows(("u",), iter([Row(t=5.0, id=3)]), at(0))] == [False] and state.calls == 4 and state.timers == [10_001]
