import threading
import time

import pytest

from lamella.operators.runtime import Gate, Lane, Options, Registry, retried, write_whole


def test_options(spark):
    assert Options.of(spark) == Options()
    spark.conf.set("lamella.dpi", "200")
    spark.conf.set("lamella.mask_share_cap", "0.5")
    try:
        assert Options.of(spark) == Options(dpi=200, mask_share_cap=0.5)
    finally:
        spark.conf.unset("lamella.dpi")
        spark.conf.unset("lamella.mask_share_cap")
    for bad in ({"dpi": 0}, {"mask_share_cap": 1.5}, {"max_calls": -1}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_registry():
    r = Registry()
    r.add("White", lambda size=1: ("white", size))
    assert r.make("WHITE", size=3) == ("white", 3)
    with pytest.raises(ValueError, match="white"):
        r.make("other")


def test_lane_goes_on_after_a_late_call():
    lane, stop = Lane(), threading.Event()
    assert lane.call(lambda: 1, 5) == 1
    with pytest.raises(TimeoutError, match="slow"):
        lane.call(stop.wait, 0.05, "slow")
    assert lane.call(lambda: 2, 5) == 2
    with pytest.raises(KeyError):
        lane.call(lambda: {}["x"], 5)
    stop.set()


def test_retries_while_busy():
    waits, tries = [], iter([OSError("busy"), OSError("busy"), None])

    def f():
        if e := next(tries):
            raise e
        return "done"

    assert retried(f, lambda e: isinstance(e, OSError), sleep=waits.append) == "done" and waits == [1, 2]
    with pytest.raises(KeyError):
        retried(lambda: {}[1], lambda e: isinstance(e, OSError), sleep=waits.append)


def test_gate():
    gate = Gate(waiters=1, seconds=0.05)
    with gate.hold("a"):
        with pytest.raises(BlockingIOError):
            with gate.hold("a"):
                pass
        with gate.hold("b"):
            pass
    with gate.hold("a"):
        pass


def test_whole_files(tmp_path):
    path = str(tmp_path / "f.txt")
    for text in ("one", "two é"):
        write_whole(path, text)
        assert open(path, encoding="utf-8").read() == text
    assert [p.name for p in tmp_path.iterdir()] == ["f.txt"] and time.time() > 0
