"""Engine plug-ins with stand-ins for what is not shipped."""

import sys
from types import SimpleNamespace

import numpy as np
import pytest

from lamella.operators.engines import Edited, ModelEngine, ProcessEngine, ServiceEngine, repaired

image = np.random.default_rng(1).integers(0, 256, (21, 34, 3)).astype(np.uint8)
mask = np.zeros((21, 34), bool)
mask[5:9, 4:20] = True


class Session:
    def __init__(self, path):
        self.path, self.seen = path, []

    def get_inputs(self):
        return [SimpleNamespace(name="img"), SimpleNamespace(name="m")]

    def run(self, _, inputs):
        self.seen.append((inputs["img"].shape, inputs["m"].shape))
        return [np.where(inputs["m"] > 0, 0.5, inputs["img"]).astype(np.float32)]


def test_model():
    opened = []
    engine = ModelEngine("weights", open_session=lambda p: opened.append(Session(p)) or opened[-1])
    for _ in range(2):
        made = engine.repair(image, mask)
        assert (made[mask] == 128).all() and (made[~mask] == image[~mask]).all()
    assert len(opened) == 1 and opened[0].path == "weights" and opened[0].seen[0] == ((1, 3, 24, 40), (1, 1, 24, 40))


def test_process():
    code = "import sys, io, numpy as np; d = np.load(io.BytesIO(sys.stdin.buffer.read())); o = np.where(d['mask'][..., None], np.uint8(7), d['image']); b = io.BytesIO(); np.save(b, o); sys.stdout.buffer.write(b.getvalue())"
    made = ProcessEngine([sys.executable, "-c", code]).repair(image, mask)
    assert (made[mask] == 7).all() and (made[~mask] == image[~mask]).all()
    with pytest.raises(RuntimeError):
        ProcessEngine([sys.executable, "-c", "raise SystemExit(3)"]).repair(image, mask)


class Painter:
    def __init__(self, usd):
        self.usd = usd

    def edit(self, request):
        return Edited(np.full_like(request.image, 9), self.usd)


def test_service_keeps_to_its_budget():
    engine = ServiceEngine(Painter(0.03), 0.1, 0.04)
    results = [engine.repair(image, mask) for _ in range(5)]
    assert engine.calls == 3 and engine.refused == 2 and engine.spent == pytest.approx(0.09)
    assert (results[0] == 9).all() and (results[4] == image).all()
    assert ServiceEngine(Painter(None), 1.0, 0.4).repair(image, mask).max() == 9
    watched = ServiceEngine(Painter(0.0), 1.0, 0.4, still_read=lambda i, m: True)
    assert (watched.repair(image, mask) == image).all() and watched.rejected == 1


def test_a_failed_call_counts():
    class Broken:
        def edit(self, request):
            raise OSError("no network")

    engine = ServiceEngine(Broken(), 1.0, 0.4)
    for _ in range(2):
        with pytest.raises(OSError):
            engine.repair(image, mask)
    assert (engine.repair(image, mask) == image).all() and engine.calls == 2


@pytest.mark.parametrize("patches", [False, True])
def test_nothing_outside_the_mask_changes(patches):
    engine = ServiceEngine(Painter(0.0), 10.0, 0.1)
    made = repaired(engine, image, mask, patches)
    assert (made[~mask] == image[~mask]).all() and (made[mask] != image[mask]).any()
    assert (repaired(engine, image, mask & False) == image).all()
    with pytest.raises(ValueError):
        repaired(SimpleNamespace(repair=lambda i, m: i[:-1]), image, mask)
