"""Engines that repair a page image: an interface, and plug-ins for models and services that are not shipped.

An engine takes an image and a mask and gives an image. repaired() keeps to
the mask whatever an engine does outside it. Engines hold what cannot travel
(sessions, processes), so they are made in the task, once a batch of pages.
"""

from __future__ import annotations

import io
import subprocess
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np

from .raster import composited, inpainted_by_patches


class Engine(Protocol):
    def repair(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


def repaired(engine: Engine, image: np.ndarray, mask: np.ndarray, patches: bool = False, sigma: float = 1.0) -> np.ndarray:
    """The engine's image within the mask, softened toward its rim; by crops around the mask, if asked."""
    if not mask.any():
        return image.copy()
    made = inpainted_by_patches(image, mask, engine.repair) if patches else np.asarray(engine.repair(image, mask))
    if made.shape != image.shape:
        raise ValueError(f"the engine gave an image of shape {made.shape}, not {image.shape}")
    return composited(image, made, mask, sigma)


class ModelEngine:
    """A network in the ONNX format with an image and a mask as inputs, both in 0 to 1 and sides of whole multiples.

    open_session(path) gives an object with get_inputs() and run(None, inputs),
    as onnxruntime's; it is opened at the first page.
    """

    def __init__(self, path: str, multiple: int = 8, open_session: Callable[[str], Any] | None = None):
        self.path, self.multiple, self._open, self._session = path, multiple, open_session or _onnx_session, None

    def repair(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if self._session is None:
            self._session = self._open(self.path)
        h, w = mask.shape
        pad = [(0, -h % self.multiple), (0, -w % self.multiple)]
        x = np.pad(image.astype(np.float32) / 255, [*pad, (0, 0)], mode="edge").transpose(2, 0, 1)[None]
        m = np.pad(mask.astype(np.float32), pad)[None, None]
        names = [i.name for i in self._session.get_inputs()]
        out = np.asarray(self._session.run(None, dict(zip(names, (x, m))))[0])[0].transpose(1, 2, 0)[:h, :w]
        return np.clip(np.floor((out if out.max(initial=0) > 1.5 else out * 255) + 0.5), 0, 255).astype(np.uint8)


def _onnx_session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers())


class ProcessEngine:
    """A model that runs in a process of its own: arrays go in by standard input, the image comes by standard output."""

    def __init__(self, command: Sequence[str], seconds: float = 120.0):
        self.command, self.seconds = list(command), seconds

    def repair(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        buffer = io.BytesIO()
        np.savez(buffer, image=image, mask=mask)
        done = subprocess.run(self.command, input=buffer.getvalue(), capture_output=True, timeout=self.seconds)
        if done.returncode:
            raise RuntimeError(f"the model's process failed: {done.stderr.decode(errors='replace')[-300:]}")
        return np.load(io.BytesIO(done.stdout), allow_pickle=False)


@dataclass
class Edit:
    """What a service is asked: an image, the mask to edit, and a prompt."""

    image: np.ndarray
    mask: np.ndarray
    prompt: str = "Remove the text and go on with the background."


@dataclass
class Edited:
    """What it gave, and what the call cost, if it is known."""

    image: np.ndarray
    usd: float | None = None
    notes: dict = field(default_factory=dict)


class Provider(Protocol):
    def edit(self, request: Edit) -> Edited: ...


class ServiceEngine:
    """A provider's edits within a budget; a page is left as it was where the budget is used up or its text is still read.

    worst: the price of a call whose cost is not told, set aside before each.
    still_read(image, mask), if given, rejects an edit.
    """

    def __init__(self, provider: Provider, budget_usd: float, worst: float, still_read: Callable[[np.ndarray, np.ndarray], bool] | None = None):
        self.provider, self.budget, self.worst, self.still_read = provider, budget_usd, worst, still_read
        self.spent, self.calls, self.rejected, self.refused = 0.0, 0, 0, 0

    def repair(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        if self.spent + self.worst > self.budget:
            self.refused += 1
            return image.copy()
        self.calls += 1
        try:
            made = self.provider.edit(Edit(image, mask))
        except Exception:
            self.spent += self.worst  # a failed call may have been charged
            raise
        self.spent += self.worst if made.usd is None else made.usd
        if made.image.shape != image.shape or (self.still_read and self.still_read(made.image, mask)):
            self.rejected += 1
            return image.copy()
        return made.image
