"""Serving: heat simulation, order-independent cache keys, and a registry of runs addressed by content."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import math
import os
import random
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

Z = 1.959963984540054


def wilson_interval(successes: int, n: int) -> tuple[float, float]:
    if n <= 0:
        raise ValueError("no trials")
    p = successes / n
    bottom = 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / bottom
    margin = Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / bottom
    return max(0.0, centre - margin), min(1.0, centre + margin)


@dataclass(frozen=True)
class Entrant:
    athlete: str
    mu: float
    sigma: float


def simulate_heat(entrants: list[Entrant], advance: int, beta: float, penalty: float = 0.0, seed: int = 0, least: int = 2_000, most: int = 50_000, width: float = 0.02) -> dict[str, tuple[float, float, float]]:
    """Share of draws in which each athlete is among the first ``advance``, with its interval. Draws stop when every
    interval is narrow enough."""
    if not 1 <= advance < len(entrants) or len({e.athlete for e in entrants}) != len(entrants):
        raise ValueError("some must advance, but not all, and athletes must be different")
    if not 0 <= penalty < 1 or beta <= 0 or any(e.sigma < 0 for e in entrants):
        raise ValueError("penalty must be a share below 1, beta above 0 and no deviation below 0")
    r = random.Random(seed)
    hits = {e.athlete: 0 for e in entrants}
    spread = [(e.athlete, e.mu, math.hypot(e.sigma, beta)) for e in entrants]
    n = 0
    while n < most:
        for _ in range(500):
            field = [(r.gauss(mu, s), a) for a, mu, s in spread if r.random() >= penalty]
            for _, a in sorted(field, reverse=True)[:advance]:
                hits[a] += 1
        n += 500
        if n >= least and all(h - l <= width for l, h in (wilson_interval(k, n) for k in hits.values())):
            break
    return {a: (k / n, *wilson_interval(k, n)) for a, k in hits.items()}


def canonical(value: object) -> str:
    """JSON with sorted keys and exact floats."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def cache_key(entrants: list[Entrant], advance: int, beta: float, penalty: float = 0.0, seed: int = 0, run: str = "", model: str = "heat-1") -> str:
    """The same key for any order and names of entrants; ratings count to one decimal. Everything else that changes the
    answer is in the key: the penalty rate, the seed, the run that the ratings are from and the model's version."""
    field = sorted([round(e.mu, 1), round(e.sigma, 1)] for e in entrants)
    return hashlib.sha256(canonical([field, advance, round(beta, 6), round(penalty, 6), seed, run, model]).encode()).hexdigest()


class Registry:
    """Runs and their states in one small JSON file, replaced whole at every change.

    A run's id is the digest of its inputs and parameters. States: running, complete, failed; one complete run may be
    published.
    """

    def __init__(self, path: str):
        self.path = path

    def _read(self) -> dict:
        if not os.path.exists(self.path):
            return {"runs": {}, "published": None}
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    def _write(self, state: dict) -> None:
        handle, name = tempfile.mkstemp(dir=os.path.dirname(self.path) or ".")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(canonical(state))
        os.replace(name, self.path)

    @contextlib.contextmanager
    def _alone(self) -> Iterator[None]:
        """Holds off other writers between reading the file and replacing it."""
        with open(self.path + ".lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def begin(self, inputs: dict, parameters: dict) -> str:
        with self._alone():
            return self._begin(inputs, parameters)

    def _begin(self, inputs: dict, parameters: dict) -> str:
        run = hashlib.sha256(canonical([inputs, parameters]).encode()).hexdigest()[:16]
        state = self._read()
        if state["runs"].get(run, {}).get("state") == "complete":
            return run
        state["runs"][run] = {"state": "running", "inputs": inputs, "parameters": parameters, "created": time.time()}
        self._write(state)
        return run

    def _move(self, run: str, to: str) -> None:
        with self._alone():
            state = self._read()
            if state["runs"].get(run, {}).get("state") != "running":
                raise ValueError(f"{run} is not running")
            state["runs"][run]["state"] = to
            self._write(state)

    def complete(self, run: str) -> None:
        self._move(run, "complete")

    def fail(self, run: str) -> None:
        self._move(run, "failed")

    def publish(self, run: str) -> None:
        with self._alone():
            state = self._read()
            if state["runs"].get(run, {}).get("state") != "complete":
                raise ValueError("only a complete run can be published")
            state["published"] = run
            self._write(state)

    def current(self) -> str | None:
        return self._read()["published"]

    def reusable(self, inputs: dict, parameters: dict) -> str | None:
        run = hashlib.sha256(canonical([inputs, parameters]).encode()).hexdigest()[:16]
        return run if self._read()["runs"].get(run, {}).get("state") == "complete" else None
