"""Configurations, run numbers, phase timers and file identities; all on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import time
from contextlib import contextmanager


def read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def merged(base: dict, over: dict) -> dict:
    """Base with over laid into it, dict by dict."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def run_id(iteration: int, configs: int, index: int) -> int:
    """Number of a configuration's run in an iteration."""
    return iteration * configs + index


class Phases:
    """Seconds by phase; phases that nest pause the outer one."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.stack: list[list] = []

    @contextmanager
    def phase(self, name: str):
        now = time.time()
        if self.stack:
            self._add(self.stack[-1], now)
        self.stack.append([name, now])
        try:
            yield self
        finally:
            now = time.time()
            self._add(self.stack.pop(), now)
            if self.stack:
                self.stack[-1][1] = now

    def _add(self, entry: list, now: float) -> None:
        self.seconds[entry[0]] = self.seconds.get(entry[0], 0.0) + now - entry[1]

    def rows(self, run: str) -> list[tuple[str, str, float]]:
        return [(run, k, v) for k, v in self.seconds.items()]


def file_identity(path: str) -> str:
    """Digest of a file's path, size and time of change; empty for no file."""
    if not os.path.isfile(path):
        return ""
    s = os.stat(path)
    return hashlib.md5(f"{os.path.realpath(path)}|{s.st_size}|{s.st_mtime_ns}".encode()).hexdigest()
