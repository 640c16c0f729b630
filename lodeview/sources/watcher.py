"""File events for the live path: folders are compared at intervals, and changes are written as JSON files.

An add or change is told when a file's size and time have stayed for one interval,
so a file that is still being written is not read. For TICKS seconds after the last
event each step also writes a tick, which moves event time on, so that jobs become
due while nothing happens. Event files appear under their names when they are whole.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from lodeview.plans.globs import DEFAULT_EXCLUDES, to_regex

TICKS = 5.0
State = dict[str, tuple[int, int, int, int]]


def snapshot(roots: Sequence[str], excludes: Sequence[str] = tuple(DEFAULT_EXCLUDES)) -> State:
    """(size, time of change in ns, inode, device) of each file below the roots that is not left out."""
    out, left_out = {}, re.compile("|".join(map(to_regex, excludes)) or r"(?!)")
    stack = [os.path.abspath(r) for r in roots]
    while stack:
        try:
            with os.scandir(stack.pop()) as entries:
                for e in entries:
                    if e.name.startswith("."):
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if not left_out.match(e.path + "/x"):
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False) and not left_out.match(e.path):
                        s = e.stat(follow_symlinks=False)
                        out[e.path] = s.st_size, s.st_mtime_ns, s.st_ino, s.st_dev
        except OSError:
            continue
    return out


class Watcher:
    """Events from one comparison to the next."""

    def __init__(self, roots: Sequence[str], folder: str, excludes: Sequence[str] = tuple(DEFAULT_EXCLUDES)):
        self.roots, self.folder, self.excludes, self.number = list(roots), folder, excludes, 0
        os.makedirs(folder, exist_ok=True)
        self.told = snapshot(roots, excludes)
        self.before, self.last = dict(self.told), 0.0

    def step(self) -> list[dict]:
        """Compare with the last step, write what has settled, and return it."""
        now, at, events = snapshot(self.roots, self.excludes), datetime.now(timezone.utc).isoformat(), []

        def tell(path: str, kind: str, s: tuple[int, int, int, int]) -> None:
            self.number += 1
            events.append({"event_id": time.time_ns() // 1000 * 1000 + self.number % 1000, "path": path, "kind": kind, "size": s[0], "mtime_ms": s[1] / 1e6, "inode": s[2], "device": s[3], "ts": at})

        for path in self.told.keys() - now.keys():
            tell(path, "unlink", self.told.pop(path))
        for path, s in now.items():
            if s != self.told.get(path) and s == self.before.get(path):
                tell(path, "change" if path in self.told else "add", s)
                self.told[path] = s
        self.before = now
        if events:
            self.last = time.monotonic()
        elif self.last and time.monotonic() - self.last < TICKS:
            tell("", "tick", (0, 0, 0, 0))
        if events:
            name = f"{time.time_ns()}.json"
            with open(f"{self.folder}/.{name}", "w") as f:
                f.write("\n".join(map(json.dumps, events)) + "\n")
            os.rename(f"{self.folder}/.{name}", f"{self.folder}/{name}")
        return [e for e in events if e["kind"] != "tick"]

    def run(self, ended: Callable[[], bool], every: float = 0.2) -> None:
        while not ended():
            self.step()
            time.sleep(every)
