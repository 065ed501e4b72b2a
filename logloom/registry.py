"""Detectors by id: replaced in place, renamed with a fold map, compiled once."""

from __future__ import annotations

from importlib import metadata

from logloom.plans.spec import Compiled, SpecError, compile_detector

ENTRY_POINTS = "logloom.detectors"


def fold_map(renames: dict[str, str]) -> dict[str, str]:
    """Every retired id with its present one, chains resolved; a cycle is an error."""
    out = {}
    for old in renames:
        seen, now = {old}, renames[old]
        while now in renames:
            if now in seen:
                raise ValueError(f"renames run in a circle at {now!r}")
            seen.add(now)
            now = renames[now]
        out[old] = now
    return out


class Registry:
    def __init__(self, entries: list[dict] | None = None):
        self._by_id: dict[str, Compiled] = {}
        self._renames: dict[str, str] = {}
        self.errors: list[tuple[str, str]] = []
        self.extend(entries or [])

    def add(self, entry: dict | Compiled) -> None:
        """Adds a detector; one with a known id takes its place. An entry that does not compile is kept as an error."""
        try:
            detector = entry if isinstance(entry, Compiled) else compile_detector(entry)
        except SpecError as e:
            self.errors.append((str(entry.get("id", "?")) if isinstance(entry, dict) else "?", str(e)))
            return
        self._by_id[detector.id] = detector

    def extend(self, entries) -> None:
        for e in entries:
            self.add(e)

    def rename(self, old: str, new: str) -> None:
        fold_map({**self._renames, old: new})
        self._renames[old] = new
        self._by_id.pop(old, None)

    def remove(self, name: str) -> None:
        self._by_id.pop(name, None)

    def get(self, name: str) -> Compiled | None:
        return self._by_id.get(self.fold().get(name, name))

    def ids(self) -> list[str]:
        return list(self._by_id)

    def fold(self) -> dict[str, str]:
        return fold_map(self._renames)

    def detectors(self, only: set[str] | None = None) -> list[Compiled]:
        """The compiled detectors, in order of arrival; ``only`` narrows them before any plan is made."""
        return [d for d in self._by_id.values() if only is None or d.id in only]

    def load_plugins(self) -> None:
        """Entries that installed packages offer; a broken package is skipped."""
        for point in metadata.entry_points(group=ENTRY_POINTS):
            try:
                self.extend(point.load()())
            except Exception as e:  # another package's fault costs only that package
                self.errors.append((point.name, str(e)))

    def copy(self) -> Registry:
        other = Registry()
        other._by_id, other._renames = dict(self._by_id), dict(self._renames)
        return other


def default() -> Registry:
    """The shipped library."""
    from logloom.detectors import LIBRARY

    return Registry(LIBRARY)
