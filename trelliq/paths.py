"""Where a run's artifacts lie below its root."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Places:
    root: str

    def of(self, *parts: str) -> str:
        return "/".join((self.root.rstrip("/"), *parts))

    def split(self, name: str) -> str:
        return self.of(name)

    @property
    def corpus(self) -> str:
        return self.of("corpus")

    @property
    def ledger(self) -> str:
        return self.of("ledger")

    @property
    def sample(self) -> str:
        return self.of("sample")

    @property
    def near_pairs(self) -> str:
        return self.of("near_pairs")

    @property
    def report(self) -> str:
        return self.of("report.json")

    @property
    def manifest(self) -> str:
        return self.of("manifest.json")
