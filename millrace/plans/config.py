"""Options of the compaction plan; all of them are literals in the plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    prefix: str = "[millrace]"
    head: int = 30
    tail: int = 60
    min_run: int = 3
    window: int = 50
    before: int = 3
    after: int = 3
    max_block: int = 500
    max_step: int = 4000
    max_protected: int = 2000
    passthrough_lines: int = 40
    passthrough_bytes: int = 2048
    decision_bytes: int = 1 << 20
    always_filter: bool = False
    footer: bool = True
    enabled: bool = True
    #: Stages after which the working frame is written and read back, so that no plan grows with all of them.
    cuts: tuple[str, ...] = ("node-install",)
    #: Runs of more lines than this are worked on by segments of this many lines; 0: every run is a unit of work. For
    #: skewed inputs some 200,000; a run in segments is written about thirty times on its way.
    segment: int = 0
    #: Stages that are switched off, by name.
    off: frozenset[str] = field(default_factory=frozenset)

    def on(self, name: str) -> bool:
        return self.enabled and name not in self.off
