"""Options of a run, with their defaults, and the rules between them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    input: str
    output: str | None = None
    export: str | None = None
    fixed_tripod: bool = False
    no_stack: bool = False
    no_correction: bool = False
    export_window: int = 7
    limit: int | None = None
    max_stars: int = 40
    sky_tolerance: float = 1.6
    max_foreground: float | None = None
    search_px: int = 48
    anomaly: str = "full"
    contrast: float = 0.0
    deflicker: bool = True
    cloud_guard: bool = True
    keep_transients: bool = True

    def problems(self) -> list[str]:
        """What is wrong with the options, if anything."""
        out = []
        if self.no_stack and not self.export:
            out.append("without a stack there must be an export")
        if self.no_stack and not self.fixed_tripod:
            out.append("only a fixed tripod can do without a stack")
        if self.export and self.no_correction:
            out.append("the export needs the correction")
        if not self.no_stack and not self.output:
            out.append("the stack needs an output")
        if not self.fixed_tripod and self.max_stars < 6:
            out.append("alignment needs six stars or more")
        if self.anomaly not in ("full", "coarse", "none"):
            out.append("anomaly is one of full, coarse, none")
        return out

    def checked(self) -> Config:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self
