"""Report options, depth policy and presets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from corpuscope import fixed


@dataclass(frozen=True)
class ReportOptions:
    """What a report shows. ``depth`` decides which analysis is computed at all."""

    depth: str = "standard"
    chunk_size: int = 2000
    separator: str = "double"
    extra_spacing: bool = True
    code_fences: bool = True
    enhanced_summaries: bool = True
    key_points: bool = True
    imports: bool = True
    exports: bool = True
    dependencies: bool = True
    cross_references: bool = True
    tags: bool = True
    fence_labels: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.depth not in fixed.DEPTHS:
            raise ValueError(f"unknown summary depth: {self.depth}")
        if self.separator not in fixed.SECTION_SEPARATORS:
            raise ValueError(f"unknown separator style: {self.separator}")

    def at_least(self, depth: str) -> bool:
        return fixed.DEPTHS.index(self.depth) >= fixed.DEPTHS.index(depth)

    def shown_fields(self) -> list[str]:
        """Metadata fields of a section, in order."""
        rules = [
            ("purpose", True),
            ("frameworks", self.at_least("basic")),
            ("dependencies", self.dependencies and self.at_least("standard")),
            ("imports", self.imports and self.at_least("detailed")),
            ("exports", self.exports and self.at_least("detailed")),
            ("complexity", self.at_least("detailed")),
            ("documentation", self.at_least("detailed")),
            ("security", self.at_least("comprehensive")),
        ]
        return [name for name, shown in rules if shown]


# The named presets.
PRESETS = {
    "minimal": ReportOptions(
        depth="minimal", separator="minimal", extra_spacing=False, key_points=False, imports=False,
        exports=False, dependencies=False, cross_references=False),
    "standard": ReportOptions(),
    "detailed": ReportOptions(depth="detailed", chunk_size=1000),
    "development": ReportOptions(depth="comprehensive", chunk_size=500),
    "documentation": ReportOptions(depth="comprehensive"),
}


def preset(name: str, **changes) -> ReportOptions:
    return replace(PRESETS[name], **changes)
