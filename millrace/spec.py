"""Which columns of a table play which role."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TableSpec:
    row_id: str
    features: tuple[str, ...]
    label: str | None = None
    categorical: tuple[str, ...] = ()

    def with_features(self, features) -> "TableSpec":
        kept = tuple(features)
        return replace(self, features=kept, categorical=tuple(c for c in self.categorical if c in kept))
