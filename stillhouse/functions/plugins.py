"""Own functions as DataFrame operators, applied only when reviewed and enabled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Plugin:
    name: str
    schema: str
    run: Callable[[pd.DataFrame], pd.DataFrame]
    reviewed: bool = False
    enabled: bool = False


class Plugins:
    """A registry of plug-ins; each change makes a new entry, so that a running query keeps its own."""

    def __init__(self) -> None:
        self._entries: dict[str, Plugin] = {}

    def save(self, name: str, schema: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
        """Saved again, a plug-in must be reviewed again."""
        self._entries[name] = Plugin(name, schema, run)

    def review(self, name: str, approve: bool = True) -> None:
        self._entries[name] = replace(self._entries[name], reviewed=approve, enabled=approve and self._entries[name].enabled)

    def enable(self, name: str, on: bool = True) -> None:
        if on and not self._entries[name].reviewed:
            raise PermissionError(f"{name} isn't reviewed")
        self._entries[name] = replace(self._entries[name], enabled=on)

    def list(self) -> list[tuple[str, bool, bool]]:
        return sorted((p.name, p.reviewed, p.enabled) for p in self._entries.values())

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` through the plug-in, batch by batch."""
        p = self._entries[name]
        if not (p.reviewed and p.enabled):
            raise PermissionError(f"{name} isn't reviewed and enabled")

        def run(batches: Iterator[pd.DataFrame], f=p.run) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield f(b)

        return df.mapInPandas(run, p.schema)
