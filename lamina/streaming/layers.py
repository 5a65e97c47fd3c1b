"""Prints from a stream of layers that arrive in any order.

State is kept for each file: the slices that have arrived, and how many layers it should have.  A file is emitted when
its last layer arrives.  A file that waits too long is emitted as incomplete, with the layers that are missing: a
layer that never came is an error, not an empty layer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import format as X
from ..sources.codec import decode
from ..sources.encode import Print, build

IN = "file_id string, layer int, sector_id int, total_layers int, width int, height int, data binary"
OUT = "file_id string, complete boolean, missing array<int>, content binary"
STATE = "total int, width int, height int, slices array<struct<layer: int, sector_id: int, data: binary>>"


def _update(meta: str, wait_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, width, height, slices = state.get if state.exists else (0, 0, 0, [])
        held = {(s["layer"], s["sector_id"]) if isinstance(s, dict) else (s[0], s[1]): bytes(s["data"] if isinstance(s, dict) else s[2]) for s in slices}
        late = state.hasTimedOut
        for b in batches:
            for r in b.itertuples(index=False):
                total, width, height = int(r.total_layers), int(r.width), int(r.height)
                held[int(r.layer), int(r.sector_id)] = bytes(r.data or b"")
        arrived = {layer for layer, _ in held}
        missing = [k for k in range(total) if k not in arrived]
        if not missing or late:
            state.remove()
            content = None
            if not missing:
                layers: list[dict] = [{} for _ in range(total)]
                for (layer, sector), data in held.items():
                    if data:
                        layers[layer][sector] = decode(data, width * height)
                content = build(Print(X.Head("lamina", 0, width, height, 1000, 1000, 1000, 50, total), json.loads(meta), layers))
            yield pd.DataFrame({"file_id": [key[0]], "complete": [not missing], "missing": [missing], "content": [content]})
        else:
            state.update((total, width, height, [(a, b, d) for (a, b), d in sorted(held.items())]))
            state.setTimeoutDuration(wait_ms)

    return update


def assemble(layers: DataFrame, meta: dict, wait_ms: int = 3_600_000) -> DataFrame:
    """A streaming DataFrame (OUT) from one of encoded slices (IN). A slice that comes again replaces the first."""
    return layers.groupBy("file_id").applyInPandasWithState(_update(json.dumps(meta), wait_ms), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
