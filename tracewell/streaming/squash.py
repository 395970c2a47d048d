"""A squash in two steps, keyed by repository: what a message says will be folded waits until the commit with that trailer is there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "repo string, seq bigint, event string, survivor string, absorbed array<string>, trailer string, sha string"
STATE = "survivor string, absorbed string"
OUTPUT = "repo string, seq bigint, status string, sha string, survivor string, absorbed array<string>"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def step(pending: tuple[str, list[str]] | None, e: dict) -> tuple[tuple[str, list[str]] | None, dict | None]:
    """(what waits, result). A `message` event waits; a `commit` event takes what waits, and folds if its trailer is the survivor's. Either way nothing waits any more."""
    if e["event"] == "message":
        return (e["survivor"], list(e["absorbed"] if e["absorbed"] is not None else [])) if e["survivor"] else pending, None
    if e["event"] != "commit" or pending is None:
        return pending, None
    folded = pending[0] == e["trailer"]
    return None, {"repo": e["repo"], "seq": e["seq"], "status": "folded" if folded else "stale", "sha": e["sha"], "survivor": pending[0], "absorbed": pending[1] if folded else []}


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending = None
    if state.exists:
        survivor, absorbed = state.get
        pending = (survivor, absorbed.split(",") if absorbed else []) if survivor else None
    rows = []
    for e in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
        pending, out = step(pending, e)
        rows += [out] if out else []
    state.update((pending[0], ",".join(pending[1])) if pending else (None, None))
    yield pd.DataFrame(rows, columns=_NAMES)


def folds(events: DataFrame) -> DataFrame:
    """Results for a stream of EVENTS rows, in the order of `seq` within a repository."""
    return events.groupBy("repo").applyInPandasWithState(_update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
