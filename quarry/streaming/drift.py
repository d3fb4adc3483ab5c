"""What has changed in a corpus that is listed again and again: keyed state over micro-batches.

The stream has the rows of listings, each with the time of its listing. For every path the last snapshot is kept; a row
whose snapshot differs reports it as changed, the first one as new. A path that no listing has confirmed when the watermark
has passed its last one is gone, and its state goes with it. All is reported once; after a restart the state comes back
from the checkpoint.

State is as large as the corpus has paths, so on a cluster ``spark.sql.streaming.stateStore.providerClass`` is best set to
the RocksDB provider, which keeps it on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a snapshot is made of.
SNAPSHOT = ("size_bytes", "modified_unix_millis", "readonly", "permissions", "stable_token", "device_id", "inode")
REPORT = "resolved_path string, drift string, listed_at timestamp, was string, is_ string"
STATE = "snapshot string, millis long"


def _time(millis: int) -> pd.Timestamp:
    return pd.Timestamp(millis, unit="ms", tz="UTC")


def _reports(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (path,) = key
    if state.hasTimedOut:
        last, millis = state.get
        state.remove()
        yield pd.DataFrame([(path, "gone", _time(millis), last, None)], columns=["resolved_path", "drift", "listed_at", "was", "is_"])
        return
    rows = pd.concat(list(batches)).sort_values(["millis", "snapshot"], kind="stable")
    last, seen = state.get if state.exists else (None, None)
    out = []
    for millis, snapshot in zip(rows["millis"].tolist(), rows["snapshot"].tolist()):
        if seen is not None and millis < seen:  # of a listing before the one that is known
            continue
        if snapshot != last:
            out.append((path, "new" if last is None else "changed", _time(millis), last, snapshot))
        last, seen = snapshot, millis
    state.update((last, int(seen)))
    state.setTimeoutTimestamp(max(int(seen) + 1, state.getCurrentWatermarkMs() + 1))
    if out:
        yield pd.DataFrame(out, columns=["resolved_path", "drift", "listed_at", "was", "is_"])


def drift(listings: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``listings``: a stream of files with ``listed_at``, a timestamp, the same for all rows of a listing. ``delay``: how much
    later than others rows of a listing may come. A row for each change: new, changed or gone."""
    snapshot = F.to_json(F.struct(*SNAPSHOT))
    rows = listings.select("resolved_path", "listed_at", snapshot.alias("snapshot"), F.unix_millis("listed_at").alias("millis")).withWatermark("listed_at", delay)
    return rows.groupBy("resolved_path").applyInPandasWithState(_reports, REPORT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
