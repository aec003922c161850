"""Change ingestion as a stream: state per volume, entries written anew after each micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treelight.operators.replay import Volume

OUTPUT = "drive string, slot bigint, frn bigint, parent_frn bigint, name string, is_dir boolean, batch bigint"


def live_entries(events: DataFrame) -> DataFrame:
    """events: a stream of (drive, usn, op, frn, parent_frn, name, is_dir). Each micro-batch emits the live entries of every
    volume that changed, numbered by batch; a reader takes each volume's last batch. Offsets and state commit together."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, batch = state.get if state.exists else (None, 0)
        volume = Volume(key[0], kept)
        rows = pd.concat(list(parts)).sort_values("usn", kind="stable")
        volume.apply(rows[["op", "frn", "parent_frn", "name", "is_dir"]].itertuples(index=False, name=None))
        state.update((volume.dump(), batch + 1))
        yield volume.rows().assign(batch=batch + 1)

    return events.groupBy("drive").applyInPandasWithState(run, OUTPUT, "nodes string, batch bigint", "append", GroupStateTimeout.NoTimeout)
