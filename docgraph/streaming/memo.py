"""A memo per key as a stream's state: what was asked before is a hit, and the oldest entry goes when there are too many."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

#: The state store that map state needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memo(StatefulProcessor):
    """First in, first out: entries by item, and by the number of their arrival, so that the oldest is found without a scan."""

    def __init__(self, key: str, order: str, item: str, most: int):
        self.names, self.most = (key, order, item), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.arrival = handle.getMapState("arrival", "item string", "n long")
        self.by_arrival = handle.getMapState("by_arrival", "n long", "item string")
        self.ends = handle.getValueState("ends", "oldest long, next long")

    def _ask(self, item: str, oldest: int, end: int) -> tuple[bool, str | None, int, int]:
        """Whether the item is there, what went for it if it was not, and the numbers of the oldest and the next entry."""
        if self.arrival.containsKey((item,)):
            return True, None, oldest, end
        gone = None
        if end - oldest >= self.most:
            gone = self.by_arrival.getValue((oldest,))[0]
            self.by_arrival.removeKey((oldest,))
            self.arrival.removeKey((gone,))
            oldest += 1
        self.arrival.updateValue((item,), (end,))
        self.by_arrival.updateValue((end,), (item,))
        return False, gone, oldest, end + 1

    def handleInputRows(self, key, rows, timerValues):
        name, order, item = self.names
        oldest, end = self.ends.get() if self.ends.exists() else (0, 0)
        asked, hits, gone = pd.concat(list(rows)).sort_values(order), [], []
        for x in asked[item]:
            hit, out, oldest, end = self._ask(x, oldest, end)
            hits.append(hit)
            gone.append(out)
        yield pd.DataFrame({name: [key[0]] * len(asked), order: asked[order].to_numpy(), item: asked[item].to_numpy(), "hit": hits, "evicted": gone})
        self.ends.update((oldest, end))

    def close(self) -> None:
        pass


def memoised(requests: DataFrame, key: str, order: str, item: str, most: int) -> DataFrame:
    """(key, order, item, hit, evicted) for each row of a stream of requests: whether the key's memo of at most `most` items has the
    item, and which item, the one there longest, went to make room for it where it has not.

    A batch's requests of a key are taken in their order, batches one after the other; a restart goes on from the checkpoint.
    Null items are not asked for and are left out. A key's state holds two entries an item; a batch's rows of a key come
    together in one task, so batches should be bounded (maxFilesPerTrigger). Needs the state store `PROVIDER`.
    """
    out = StructType([requests.schema[key], requests.schema[order], requests.schema[item]]).add("hit", BooleanType()).add("evicted", requests.schema[item].dataType)
    asked = requests.where(requests[item].isNotNull()).groupBy(key)
    return asked.transformWithStateInPandas(Memo(key, order, item, most), out, "Append", "None")
