"""New records against an index, batch after batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lacewing.operators.index import NameIndex


def match_then_add(stream: DataFrame, index: NameIndex, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str = "stream", id_col: str = "id", name_col: str = "name") -> StreamingQuery:
    """For each micro-batch, hand its hits against what is stored to sink, then add its names. A batch that is replayed
    from the checkpoint folder is looked up in the index as it was before it, and added once; sink gets its number and has
    to tell replays apart itself. Each stream that feeds an index needs a name of its own."""

    def each(batch: DataFrame, number: int) -> None:
        own = f"{name}-{number}"
        batch.persist()
        try:
            sink(index.before(own).hits(batch, id_col, name_col), number)
            index.add(batch, id_col, name_col, own)
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
