"""An extension: records kept current from a stream of questions, each key answered once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import runs


def stream_cell(questions: DataFrame, config: dict, model: str, strategy: str, out: str, checkpoint: str, factory=None) -> StreamingQuery:
    """Runs a cell on every micro-batch of a streaming frame of questions; a batch that is tried again skips the keys that were written."""

    def batch(df: DataFrame, _: int) -> None:
        runs.run_cell(df.dropDuplicates(["question_id"]), config, model, strategy, out, factory=factory)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
