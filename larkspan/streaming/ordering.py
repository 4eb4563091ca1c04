"""Answers of a session in the order of its requests, kept by state over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import scratch_path

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a session's answers by position until all earlier positions are out.

    The state of a session is the position that is due, the number of answers given out, and the answers
    that wait; an answer leaves the state when it goes out.
    """

    def __init__(self, first: int) -> None:
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "position LONG, given LONG")
        self.waiting = handle.getMapState("waiting", "position LONG", "responses ARRAY<STRING>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, given = self.due.get() or (self.first, 0)
        new: dict[int, list] = {}
        for part in rows:
            # columns come in the order of the rows' select, under names that depend on Spark's version
            for position, answer in zip(part.iloc[:, 1].tolist(), part.iloc[:, 2].tolist()):
                new.setdefault(int(position), []).append(answer)
        for answers in new.values():
            answers.sort(key=lambda a: (a is None, a or ""))
        out = [(position, new.pop(position)) for position in sorted(new) if position < due]
        # what goes out at once never enters the state
        while (held := self._held(due)) or due in new:
            out.append((due, held + new.pop(due, [])))
            if held:
                self.waiting.removeKey((due,))
            due += 1
        for position, answers in new.items():
            self.waiting.updateValue((position,), (self._held(position) + answers,))
        flat = [(position, answer) for position, answers in out for answer in answers]
        self.due.update((due, given + len(flat)))
        if flat:
            yield pd.DataFrame({
                "_session": [key[0]] * len(flat), "_position": [p for p, _ in flat], "_out": range(given, given + len(flat)),
                "_response": [a for _, a in flat],
            })

    def _held(self, position: int) -> list:
        """The answers that wait at a position, in one request to the state."""
        found = self.waiting.getValue((position,))
        return list(found[0]) if found is not None else []

    def close(self) -> None:
        pass


def in_order(answers: DataFrame, session: str, position: str, response: str = "response", first: int = 0) -> DataFrame:
    """``session, position, out, response``: ``out`` numbers a session's answers as they come out, from 0.

    ``answers`` is a stream. Positions of a session start at ``first`` and go up by one. An answer waits until all earlier
    positions are out, over as many micro-batches as that takes. Answers that share a position come
    out together; one whose position is out already comes out at once, it cannot wait for anything. Rows
    without a session or position have no order and are left out. The state store must be RocksDB, see ``serve_in_order``.
    """
    kind = answers.schema[session].dataType.simpleString()
    rows = answers.filter(F.col(session).isNotNull() & F.col(position).isNotNull()).select(
        F.col(session).alias("_session"), F.col(position).cast("long").alias("_position"), F.col(response).cast("string").alias("_response"))
    held = rows.groupBy("_session").transformWithStateInPandas(
        InOrder(first), f"_session {kind}, _position LONG, _out LONG, _response STRING", outputMode="append", timeMode="none")
    return held.select(F.col("_session").alias(session), F.col("_position").alias(position), F.col("_out").alias("out"), F.col("_response").alias(response))


def serve_in_order(
    answers: DataFrame, session: str, position: str, out: str, checkpoint: str, response: str = "response",
    first: int = 0, once: bool = False,
) -> StreamingQuery:
    """Write a stream of answers into ``out`` (Parquet) as their order allows.

    State and progress are kept below ``checkpoint``, so a restarted query goes on with the answers that wait.
    """
    spark = answers.sparkSession
    old = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        ordered = in_order(answers, session, position, response, first)
        writer = ordered.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if old is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, old)


def dealt_files(df: DataFrame, files: int, seed: int = 42) -> str:
    """Write the rows into ``files`` files, dealt and ordered by a hash, as they might arrive; returns the folder."""
    path = scratch_path(df.sparkSession, "arrivals")
    mixed = F.xxhash64(F.lit(seed), *df.columns)
    df.repartition(files, mixed).sortWithinPartitions(mixed).write.parquet(path)
    return path
