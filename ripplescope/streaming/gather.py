"""Change sets that arrive in pieces: gathered by key across batches, repeats dropped, each given once when it is whole."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ripplescope.sources import diffs

_WHOLE = "change_set_id string, diff_text string"
_STATE = "done boolean, parts array<int>, texts array<string>"


def _gather(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState, patience: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # forgotten; what was missing never came
        state.remove()
        return
    done, parts, texts = state.get if state.exists else (False, [], [])
    held, most = dict(zip(parts, texts)), 0
    for batch in batches:
        if done:
            continue
        for part, of, text in zip(batch["part"].tolist(), batch["parts"].tolist(), batch["text"].tolist()):
            held.setdefault(part, text)
            most = max(most, of)
    if not done and most and all(k in held for k in range(most)):
        done = True
        yield pd.DataFrame({"change_set_id": [key[0]], "diff_text": ["".join(held[k] for k in range(most))]})
        held = {}
    state.update((done, list(held), list(held.values())))
    if patience is not None:
        state.setTimeoutDuration(patience)


def gathered(pieces: DataFrame, patience: int | None = None) -> DataFrame:
    """(change_set_id, diff_text) of a stream of pieces (change_set_id, part from 0, parts, text), each change set once, when all its parts are there.

    However the pieces are dealt to batches, in whatever order and however often they come, the rows are those of whole().
    What is held are the parts of change sets not yet whole, and a mark for each that was given: for `patience` milliseconds
    after the last piece, in a stream that goes on, or else for good (with a patience, a stream of what is there never ends).
    """
    sound = pieces.select("change_set_id", "part", "parts", "text").dropna().filter("part >= 0 and part < parts")
    keyed = sound.groupBy(F.col("change_set_id").cast("string").alias("change_set_id"))
    return keyed.applyInPandasWithState(lambda k, b, s: _gather(k, b, s, patience), _WHOLE, _STATE, "append", GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout)


def whole(pieces: DataFrame) -> DataFrame:
    """The same of a table of pieces; of pieces with one place but different texts the least counts."""
    sound = pieces.select("change_set_id", "part", "parts", "text").dropna().filter("part >= 0 and part < parts")
    once = sound.groupBy(F.col("change_set_id").cast("string").alias("change_set_id"), "part").agg(F.min("text").alias("text"), F.max("parts").alias("parts"))
    sets = once.groupBy("change_set_id").agg(F.count("*").alias("n"), F.max("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("x"))
    return sets.filter("n = parts").select("change_set_id", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("diff_text"))


def watch_pieces(pieces: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False, patience: int | None = None) -> StreamingQuery:
    """Calls `handle` with the parsed changes of the change sets that have become whole in each batch of a stream of pieces."""
    if once and patience is not None:
        raise ValueError("a stream that is to end can't wait for what is missing")
    writer = gathered(pieces, patience).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: handle(diffs.parse(batch), number))
    return (writer.trigger(availableNow=True) if once else writer).start()
