"""Context rotation of running conversations: as a stream with state, and as a batch over whole conversations.

A conversation counts its answers. A user's message that comes when the count has reached its most (see ``conversations.most_turns``) rotates the
context: the last messages, this one among them, are a transcript, from which the caller's functions make facts and a summary; the count
begins anew, and a note joins the messages. Both ways take one message after the other through the same step, so a stream that is cut into
any batches gives what the batch gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from quarry.functions.text import fact_lines
from quarry.operators.conversations import REFRESHED

ROTATIONS = "conv_id long, turn long, rotation long, transcript string, summary string, answer string"
COLUMNS = ["conv_id", "turn", "rotation", "transcript", "summary", "answer"]


@dataclass
class Rotation:
    """What is kept of a conversation: its count of answers, rotations, summary, last turn seen, and the last messages as transcript lines."""

    turns: int = 0
    done: int = 0
    summary: str | None = None
    last: int | None = None
    lines: list[str] = field(default_factory=list)


def rotate(state: Rotation, rows: Iterator[tuple], most: int, recent: int, extract, summarise) -> Iterator[tuple]:
    """Take messages (turn, role, text, has_workers) in order; yields (turn, rotation, transcript, summary, answer). Turns that were seen are passed over."""
    for turn, role, text, has_workers in rows:
        if state.last is not None and turn <= state.last:
            continue
        state.last = int(turn)
        state.lines = [*state.lines, f"{'User' if role == 'user' else 'Assistant'}: {text if isinstance(text, str) else ''}"][-recent:]
        if role == "user" and state.turns >= (max(most - 1, 3) if has_workers is True or has_workers == 1 else most):
            transcript = "\n".join(state.lines)
            made = summarise(transcript) if summarise else None
            state.summary = made if made is not None else state.summary or ""
            state.turns, state.done = 0, state.done + 1
            state.lines = [*state.lines, f"Assistant: {REFRESHED}"][-recent:]
            yield int(turn), state.done, transcript, state.summary, extract(transcript) if extract else None
        state.turns += role == "assistant"


def rotated_batch(messages: DataFrame, most: int = 6, recent: int = 6, extract: Callable[[str], str] | None = None, summarise: Callable[[str], str] | None = None) -> DataFrame:
    """(conv_id, turn, rotation, transcript, summary, answer) of all rotations in messages (conv_id, turn, role, text, has_workers).

    A conversation's messages stream through one task in order; what is kept of it are ``recent`` lines. Of messages that repeat a turn the first
    counts; a null text is empty; without a conversation or turn a message is left out.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Rotation()
        for pdf in batches:
            out = []
            for conv, turn, role, text, workers in zip(*(pdf[c].tolist() for c in ("conv_id", "turn", "role", "text", "has_workers")), strict=True):
                if conv != key:
                    key, state = conv, Rotation()
                out += [(conv, *r) for r in rotate(state, iter([(turn, role, text, workers)]), most, recent, extract, summarise)]
            yield pd.DataFrame(out, columns=COLUMNS)

    rows = messages.select("conv_id", "turn", "role", "text", "has_workers").where("conv_id is not null and turn is not null")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(of, ROTATIONS)


class Rotating(StatefulProcessor):
    """State of a conversation: a list of its last messages, and one value each for what is counted and for the summary."""

    def __init__(self, most: int, recent: int, extract, summarise) -> None:
        self.how = (most, recent, extract, summarise)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", StructType().add("line", StringType()))
        self.counts = handle.getValueState("counts", StructType().add("turns", LongType()).add("done", LongType()).add("last", LongType()))
        self.summary = handle.getValueState("summary", StructType().add("summary", StringType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = Rotation()
        if self.counts.exists():
            state.turns, state.done, state.last = (int(x) for x in self.counts.get())
            state.lines = [line for (line,) in self.lines.get()]
        if self.summary.exists():
            (state.summary,) = self.summary.get()
        # a batch's messages of one conversation come in any order
        pdf = pd.concat(list(rows)).sort_values(["turn", "role", "text"], kind="stable")
        messages = zip(*(pdf[c].tolist() for c in ("turn", "role", "text", "has_workers")), strict=True)
        out = [(int(key[0]), *r) for r in rotate(state, messages, *self.how)]
        if state.last is not None:
            self.counts.update((state.turns, state.done, state.last))
            self.lines.put([(line,) for line in state.lines])
        if state.summary is not None:
            self.summary.update((state.summary,))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def rotated_stream(messages: DataFrame, most: int = 6, recent: int = 6, extract: Callable[[str], str] | None = None, summarise: Callable[[str], str] | None = None) -> DataFrame:
    """As ``rotated_batch`` for a stream: messages of a conversation come in order of turns from batch to batch; one that is delivered again, or
    too late, is passed over. The session's state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = messages.select("conv_id", "turn", "role", "text", "has_workers").where("conv_id is not null and turn is not null")
    processor = Rotating(most, recent, extract, summarise)
    return rows.groupBy("conv_id").transformWithStateInPandas(processor, outputStructType=ROTATIONS, outputMode="append", timeMode="none")


def facts(rotations: DataFrame) -> DataFrame:
    """(conv_id, turn, line, content, keywords): the facts in the answers of rotations, of a batch or a stream, for the memory log."""
    rows = rotations.where("answer is not null").select(F.struct("conv_id", "turn").alias("of"), "answer")
    return fact_lines(rows, "of", "answer").select("of.*", "line", "content", "keywords")
