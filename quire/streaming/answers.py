"""Streamed answers as streams: what a piece leaves unfinished is kept between batches and restarts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import markdown as M

#: Next piece, the line it will go on with, characters so far, what failed, and pieces that came early as JSON.
STATE = "next long, partial string, chars long, done boolean, error string, early string"


def answers(pieces: DataFrame) -> DataFrame:
    """(doc_id, seq, text, chars, done, error) of a stream of (doc_id, seq, piece), seq from 0: what each piece adds to its answer.

    A piece may end inside a line: the rest waits for the next one, as do pieces that come before their turn; one
    that comes again says nothing. chars: characters of the answer so far. An error event ends the answer; what
    comes later says nothing. State is one small row an answer, in the checkpoint.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, partial, chars, done, error, early = state.get if state.exists else (0, "", 0, False, None, "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for frame in frames:
            for seq, piece in zip(frame["seq"].tolist(), frame["piece"].tolist()):
                if seq >= at:
                    waiting.setdefault(int(seq), piece or "")
        out = []
        while at in waiting:
            *lines, partial = (partial + waiting.pop(at)).split("\n")
            text = []
            for line in lines if error is None else ():
                said, error, last = M.sse_event(line)
                done = done or last
                text.append(said)
                if error is not None:
                    break
            chars += sum(map(len, text))
            out.append((key[0], at, "".join(text), chars, done, error))
            at += 1
        state.update((at, partial, chars, done, error, json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "text", "chars", "done", "error"])

    return pieces.select("doc_id", "seq", "piece").groupBy("doc_id").applyInPandasWithState(step, f"doc_id {kind}, seq long, text string, chars long, done boolean, error string", STATE, "append", GroupStateTimeout.NoTimeout)
