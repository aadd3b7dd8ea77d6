"""Text of token streams as it becomes complete, cut at stop strings, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def emitted(held: bytes, stopped: bool, data: bytes, stops: list[str], last: bool) -> tuple[str, bytes, bool]:
    """New text, bytes still held, whether a stop came.

    Only whole characters go out. The text ends before the earliest stop string; the longest end that could begin one is held
    back until the next bytes, or sent with the last.
    """
    if stopped:
        return "", b"", True
    held += data
    cut = len(held)
    if not last:  # an unfinished character has at most three bytes
        for back in range(1, min(4, len(held) + 1)):
            byte = held[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(held) - back if back < need else cut
                break
            if byte < 0x80:
                break
    text = held[:cut].decode("utf-8", "replace")
    found = [i for i in (text.find(s) for s in stops) if i >= 0]
    if found:
        return text[: min(found)], b"", True
    keep = 0
    if not last:
        keep = max((n for s in stops for n in range(1, min(len(s), len(text) + 1)) if text.endswith(s[:n])), default=0)
    out = text[: len(text) - keep]
    return out, text[len(text) - keep :].encode() + held[cut:], False


def texts(tokens: DataFrame, stops: list[str], idle: int | None = None) -> DataFrame:
    """A stream (or table) of (req_id, seq, data binary, last boolean) to (req_id, text): what each batch adds to a request.

    With `idle`, a request that gets no token for so many milliseconds ends: what is held of it is sent, and its state goes. Such a stream runs a batch at
    every trigger, with or without data."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, stopped = state.get if state.exists else (b"", False)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"req_id": [key[0]], "text": [emitted(bytes(held), stopped, b"", stops, True)[0]]})
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        parts = []
        for data, last in zip(rows["data"], rows["last"]):
            text, held, stopped = emitted(bytes(held), stopped, bytes(data), stops, bool(last))
            parts.append(text)
        if bool(rows["last"].any()):
            if state.exists:
                state.remove()
        else:
            state.update((held, stopped))
            if idle is not None:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame({"req_id": [key[0]], "text": ["".join(parts)]})

    return tokens.groupBy("req_id").applyInPandasWithState(each, "req_id long, text string", "held binary, stopped boolean", "append", GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout)
