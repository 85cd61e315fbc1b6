"""Conversation windows with a rolling summary: the last turns are held whole, older ones are
handed to the summary in steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling(turns: DataFrame, keep: int, every: int) -> DataFrame:
    """conv_id, turn, summary_upto, held of (conv_id, turn): after each turn, how many turns the
    summary covers (a multiple of `every`, never one of the last `keep`) and how many are held."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    upto = F.floor(F.greatest(n - keep, F.lit(0)) / every) * every
    return turns.select("conv_id", "turn", upto.cast("long").alias("summary_upto"), (n - upto).cast("long").alias("held"))


def rolling_stream(turns: DataFrame, keep: int, every: int) -> DataFrame:
    """The same for a stream of (conv_id, turn, text), with `left`: the texts that this turn handed
    to the summary. State holds the texts in the window, not the conversation.

    Turns of a conversation have to arrive in order across micro-batches.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        upto, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for turn, text in pd.concat(list(parts)).sort_values("turn")[["turn", "text"]].itertuples(index=False):
            held.append(text)
            left: list[str] = []
            while len(held) >= keep + every:
                left, held, upto = [*left, *held[:every]], held[every:], upto + every
            out.append((key[0], turn, upto, len(held), left))
        state.update((upto, held))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "summary_upto", "held", "left"])

    rows = turns.select("conv_id", "turn", "text").groupBy("conv_id")
    return rows.applyInPandasWithState(run, "conv_id long, turn long, summary_upto long, held long, left array<string>", "upto long, held array<string>", "append", "NoTimeout")
