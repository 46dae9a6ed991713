"""Cross-topic SQL (Q5): a topic's SQL may read another topic's table.

In the reference all topics share one SQL context, so at a firing time
``T`` another topic's table holds that topic's latest non-empty window: one
ending at or before ``T`` if that topic fires earlier in the channel's
order, strictly before ``T`` if it fires later. Here each window of the
reading topic gets the end of the window it sees (an as-of lookup on the
two window lists), and the other topic's rows are tagged with the reader's
window, so its CTE is bound to the same column as the reader's own.
When the other topic has no such window the table is empty.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .asof import asof_latest
from .topicsql import OtherTopic
from .windows import WINDOW_END, WINDOW_START


def referenced_topics(ql: str, names) -> list[str]:
    """Topic names that appear as words in the SQL text (case-insensitive)."""
    return [n for n in names if re.search(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", ql, re.I)]


def windows_with_views(rows: DataFrame, others: list[tuple[str, DataFrame, bool]]):
    """The reading topic's window list plus, per other topic, its rows as the reader sees them.

    ``others``: ``(name, windowed rows, fires_earlier)``. The as-of map (one row per window of the
    reader) is joined to the other topic's rows first, so both tables carry the reader's
    ``window_end``: every join of the topic's SQL then has it among its keys, and a row of the other
    topic is there once per reader window that sees it.
    """
    wins = rows.select(WINDOW_START, WINDOW_END).distinct()
    refs = []
    for name, orows, earlier in others:
        seen = asof_latest(wins.select(WINDOW_END), WINDOW_END, orows.select(WINDOW_END).distinct(), WINDOW_END, "__seen",
                           inclusive=earlier).filter("__seen IS NOT NULL")
        visible = orows.drop(WINDOW_START).withColumnRenamed(WINDOW_END, "__seen").join(seen, "__seen").drop("__seen")
        refs.append(OtherTopic(name, visible))
    return wins, refs
