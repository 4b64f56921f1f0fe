"""Table functions for SQL over partitioned, ordered tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

#: Turns before an answer that it is seen with.
HISTORY = 3


@F.udtf(returnType="conv_id long, turn long, n_history int, history string, answer string")
class DialogueWindows:
    """Of conversations, by turn: each assistant's turn with the turns before it, at most ``HISTORY``, whatever the conversation's length."""

    def __init__(self) -> None:
        self.before: deque[str] = deque(maxlen=HISTORY)

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["role"] == "assistant":
            yield row["conv_id"], row["turn"], len(self.before), "\n".join(self.before), row["text"]
        self.before.append(row["text"] or "")


@F.udtf(returnType="key string, start int, n_tokens int, text string")
class TokenWindows:
    """Of one text: windows of ``size`` words, each ``step`` words after the one before it; the last may be shorter."""

    def eval(self, key: str, text: str, size: int, step: int) -> Iterator[tuple]:
        words = (text or "").split()
        for start in range(0, len(words), max(step, 1)):
            own = words[start : start + size]
            yield key, start, len(own), " ".join(own)
            if start + size >= len(words):
                break


def register(spark: SparkSession) -> None:
    """Make ``dialogue_windows`` and ``token_windows`` known to SQL."""
    spark.udtf.register("dialogue_windows", DialogueWindows)
    spark.udtf.register("token_windows", TokenWindows)
