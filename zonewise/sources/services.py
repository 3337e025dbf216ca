"""Outside services (model, OCR, gazetteer) as tables of answers.

The engine reads answers from tables, so plans stay deterministic. ``ask`` fills
such a table: it makes the questions distinct, asks each once with pauses and
retries, and keeps failures as rows. The client is a function from question to
answer that the caller brings.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.patterns import TRANSIENT_MARKERS
from ..runtime import ship

#: Seconds between calls, attempts, and the first wait, which doubles each time.
PAUSE, ATTEMPTS, FIRST_WAIT = 2.5, 4, 4.0


def is_transient(error: BaseException) -> bool:
    text = str(error).lower()
    return any(m in text for m in TRANSIENT_MARKERS)


def with_retry(call: Callable, *args, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep):
    """The call's result; passing failures are tried again after growing waits, others and the last one are raised."""
    for attempt in range(attempts):
        try:
            return call(*args)
        except Exception as e:
            if attempt == attempts - 1 or not is_transient(e):
                raise
            sleep(first_wait * 2**attempt)


def ask(questions: DataFrame, client: Callable[[str], str | None], column: str = "query", lanes: int = 1, pause: float = PAUSE, attempts: int = ATTEMPTS, first_wait: float = FIRST_WAIT) -> DataFrame:
    """column, answer and failed (the error's text) for each distinct question.

    ``lanes`` tasks ask at a time, each with its own pauses; write the result
    before use, or a lost task asks again.
    """
    ship(questions.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = False
        for frame in frames:
            out = []
            for question in frame[column]:
                if asked:
                    time.sleep(pause)
                asked = True
                try:
                    out.append((question, with_retry(client, question, attempts=attempts, first_wait=first_wait), None))
                except Exception as e:
                    out.append((question, None, str(e)))
            yield pd.DataFrame(out, columns=[column, "answer", "failed"], dtype=object)

    return questions.select(column).where(f"{column} IS NOT NULL").distinct().repartition(lanes, column).mapInPandas(run, f"{column} string, answer string, failed string")
