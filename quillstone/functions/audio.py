"""Recordings to text: a pluggable transcriber behind the checks of size and kind."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.text import magic

#: Contents and kinds (see ``text.magic``) of some recordings to their texts.
Transcriber = Callable[[list[bytes], list[str]], list[str]]

#: A recording of fewer bytes is not sent, and the texts that stand for failures. Fixed values.
LEAST_BYTES = 800
TOO_SHORT = "⚠️ I could not read the audio (empty/too short). Please record again."
FAILED = "⚠️ The audio could not be transcribed."


def transcribed(content: Column, transcriber: Transcriber) -> Column:
    """The text of each recording. Null and short ones are TOO_SHORT and never reach the transcriber; rows of a batch that it fails on are FAILED."""

    def texts(contents: pd.Series, kinds: pd.Series) -> pd.Series:
        sent = contents.notna()
        out = pd.Series([None] * len(contents), index=contents.index, dtype=object)
        if sent.any():
            try:
                out[sent] = transcriber(list(contents[sent]), list(kinds[sent]))
            except Exception:  # noqa: BLE001 - a model may fail in any way; a batch of questions goes on
                out[sent] = FAILED
        return out

    enough = F.octet_length(content) >= LEAST_BYTES
    made = F.pandas_udf(texts, "string")(F.when(enough, content), magic(content))
    return F.when(F.coalesce(enough, F.lit(False)), made).otherwise(TOO_SHORT)
