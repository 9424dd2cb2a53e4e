"""Narrative text to terms."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..config import REDACTION_TOKENS

# A word is a run of two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


FOREIGN = re.compile(r"[^\x00-\x7F]+")


def _plain(run: re.Match) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", run[0]) if not unicodedata.combining(c))


@F.arrow_udf(StringType())
def _decompose(texts: pa.Array) -> pa.Array:
    # Only the non-ASCII runs of a text are touched; ASCII neighbours never change under NFKD. Few texts are Python's at once.
    parts = [
        pa.array([t and FOREIGN.sub(_plain, t) for t in texts.slice(low, 256).to_pylist()], texts.type)
        for low in range(0, len(texts), 256)
    ]
    return pa.concat_arrays(parts) if parts else texts


def strip_accents(column: Column) -> Column:
    """Drop accents. Only texts with non-ASCII characters are sent to Python."""
    foreign = F.when(column.rlike(r"[^\x00-\x7F]"), column)
    return F.coalesce(_decompose(foreign), column)


def with_terms(df: DataFrame, text: str, name: str = "terms") -> DataFrame:
    """Add the lower-cased words and word pairs of a text, redaction markers removed first."""
    found = F.regexp_extract_all(strip_accents(F.lower(F.col(text))), F.lit(WORD), F.lit(0))
    words = df.withColumn("_words", F.filter(found, lambda w: ~w.isin(*REDACTION_TOKENS)))
    following = F.slice("_words", F.lit(2), F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = F.filter(
        F.zip_with("_words", following, lambda a, b: F.concat(a, F.lit(" "), b)),
        lambda pair: pair.isNotNull(),
    )
    return words.withColumn(name, F.concat("_words", pairs)).drop("_words")
