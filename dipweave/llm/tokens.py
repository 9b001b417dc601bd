"""Sizes of texts in tokens of the public byte-level tokenizer of ByT5: one for each UTF-8 byte, special tokens not counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_tokens(text: Column) -> Column:
    """0 for NULL and for an empty text."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
