"""Tokenizers that can be exchanged: each turns a text into a list of tokens and back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Words:
    """Runs of non-space characters; decoding puts one space between."""

    def encode(self, text) -> Column:
        return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")

    def decode(self, tokens) -> Column:
        return F.array_join(tokens, " ")


class Vocabulary:
    """A tokenizer of a vocabulary file, run over Arrow batches. `load` makes it from the path, once a worker, and gives its encode and decode."""

    def __init__(self, path: str, load: Callable[[str], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]]):
        self.path, self.load, self._made = path, load, None

    def _both(self):
        if self._made is None:
            self._made = self.load(self.path)
        return self._made

    def __getstate__(self):
        return {"path": self.path, "load": self.load, "_made": None}

    def encode(self, text) -> Column:
        return F.pandas_udf(lambda s: pd.Series([list(self._both()[0](x or "")) for x in s]), "array<int>")(text)

    def decode(self, tokens) -> Column:
        return F.pandas_udf(lambda s: pd.Series([self._both()[1]([] if x is None else [int(i) for i in x]) for x in s]), "string")(tokens)


def windows(tokenizer, text, size: int, overlap: int) -> Column:
    """A text as decoded windows of `size` tokens, each beginning `size - overlap` after the one before; none without tokens."""
    tokens = tokenizer.encode(text)
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / (size - overlap))).cast("int")
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * (size - overlap) + 1, size))).otherwise(F.array())
