"""Models and readers the pipelines call out to, as column-to-column providers with deterministic stand-ins.

A provider is any function from a pandas Series to a pandas Series; `apply` runs it once per distinct input over Arrow
batches and joins the answers back, so repeated inputs are paid for once. The stand-ins need no network and no model.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

DIMENSIONS = 64
#: As many inputs at most are with a provider at once.
SOME = 256


def apply(df: DataFrame, column: str, out: str, provider: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """df with `out`: the provider's answer to each distinct value of `column`. A null input is not sent and gives null.

    Values are told apart by their SHA-256, so answers come back by a short key and no text is shuffled to be joined. The
    provider gets SOME inputs at a time, whatever a batch holds.
    """
    there = to_arrow_type(DataType.fromDDL(kind))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SOME):
                some = batch.slice(i, SOME)
                answers = pa.array(provider(some.column(1).to_pandas()).tolist(), there, from_pandas=True)
                yield pa.RecordBatch.from_arrays([some.column(0), answers], ["__key", out])

    key = F.sha2(F.col(column), 256)
    asked = df.where(F.col(column).isNotNull()).groupBy(key.alias("__key")).agg(F.first(column).alias("__asked"))
    answers = asked.mapInArrow(run, f"__key string, `{out}` {kind}")
    return df.withColumn("__key", key).join(answers, "__key", "left").drop("__key")


def each(df: DataFrame, column: str, out: str, provider: Callable[[pd.Series], pd.Series], kind: str) -> DataFrame:
    """As apply, for rows whose values are distinct already: each is sent where it is, and nothing is shuffled."""
    schema = StructType([*df.schema.fields, StructField(out, DataType.fromDDL(kind))])
    there = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, SOME):
                some = batch.slice(i, SOME)
                values = some.column(some.schema.get_field_index(column))
                answers = iter(provider(values.drop_null().to_pandas()).tolist())
                found = pa.array([next(answers) if x else None for x in values.is_valid().to_pylist()], there.field(out).type, from_pandas=True)
                yield pa.RecordBatch.from_arrays([*some.columns, found], names=there.names)

    return df.mapInArrow(run, schema)


def embed(texts: pd.Series) -> pd.Series:
    """Hashed bags of words of unit length. Where all words' signs cancel, they count without signs; no words give zeros."""

    def one(text: str) -> list[float]:
        v = np.zeros(DIMENSIONS)
        hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in re.findall(r"\w+", (text or "").lower())]
        for h in hashes:
            v[h % DIMENSIONS] += 1 if h >> 63 else -1
        if not v.any():
            for h in hashes:
                v[h % DIMENSIONS] += 1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return texts.map(one)


def generate(prompts: pd.Series) -> pd.Series:
    """The prompt's first sentence."""
    return prompts.map(lambda p: re.split(r"(?<=[.!?])\s", (p or "").strip(), maxsplit=1)[0])


def _relations(text: str) -> list[tuple[str, str, str]]:
    """Subject, predicate and object of every two capitalised words in a row of a sentence, related by the words between."""
    out = []
    for sentence in re.split(r"[.!?\n]+", text):
        names = [m for m in re.finditer(r"\b\w\w+\b", sentence) if m[0][0].isupper()]
        out += [(a[0], sentence[a.end() : b.start()].strip() or "rel", b[0]) for a, b in zip(names, names[1:])]
    return out


def extract(chunks: pd.Series) -> pd.Series:
    """Triples as JSON: every two capitalised words in a row of a sentence, related by the words between."""
    return chunks.map(lambda text: json.dumps([dict(zip(("subject", "predicate", "object"), r)) for r in _relations(text or "")], ensure_ascii=False))


def subgoals(questions: pd.Series) -> pd.Series:
    """Sub-goals: every sentence of a question, and after it what the sentence relates, unless that is the whole sentence."""

    def one(text: str) -> list[str]:
        out = []
        for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s|\n", text or ""))):
            said = [" ".join(r) for r in _relations(sentence)]
            out += [sentence, *(said if said != [sentence.rstrip(".!?")] else [])]
        return out

    return questions.map(one)


def judge(pairs: pd.Series) -> pd.Series:
    """0, 1 or 2 by how much of the first line's words the rest has."""

    def one(text: str) -> int:
        first, _, rest = (text or "").partition("\n")
        a, b = set(first.lower().split()), set(rest.lower().split())
        return int(min(2, 3 * len(a & b) // max(1, len(a))))

    return pairs.map(one)


def pages_of(files: DataFrame, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_number, text) of binaryFile rows (path, content). Without a reader, form feeds part the pages of a text."""
    read = reader or (lambda data: data.decode("utf-8", "replace").split("\f"))

    def run(batches):
        for b in batches:
            rows = [(p, i, t) for p, c in zip(b["path"], b["content"]) for i, t in enumerate(read(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number long, text string")
