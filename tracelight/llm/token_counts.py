"""Token counts at every prefix, and the truncation and budget questions they answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm._common import small_batches
from tracelight.llm.bpe import prefix_counts


def token_prefix_index(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_chars``, ``n_tokens``, ``prefix_steps``.

    ``prefix_steps`` has one signed byte per character of the text: the change of the exact token
    count from one prefix to the next. Its running sum is the count at every prefix, so a truncation
    or a budget is answered from it without encoding again (``tokens_at``, ``longest_within``).
    Null and empty texts have no steps and 0 tokens; each row is handled alone, so repeated rows and
    null ids come out as they went in, and further columns are ignored. No shuffle."""
    small_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_steps", T.BinaryType())])

    def index(batches):
        table = prefix_counts(tokenizer_path)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                steps = [table.steps(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array([len(s) for s in steps], pa.int64()),
                        pa.array([int(s.sum(dtype=np.int64)) for s in steps], pa.int64()),
                        pa.array([s.tobytes() for s in steps], pa.binary()),
                    ],
                    names=schema.fieldNames(),
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(index, schema)


@F.pandas_udf(T.LongType())
def tokens_at(steps: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Token count of the first ``n_chars`` characters."""
    return pd.Series([int(np.frombuffer(s, np.int8)[: max(int(n), 0)].sum(dtype=np.int64)) for s, n in zip(steps, n_chars)], dtype="int64")


@F.pandas_udf(T.LongType())
def longest_within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Length in characters of the longest prefix of at most ``budget`` tokens (counts may fall as a prefix grows)."""
    out = []
    for s, most in zip(steps, budget):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(s, np.int8), dtype=np.int64) <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int64")
