"""Token counts with the whole-token shortcut.

Which vocabulary strings stand alone as one token is proven offline, once for each worker, by
encoding every one of them (``tokens._whole_tokens``).  A chunk (a text is cut before spaces) that is such a string counts
as one; only the rest is cut into pre-tokens and merged, each of a batch's distinct chunks once.  One pass over the
texts, no shuffle.

Null and empty texts count 0.  Repeated rows and other columns are kept; columns of the names
that the operator adds are replaced.  An empty table gives an empty one; long texts need no more than themselves
and their distinct chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, fitted, frugal, size_of, table

LIMIT = 512
ADDED = ("n_bytes", "n_tokens", "over_limit")


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """df and n_bytes, n_tokens, over_limit of its column ``text``; tokenizer: a .json file's path."""
    bounded_batches(df.sparkSession)
    kept = df.drop(*(c for c in ADDED if c != text))
    schema = T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        from .tokens import encoder

        coder = encoder(tokenizer)
        for b in batches:
            texts = b.column(text)
            n = coder.count(texts)
            size = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(n, pa.int64()), pa.array(np.asarray(n) > limit)], [*b.schema.names, *ADDED])

    return fitted(kept, 4 * size_of(kept)).mapInArrow(frugal(run), schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", *ADDED)
