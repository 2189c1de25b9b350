"""Token counts with a whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.pretokens import words
from llm.shared import byte_lengths


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``path`` is the file of a lower-casing BPE tokenizer with word ends. Vocabulary strings that encode
    alone as one token are proven once per worker; pre-tokens among them count as one and the library
    merges only the rest. A narrow job: no shuffle; memory is one batch and a bounded word table.

    Null text counts as empty (0 bytes, 0 tokens); a null doc_id and repeated rows stay as they are;
    further columns are ignored; an empty table gives no rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(path)
        for batch in batches:
            for part, ids in table.ids(batch):
                n = [sum(map(len, text)) // 4 for text in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), byte_lengths(part.column("text")), pa.array(n, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
