"""Token counts of whole texts by a compiled finite-state transducer (:mod:`.transducer`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prosemetrics.llm.arrow import slabs

SLAB_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: one row for every row of ``docs``.

    ``tokenizer`` is the file of a byte-level BPE vocabulary, by path or by the name of a public
    one; each Python worker compiles it as it goes.  No token is added; the vocabulary's special
    strings count one token each where a text holds them, as the library does by default.

    Defined cases: a null text is an empty one (0 bytes, 0 tokens); null and repeated ids stay as
    they are; other columns are not read; an empty table gives no rows.  Long texts are counted
    whole, in pieces between which no token can reach.  No shuffle.
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from prosemetrics.llm.transducer import compiled

        machine = compiled(tokenizer_path(tokenizer))
        for batch in batches:
            n_bytes = np.zeros(batch.num_rows, dtype=np.int64)
            n_tokens = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, data, offsets in slabs(batch.column(1), SLAB_BYTES):
                np.add.at(n_bytes, rows, np.diff(offsets))
                np.add.at(n_tokens, rows, machine.count(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(count, schema)
