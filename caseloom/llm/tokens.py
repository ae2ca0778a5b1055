"""Token counts with a public tokenizer's vocabulary file.

The file's path is a parameter; the file itself is read on each worker and
never stored in the repository.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseloom.session import spread

from .batches import slices

#: Where vocabulary files are looked for unless a path is given.
FOLDER = os.environ.get("CASELOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def path_of(name: str = DEFAULT) -> str:
    return name if os.path.sep in name else os.path.join(FOLDER, name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each whole text; null counts nothing."""
    encode = encoding(path).encode_ordinary
    return [len(encode(x)) if x else 0 for x in texts]


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = DEFAULT, keep_text: bool = False) -> DataFrame:
    """The frame with the tokens of its text; the text itself is dropped unless kept."""
    path = path_of(tokenizer)
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                n = pa.array(count(batch.column(text).to_pylist(), path), pa.int64())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], n], names=[*names, out])

    return spread(df).mapInArrow(run, schema)
