"""Token ids of whole texts, in Arrow batches. Vocabularies are read by path and never trained."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import slices, whole_text

SCHEMA = "part int, local_start long, doc_id long, n_tokens long, ids binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str, encode_special_tokens: bool = False):
    """text -> list of ids, equal to tokenizers.Tokenizer.from_file(path) with add_special_tokens=False.

    The merges of a byte-level BPE file are ranks in id order, so tiktoken can run the same
    vocabulary; it takes about a fifth of the time here. encode_special_tokens is the library's
    setting of that name: False, which a loaded file has, gives strings of added tokens their id,
    so texts that hold one go through the library itself; True takes them as ordinary text.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # fixed values: the bytes that byte-level vocabularies show as themselves
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(printable))}
    raw = {c: b for b, c in shown.items()}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(raw[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    ordinary = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if encode_special_tokens or not special:
        return ordinary
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def encode(text: str) -> list[int]:
        return library.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else ordinary(text)

    return encode


def tokenise(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, encode_special_tokens: bool = False) -> DataFrame:
    """One row per document: its ids as little-endian unsigned 16-bit values, then end_id.

    part is the task that read the row and local_start the number of ids before the row in
    that task, the first half of a two-pass prefix sum. Null texts count as empty and have
    end_id alone; a null doc_id stays null; repeated rows are separate documents.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = encoder(path, encode_special_tokens), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text"):
                ids = [np.array([*encode(t), end_id], "<u2") for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), piece.column(0), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    ["part", "local_start", "doc_id", "n_tokens", "ids"],
                )
                before = int(ends[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCHEMA)
