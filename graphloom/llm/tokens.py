"""Token ids and token counts of whole tables of texts (problem 6)."""

from __future__ import annotations

import gc
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe_transducer import default_vocabulary, encoder
from graphloom.session import spread_input


def _map_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None, result: str, make: Callable) -> DataFrame:
    path = vocabulary or default_vocabulary()
    source = spread_input(df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            collecting = gc.isenabled()
            gc.disable()  # millions of small tuples without cycles
            try:
                column = make(enc, batch.column(1).to_pylist())
            finally:
                if collecting:
                    gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=[id_col, result])

    return source.mapInArrow(run, f"`{id_col}` {kind}, {result} " + ("array<int>" if result == "ids" else "bigint"))


def _ids(enc, texts: list) -> pa.Array:
    flat, ends = array("i"), [0]
    for text in texts:
        flat.extend(enc.encode(text))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)) if flat else pa.array([], pa.int32()))


def _counts(enc, texts: list) -> pa.Array:
    return pa.array([len(enc.encode(t)) for t in texts], pa.int64())


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the ids of each text by a byte-level BPE vocabulary, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are ordinary text. Texts are
    read whole, however long; a row is encoded on its own, so there is no shuffle. Repeated rows and
    null ids come out as they came in. vocabulary is the path of a .tiktoken file.
    """
    return _map_texts(df, id_col, text_col, vocabulary, "ids", _ids)


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens): the number of ids encode_texts gives; 0 for null and empty texts."""
    return _map_texts(df, id_col, text_col, vocabulary, "n_tokens", _counts)


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocabulary: str | None = None) -> DataFrame:
    """(id, text): the text of each list of ids; '' of null and of the empty list. Unknown ids raise."""
    path = vocabulary or default_vocabulary()
    source = df.select(F.col(id_col), F.col(ids_col))
    kind = source.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = pa.array([enc.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, text string")
