"""What the operators for training corpora share: Arrow buffers, words, the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.shared import few_rows, shared_path, written

__all__ = ["NULL_ID", "SPACES", "WORD", "buffers", "column", "few_rows", "id_back", "is_space", "keyed", "lower_ascii", "ranges", "shared_path", "slices", "word_bounds", "written"]

#: White space between words, as in the class [\x20\x09-\x0D].
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null identifier inside plans that partition by it.
NULL_ID = -(2**63)

def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(k, text) of documents and what more there is to select; null identifiers and texts get NULL_ID and ''."""
    few_rows(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *more,
    )


def id_back(col: str = "k", name: str = "doc_id"):
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias(name)


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (n + 1) and bytes of a string or binary column, null as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if not len(at):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Parts of a batch whose texts have about `limit` bytes, one row at least."""
    at, _ = buffers(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_bounds(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words in concatenated texts, and the number of each text's first word (n + 1)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~is_space(data)
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    edges = at[(at > 0) & (at < len(data))]
    begin[edges] = inside[edges + 1]
    end[edges - 1] = inside[edges]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(begin, at, "left")


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
