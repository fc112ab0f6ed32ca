"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary, a file of token ranks; a parameter of all operators here.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published splitting pattern of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut where a run of letters or digits ends, which no token spans.
SEGMENT = 50_000

_RUN_END = regex.compile(r"\p{L}(?!\p{L})|\p{N}(?!\p{N})")
_ENCODINGS: dict = {}


def encoding(path: str = VOCABULARY, content: bytes | None = None):
    """The tokenizer, made once a worker, from the file at ``path`` or its content."""
    if path not in _ENCODINGS:
        import tiktoken

        if content is None:
            with open(path, "rb") as file:
                content = file.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def segments(text: str, size: int = SEGMENT):
    """Parts of a long text whose tokens are those of the whole.

    A cut lies where a run of letters or of digits ends, as the splitting
    pattern ends a piece there whatever follows; a run is never cut, however long it is.
    """
    at = 0
    while len(text) - at > size:
        end = _RUN_END.search(text, at + size - 1)
        if not end or end.end() == len(text):
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def count(text: str | None, path: str = VOCABULARY, content: bytes | None = None) -> int:
    if not text:
        return 0
    encode = encoding(path, content).encode_ordinary
    if len(text) <= SEGMENT:
        return len(encode(text))
    return sum(len(encode(part)) for part in segments(text))


def document_tokens(df: DataFrame, *keep: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, kept columns), one row a document id; null texts have 0 tokens.

    The vocabulary file is read by the driver and sent to the executors, about a
    megabyte. One narrow pass counts; only the counts are shuffled to take each id once
    (of rows with the same id the one with most tokens stands).
    """
    fields = [f"keep{i}" for i in range(len(keep))]
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(c.alias(f) for c, f in zip(keep, fields)))

    with open(vocabulary, "rb") as file:
        held = df.sparkSession.sparkContext.broadcast(file.read())

    def sizes(batches):
        for batch in batches:
            n = [count(t, vocabulary, held.value) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(n, pa.int64()), *(batch.column(i) for i in range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *fields])

    kinds = dict(src.dtypes)
    schema = ", ".join([f"doc_id {kinds['doc_id']}", "n_tokens long", *(f"{f} {kinds[f]}" for f in fields)])
    counted = src.where(F.col("doc_id").isNotNull()).mapInArrow(sizes, schema)
    best = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", *fields)).alias("best"))
    return best.select("doc_id", "best.n_tokens", *(f"best.{f}" for f in fields))
