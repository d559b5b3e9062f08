"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding. Every text is read in chunks of ``chunk_chars`` that overlap (a shorter one is one
chunk); each chunk is pre-tokenised on its own; where the pre-token boundaries of two neighbours meet in their
overlap both agree from there on, so the chunks are stitched at that place, and the pieces between stitches are encoded
one by one. Rows are encoded in parallel, a text within its own task. Decoding joins raw bytes.

Defined results: null and empty texts have an empty list of ids. Repeated rows give repeated rows. An empty
table gives no rows. Input columns other than the id and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrow import map_rows
from corvane.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
CHUNK_CHARS = 1_024
OVERLAP_CHARS = 128
#: Fixed value: the pre-tokenisation pattern of byte_bpe_50k.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
    """The tokenizer of ``name``, loaded once in each worker."""
    import tiktoken

    with (Path(directory) / f"{name}.tiktoken").open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str, at: int = 0) -> list[int]:
    """Ends of the pre-tokens of ``text``, counted from ``at``, where a cut changes neither side.

    How a run of white space splits depends on what follows it, so ends after white space are left out.
    """
    return [at + m.end() for m in _pattern().finditer(text) if not text[m.end() - 1].isspace()]


def pieces(text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[str]:
    """The pieces of a text between the stitches of its overlapping chunks.

    Every chunk is pre-tokenised on its own. A boundary that two neighbours share in their overlap is the stitch: the left
    chunk's boundaries are right from its own stitch on, except those of a pre-token that touches the chunk's end, since more
    text could lengthen it. Where no boundary is common the left chunk is read on over twice its length.
    """
    n = len(text)
    if n <= chunk_chars:
        return [text]
    cuts, begin, end = [0], 0, min(n, chunk_chars + overlap_chars)
    left = boundaries(text[:end])
    while end < n:
        start, stop = end - overlap_chars, min(n, end + chunk_chars)
        right = boundaries(text[start:stop], start)
        sure = {b for b in left if start < b < end - 2}
        common = next((b for b in right if b in sure), None)
        if common is None:
            end = min(n, end + max(chunk_chars, end - begin))
            left = boundaries(text[begin:end], begin)
        else:
            cuts.append(common)
            begin, end, left = common, stop, [b for b in right if b >= common]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, ids ARRAY<INT>)`` of every row: the ids of its pieces, one after the other. No row is shuffled by its text."""
    src = spread(docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(directory).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [[x for piece in pieces(t, chunk_chars, overlap_chars) for x in encode(piece)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["rid", "ids"])

    return src.mapInArrow(run, f"rid {src.schema['rid'].dataType.simpleString()}, ids array<int>").withColumnRenamed("rid", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, text)`` of encoded rows: the tokens' bytes joined and read as UTF-8. Null ids give null."""
    src = encoded.select(F.col(id_col).alias("rid"), F.col(ids_col).alias("ids"))
    out = map_rows(src, lambda rows: ((r["rid"], None if r["ids"] is None else encoder(directory).decode_bytes(r["ids"]).decode("utf-8", "replace")) for r in rows), f"rid {src.schema['rid'].dataType.simpleString()}, text string", 500)
    return out.withColumnRenamed("rid", id_col)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(id_col, n_tokens BIGINT)`` of every row, through the same encoding."""
    return token_ids(docs, id_col, text_col, directory=directory).select(id_col, F.size("ids").cast("long").alias("n_tokens"))
