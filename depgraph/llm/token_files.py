"""Token counts of documents in flat token files that have no index.

A token file is a run of fixed-width token numbers; an end-of-document number closes each document.
Tasks read files as raw blocks of equal size, cut anywhere, each from its own place in the file.  Each block is searched for end numbers
in one vector operation; it reports its length and the places it found.  A prefix scan over the
blocks of a file gives every block its offset, the number of documents before it and the place of the
last end before it, which stitches the documents that reach over block borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from depgraph.llm.common import prepare, text_tables
from depgraph.llm.scan import earlier_value
from depgraph.operators.ranking import running_total
from depgraph.session import materialize, new_path
from depgraph.sources.byte_files import byte_blocks, listed_files, place

BLOCK_BYTES = 1 << 20
TABLE_BYTES = 4 << 20
#: Vocabulary of ranks (one token and its number a line) and the pattern that cuts texts for it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, pattern: str):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class TokenFiles:
    """files: file, bytes of the flat files written; names: file, first (place of the first document) and doc_ids of
    stretches of documents in the order of the file, to check results with; the search does not use them."""

    files: DataFrame
    names: DataFrame


def write_token_files(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END, leave_open: bool = False,
) -> TokenFiles:
    """Tokenizes the documents into one flat file for each task, below the shared folder: two bytes a token,
    little-endian, nothing else.

    An end number closes each document; with ``leave_open`` the last document of each file has none.  An end number
    within a text is ordinary text.  Null and empty texts are documents without tokens.

    A task writes to a file of its own name; the table of names, which Spark commits for one attempt of
    each task, says which files count.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, "rb") as lines:
        ranks = spark.sparkContext.broadcast(lines.read())
    folder = new_path(spark, "token-files")
    kind = docs.schema["doc_id"].dataType
    schema = StructType().add("file", "string").add("bytes", "long").add("first", "long").add("doc_ids", ArrayType(kind))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value, pattern)
        files, home = place(folder)
        files.create_dir(home, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        size, first, waiting, names = 0, 0, None, pa.null()  # every row names the file, so none has to look it up
        with files.open_output_stream(f"{home}/{name}") as out:
            for part in text_tables(batches, "text", TABLE_BYTES):
                names = part.column("doc_id").type
                stream = [] if waiting is None else [waiting]
                for text in part.column("text").to_pylist():
                    stream.append(np.array([*encoder.encode_ordinary(text or ""), end], dtype="<u2"))
                waiting = stream.pop() if stream else None  # the last one may stay open
                for tokens in stream:
                    out.write(tokens.tobytes())
                    size += tokens.nbytes
                yield pa.record_batch([
                    pa.array([name], pa.string()), pa.array([None], pa.int64()), pa.array([first], pa.int64()),
                    pa.array([part.column("doc_id").to_pylist()], pa.list_(names)),
                ], ["file", "bytes", "first", "doc_ids"])
                first += part.num_rows
            if waiting is not None:
                tokens = waiting[:-1] if leave_open else waiting
                out.write(tokens.tobytes())
                size += tokens.nbytes
        yield pa.record_batch([
            pa.array([name], pa.string()), pa.array([size], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.list_(names)),
        ], ["file", "bytes", "first", "doc_ids"])

    written = docs.select("doc_id", "text").mapInArrow(encode, schema)
    rows = materialize(written, "token-names").withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))
    return TokenFiles(
        rows.filter("bytes IS NOT NULL").select("file", "bytes"), rows.filter("first IS NOT NULL").select("file", "first", "doc_ids")
    )


def read_token_files(spark: SparkSession, path: str, token_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, data of flat token files in a folder that Spark can list and PyArrow can read.

    Bytes at the end that do not fill a token are dropped.
    """
    return token_blocks(listed_files(spark, path), token_bytes, block_bytes)


def token_blocks(files: DataFrame, token_bytes: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, data of the files (file, bytes), of any size, each read by many tasks."""
    whole = files.withColumn("bytes", F.col("bytes") - F.col("bytes") % token_bytes)
    return byte_blocks(whole, block_bytes // token_bytes * token_bytes)


def search_ends(blocks: DataFrame, ends: tuple[int, ...] = (END,), token_bytes: int = 2) -> DataFrame:
    """file, block, tokens (length) and found (places of end numbers in the block)."""
    kind = np.dtype(f"<u{token_bytes}")
    wanted = np.array(ends, dtype=kind)
    schema = StructType([blocks.schema["file"], blocks.schema["block"]]).add("tokens", "long").add("found", ArrayType(IntegerType()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for data in batch.column("data"):
                block = np.frombuffer(data.as_buffer(), dtype=kind) if data.is_valid else np.zeros(0, dtype=kind)
                hit = block == wanted[0] if len(wanted) == 1 else np.isin(block, wanted)
                lengths.append(len(block))
                found.append(pa.array(np.flatnonzero(hit), pa.int32()))
            yield pa.record_batch([
                batch.column("file"), batch.column("block"), pa.array(lengths, pa.int64()),
                pa.array(found, pa.list_(pa.int32())),
            ], ["file", "block", "tokens", "found"])

    return blocks.select("file", "block", "data").mapInArrow(search, schema)


def token_counts(blocks: DataFrame, ends: tuple[int, ...] = (END,), token_bytes: int = 2) -> DataFrame:
    """file, document (place in its file, from 0), start, n_tokens (without the end number) and closed.

    ``blocks``: file, block (0, 1, ... in order), data.  Consecutive ends are empty documents.  Tokens
    behind a file's last end are a document that is not closed; a file that ends with an end number, or
    is empty, has none.  Null data is an empty block; file and block must not be null, and a block must
    not be given twice.
    """
    prepare(blocks.sparkSession)
    found = materialize(search_ends(blocks, ends, token_bytes), "block-ends")
    placed = running_total(found, ["block"], "offset", F.col("tokens"), ["file"])
    placed = running_total(placed, ["block"], "documents", F.size("found").cast("long"), ["file"])
    last = F.when(F.size("found") > 0, F.col("offset") + F.element_at("found", -1) + 1)
    placed = materialize(earlier_value(placed, ["file"], ["block"], last, "open_since"), "placed-blocks")
    since = F.coalesce("open_since", F.lit(0).cast("long"))
    end = placed.select(
        "file", "offset", "documents", since.alias("since"), "found", F.posexplode("found").alias("i", "at")
    )
    start = F.when(F.col("i") == 0, F.col("since")).otherwise(
        F.col("offset") + F.get("found", F.col("i") - 1) + 1
    )
    closed = end.select(
        "file", (F.col("documents") + F.col("i")).alias("document"), start.alias("start"),
        (F.col("offset") + F.col("at") - start).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    files = placed.groupBy("file").agg(
        F.sum("tokens").alias("all"), F.sum(F.size("found")).alias("document"), F.max(F.coalesce(last, since)).alias("start")
    )
    rest = files.filter("`all` > start").select(
        "file", "document", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)


def document_names(names: DataFrame) -> DataFrame:
    """file, document, doc_id of files written by :func:`write_token_files`."""
    named = names.select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    return named.select("file", (F.col("first") + F.col("i")).alias("document"), "doc_id")


def named_counts(names: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens and closed of every document that ``names`` knows; one without a count has no tokens and is open.

    Both sides have a row for each document, out of arrays that Catalyst takes for a row a block: it would send millions of
    rows through the driver, so the join is told to sort.
    """
    named = document_names(names).join(counts.hint("merge"), ["file", "document"], "left")
    return named.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("closed", F.lit(False)).alias("closed"))
