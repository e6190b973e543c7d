"""Stupid-backoff scores of documents against the rest of the corpus, from full n-gram counts.

1. Documents are packed into chunks: word codes, the stream of words, document lengths.
2. Each chunk lists its distinct n-grams of every order with their counts; the lists are dealt to
   hash buckets.  A bucket adds up the counts of all chunks (the count table of its n-grams) and
   answers each list with the totals.
3. The answers come back to the chunk, are joined to its n-grams and summed for each document.

Lists travel as sorted fingerprints, stored as differences, so that a frequent n-gram costs one entry
a chunk however often it occurs.  All n-grams are counted, none is cut off.  Fingerprints have 24 bits
more than it takes to number all n-grams (and 52 at least), so the chance that an n-gram shares its
fingerprint with another stays below one in ten million at any size, until 64 bits are reached.

A document's own occurrences are taken off every count before it is scored, else each n-gram would
have been seen and no score would ever back off.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from depgraph.llm.common import Numbers, prepare, text_tables
from depgraph.session import materialize, new_path

ORDER = 3
#: Factor of each step back to a shorter history.
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20
#: Entries that a hash bucket holds on average.
BUCKET_ENTRIES = 2_000_000
#: Words of a chunk that are scored at a time.
SLICE_WORDS = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(values: np.ndarray) -> bytes:
    """Values as byte planes, compressed: equal high bytes cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, lengths, codes (of the chunk's distinct words), words (numbers of the codes)."""
    schema = StructType().add("chunk", "string").add("doc_ids", ArrayType(docs.schema["doc_id"].dataType))
    schema = schema.add("lengths", "binary").add("codes", "binary").add("words", "binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(text_tables(batches, "text", CHUNK_BYTES)):
            seen = Numbers()
            streams = []
            for text in part.column("text").to_pylist():
                words = text.encode().lower().split() if text else []
                streams.append(np.fromiter(map(seen.__getitem__, words), dtype=np.uint32, count=len(words)))
            codes = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), dtype=np.uint64, count=len(seen))
            codes, rank = np.unique(codes, return_inverse=True)
            stream = rank.astype(np.uint32)[np.concatenate(streams)]
            lengths = np.array(list(map(len, streams)), dtype=np.int64)
            names = part.column("doc_id")
            yield pa.record_batch([
                pa.array([f"{task}-{number}"]), pa.array([names.to_pylist()], pa.list_(names.type)),
                pa.array([_squeeze(lengths)], pa.binary()), pa.array([_squeeze(np.diff(codes, prepend=np.uint64(0)))], pa.binary()),
                pa.array([_squeeze(stream)], pa.binary()),
            ], ["chunk", "doc_ids", "lengths", "codes", "words"])

    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def _stir(mark: np.ndarray, shift: int) -> None:
    mark ^= mark >> np.uint64(shift)
    mark *= _MULTIPLIER


def _stored_by_chunk(chunks: DataFrame) -> tuple[DataFrame, str]:
    """The chunks as a table bucketed by their name, so that the answers come to them and they never move; its name
    in the catalog."""
    spark = chunks.sparkSession
    name = f"lm_chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = chunks.write.format("parquet").bucketBy(parts, "chunk").option("path", new_path(spark, "lm-chunks"))
    writer.saveAsTable(name)
    return spark.table(name), name


def _ngrams(size: np.ndarray, codes: bytes, words: bytes, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, one after the other, the place of every n-gram's last word and its fingerprint."""
    code = np.cumsum(_unsqueeze(codes, np.uint64), dtype=np.uint64)[_unsqueeze(words, np.uint32)]
    place = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            at = np.flatnonzero(place >= n - 1).astype(np.int32)
            mark = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                _stir(mark, 29)
                mark += code[at - (n - 1 - k)]
            _stir(mark, 32)
            mark ^= mark >> np.uint64(29)
            mark >>= np.uint64(64 - bits)
            yield at, mark


def _lists(chunks: DataFrame, order: int, bits: int, buckets: int) -> DataFrame:
    """bucket, chunk, n, marks, times: the distinct n-grams of every chunk with their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = _unsqueeze(row["lengths"], np.int64)
                for n, (_, mark) in enumerate(_ngrams(size, row["codes"], row["words"], order, bits), 1):
                    own, times = np.unique(mark, return_counts=True)
                    bucket = ((own >> np.uint64(bits - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                    edge = np.searchsorted(bucket, np.arange(buckets + 1))
                    out = {"bucket": [], "chunk": [], "n": [], "marks": [], "times": []}
                    for b in np.flatnonzero(np.diff(edge)).tolist():
                        part = slice(edge[b], edge[b + 1])
                        out["bucket"].append(b)
                        out["chunk"].append(row["chunk"])
                        out["n"].append(n)
                        out["marks"].append(_squeeze(np.diff(own[part], prepend=np.uint64(0))))
                        out["times"].append(_squeeze(times[part].astype(np.uint32)))
                    yield pa.record_batch([
                        pa.array(out["bucket"], pa.int64()), pa.array(out["chunk"], pa.string()), pa.array(out["n"], pa.int64()),
                        pa.array(out["marks"], pa.binary()), pa.array(out["times"], pa.binary()),
                    ], list(out))

    return chunks.select("chunk", "lengths", "codes", "words").mapInArrow(
        deal, "bucket long, chunk string, n long, marks binary, times binary"
    )


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals over all chunks for every list of a bucket, in the order of the list."""
    out = []
    for n, own in rows.groupby("n"):
        marks = [np.cumsum(_unsqueeze(m, np.uint64), dtype=np.uint64) for m in own["marks"]]
        times = np.concatenate([_unsqueeze(t, np.uint32) for t in own["times"]])
        names, which = np.unique(np.concatenate(marks), return_inverse=True)
        totals = np.bincount(which, weights=times, minlength=len(names)).astype(np.uint64)[which]
        parts = np.split(totals, np.cumsum(list(map(len, marks)))[:-1])
        out.append(pd.DataFrame({
            "chunk": own["chunk"], "bucket": own["bucket"], "n": n, "totals": list(map(_squeeze, parts)),
        }))
    return pd.concat(out)


def _score(chunk: pd.DataFrame, answers: pd.DataFrame, order: int, bits: int, words_of_all: int) -> pd.DataFrame:
    """Log scores of the documents of a chunk."""
    row = chunk.iloc[0]
    size = _unsqueeze(row["lengths"], np.int64)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    logs, before = np.zeros(len(doc)), np.zeros(len(doc))
    full = np.zeros(len(doc), dtype=bool)
    ends = np.cumsum(size)
    parts_of_chunk = np.flatnonzero(np.diff(ends // SLICE_WORDS, append=-1))  # documents that end a slice
    docs_edge = np.concatenate([[0], ends[parts_of_chunk]])
    for n, (at, mark) in enumerate(_ngrams(size, row["codes"], row["words"], order, bits), 1):
        seen = np.zeros(len(doc))  # occurrences elsewhere of the n-gram that ends here
        if len(at):
            parts = answers[answers["n"] == n].sort_values("bucket")["totals"]
            totals = np.concatenate([_unsqueeze(t, np.uint64) for t in parts]).astype(np.float64)
            which = np.unique(mark, return_inverse=True)[1]
            del mark
            for low in range(0, len(docs_edge) - 1):
                a, b = np.searchsorted(at, docs_edge[low:low + 2])
                pair = which[a:b] * len(size) + doc[at[a:b]]
                _, own, times = np.unique(pair, return_inverse=True, return_counts=True)
                seen[at[a:b]] = totals[which[a:b]] - times[own]
            del which, totals
        found = seen[at] > 0
        if n == 1:
            rest = (words_of_all - size)[doc].astype(np.float64)
            logs[at] = np.where(found, np.log(np.maximum(seen[at], 1) / np.maximum(rest, 1)), -np.log(rest + 1))
        else:
            ratio = np.maximum(seen[at], 1) / np.maximum(before[at - 1], 1)
            logs[at] = np.where(found, np.log(ratio), math.log(BACKOFF) + logs[at])
        if n == order:
            full[at] = found
        before = seen
    return pd.DataFrame({
        "doc_id": list(row["doc_ids"]), "n_words": size,
        "log_score": np.bincount(doc, weights=logs, minlength=len(size)),
        "n_full": np.bincount(doc, weights=full, minlength=len(size)).astype(np.int64),
    })


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms) and n_full (words scored at full order).

    The score of a word after its history is count(history, word) / count(history) if that n-gram
    occurs in another document, else BACKOFF times the score after the history without its first word;
    a single word scores count / words of the others, one that no other document has 1 / (words of the
    others + 1).  Histories do not reach over the start of a document and are shorter there.

    Words are runs of characters other than ASCII whitespace, A-Z lower-cased.  Null and empty texts
    have no words and score 0.  Repeated rows are documents of their own.  An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    chunks, catalog_name = _stored_by_chunk(_chunks(docs))
    counted = chunks.mapInArrow(_sizes, "words long").agg(F.sum("words")).first()[0] or 0
    buckets = max(1, math.ceil(counted * (order - 1) / BUCKET_ENTRIES))
    reply = "chunk string, bucket long, n long, totals binary"
    bits = min(64, max(52, math.ceil(math.log2(max(2, counted * order))) + 24))
    answers = _lists(chunks, order, bits, buckets).groupBy("bucket").applyInPandas(_count, reply)
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)])
    schema = schema.add("n_words", LongType()).add("log_score", "double").add("n_full", LongType())
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        lambda chunk, answer: _score(chunk, answer, order, bits, counted), schema
    )
    finished = materialize(scored, "lm-scores")
    docs.sparkSession.sql(f"DROP TABLE {catalog_name}")
    return finished


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [int(_unsqueeze(x, np.int64).sum()) for x in batch.column("lengths").to_pylist()]
        yield pa.record_batch([pa.array(words, pa.int64())], ["words"])
