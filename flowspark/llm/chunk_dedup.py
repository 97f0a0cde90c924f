"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest.

A gear hash shifts left by one and adds a table value per byte; of 16 bits, so that
16 bytes back everything has left it: whether a chunk ends at a white space depends
on the 16 bytes before it only. Insertions move boundaries nearby and nothing else. Chunks
are whole words (about one boundary in `ONE_IN` word ends). Where `SOLID` bytes have no white space
(Chinese, Japanese, Thai, base64) a chunk can end before any character, again by the hash of the bytes
before it. Where `MAX_CHUNK` bytes have no boundary (periodic text has few contexts), the bound on the hash is
doubled until they have, for word ends first and then for characters; such looser cuts are where the hash is least, `SPARSE` bytes apart at
least, which is the same place of every period. Only text without any candidate is cut by length.

Chunks meet by a 64-bit digest (at 1e12 chunks one in 2e7 meets a stranger; a run needs
several neighbours). The documents of a digest are reduced to the smallest and the
largest id before the shuffle; chunks with a shared digest go back to their document,
where neighbours form runs. A run of at least `MIN_WORDS`
words (of `WORD_CHARS` characters where a chunk has hardly any white space) is a repeated passage: the first document of its chunks keeps it, later ones
can drop as much of it as is a passage in itself. Digests that many documents share are a skewed join side, which
Spark cuts (it needs no rows of a digest together).

A passage of over 50 words that several documents share holds, but for its ends, the
same chunks in each, and is reported with the part of it that whole chunks cover. A phrase that repeats for less than
two `MAX_CHUNK` can lack any boundary (its words offer the same few contexts again and again) and is then missed.

Defined cases: a null or empty text has no chunks; null ids are one document, after
all others; rows that repeat an id are that document again and no repeat of it; an
empty table stays empty; no other columns than id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import boxed, save, text_key, unboxed

ONE_IN = 5                # word ends per boundary, on average
MAX_CHUNK = 512           # bytes
MIN_WORDS = 16            # of a run: a passage of 50 words keeps as many between its first and last boundary but in 1 of 200 cases
LONG_CHUNK = 4            # words of the longest chunk of a run: shorter ones are shared by chance, unless
LONG_RUN = 30             # there are so many words of them (periodic text)
SOLID = 64                # bytes without white space, after which a chunk can end before any character
ONE_IN_CHARS = 16         # characters per boundary there, on average
SPARSE = 128              # bytes between cuts by a looser bound
LONG_WORD = 16            # characters per word: a chunk with more on average has hardly any white space
WORD_CHARS = 4            # characters that count as a word there
REACH = 16                # bytes the gear hash sees
GEAR_SEED = 20
CHARS_BITS = 10           # of a chunk's size: enough for MAX_CHUNK code points

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_table(seed: int = GEAR_SEED) -> np.ndarray:
    """256 random 16-bit values."""
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte: h = (h << 1) + table[byte], modulo 2**16.

    Summed by doubling: the hash over 2w bytes is that over w plus the one w bytes before, shifted by w.
    """
    h = table[data]
    width = 1
    while width < REACH:
        h[width:] += h[:-width] << np.uint16(width)      # numpy buffers overlapping operands
        width *= 2
    return h


def _looser(ends: np.ndarray, n: int, places: np.ndarray, hashes: np.ndarray, one_in: int, max_chunk: int) -> np.ndarray:
    """`ends` and, in chunks over `max_chunk`, those of the `places` below the first doubled bound that have the chunk's least hash.

    They lie `SPARSE` bytes apart at least. In periodic text the least hash returns with every period, so the cuts fall on one
    place of it wherever the text begins.
    """
    bound, wide = (1 << 16) // one_in, []
    while bound < 1 << 16:
        bound = min(2 * bound, 1 << 16)
        allowed = places[hashes[places - 1] < bound]
        while True:
            starts = np.concatenate([[0], ends[:-1]])
            wide = np.flatnonzero(ends - starts > max_chunk)
            more = []
            for chunk in wide:
                inner = allowed[np.searchsorted(allowed, starts[chunk], "right"):np.searchsorted(allowed, ends[chunk])]
                if len(inner):
                    own = hashes[inner - 1]
                    inner = inner[own == own.min()]
                here = 0
                while here < len(inner):
                    more.append(int(inner[here]))
                    here = int(np.searchsorted(inner, inner[here] + SPARSE))
            if not more:
                break
            ends = np.union1d(ends, more)
        if not len(wide):
            break
    return ends


def boundaries(data: np.ndarray, table: np.ndarray, one_in: int = ONE_IN, max_chunk: int = MAX_CHUNK) -> np.ndarray:
    """Ends of the chunks of a text, the last one included."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    word_end = np.zeros(n, bool)
    word_end[:-1] = space[:-1] & ~space[1:]              # the last white space before a word
    hashes = gear_hashes(data, table)
    words = np.flatnonzero(word_end)
    ends = words[hashes[words] < np.uint16((1 << 16) // one_in)] + 1
    gaps = np.flatnonzero(space)
    edges = np.concatenate([[-1], gaps, [n]])
    chars = None
    if np.diff(edges).max() > SOLID or n > max_chunk and np.diff(ends, prepend=0, append=n).max() > max_chunk:
        # Places before a character that does not follow white space.
        chars = np.flatnonzero(((data[1:] & 0xC0) != 0x80) & ~space[:-1] & ~space[1:]) + 1
        since = chars - 1 - edges[np.searchsorted(edges, chars) - 1]
        solid = chars[(since >= SOLID) & (hashes[chars - 1] < (1 << 16) // ONE_IN_CHARS)]
        ends = np.union1d(ends, solid)
    ends = np.concatenate([ends, [n]]).astype(np.int64)
    if np.diff(ends, prepend=0).max() > max_chunk:
        ends = _looser(ends, n, words + 1, hashes, one_in, max_chunk)
        ends = _looser(ends, n, chars, hashes, ONE_IN_CHARS, max_chunk)
    starts = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - starts) // max_chunk)
    if pieces.max() > 1:                                 # no candidate at all (white space): cut by length
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        step = np.arange(pieces.sum()) - first + 1
        ends = np.minimum(np.repeat(starts, pieces) + step * max_chunk, np.repeat(ends, pieces))
    return ends


def _chunks(one_in: int, max_chunk: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table()
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows, parts = [], []
            for row, text in enumerate(batch.column("text")):
                body = (text.as_py() or "").encode()
                if not body:
                    continue
                data = np.frombuffer(body, np.uint8)
                ends = boundaries(data, table, one_in, max_chunk)
                at = [0, *ends.tolist()]
                digests = np.fromiter((digest(body[a:b]) for a, b in pairwise(at)), np.uint64, len(ends))
                begins = ~_SPACE[data]
                begins[1:] &= _SPACE[data[:-1]]
                # Ends in code points: the bytes that continue a character do not count.
                points = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
                words = np.cumsum(begins)[ends - 1]
                rows.append(np.full(len(ends), row))
                parts.append((digests, points, (np.diff(words, prepend=0) << CHARS_BITS) | np.diff(points, prepend=0)))
            if not rows:
                continue
            digests, points, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
            out = batch.drop_columns(["text"]).take(pa.array(np.concatenate(rows)))
            columns = {"digest": digests.view(np.int64), "end": points.astype(np.int32), "size": sizes.astype(np.int32)}
            yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, columns.values())], names=[*out.schema.names, *columns])
    return cut


def chunks(docs: DataFrame, one_in: int = ONE_IN, max_chunk: int = MAX_CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, digest, end, size): every chunk; `end` in code points, `size` holds words and code points."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    schema = rows.drop("text").schema
    for name, kind in (("digest", "long"), ("end", "integer"), ("size", "integer")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_chunks(one_in, max_chunk), schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, one_in: int = ONE_IN, max_chunk: int = MAX_CHUNK,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, spans): documents with passages that others have too.

    spans: array of (start, end, words, later) in code points; `later` if a document with a smaller id has every chunk of it.
    """
    every = save(chunks(docs, one_in, max_chunk, doc_id, text), "chunks")
    shared = every.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("open"))
    shared = shared.where((F.col("first") != F.col("last")) | (F.col("open") & F.col("first").isNotNull())).select("digest", "first")
    # As a table of its own the small side is shuffled for the join alone, and Spark can cut a hot digest on the large side.
    met = every.join(save(shared, "shared-chunks"), "digest").select(
        "doc_id", "text_key", "end", (F.col("size").bitwiseAND(F.lit((1 << CHARS_BITS) - 1))).alias("chars"),
        F.shiftright("size", CHARS_BITS).alias("words"), (~F.col("first").eqNullSafe(F.col("doc_id"))).alias("later"))
    # Repeated rows of a document bring the same chunk again: one of them counts.
    of_doc = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("end", "chars", "words", "later"))).alias("found"))
    return of_doc.select("doc_id", "text_key", F.pandas_udf(_runs, _SPANS)(F.lit(min_words), "found").alias("spans")).where(F.size("spans") > 0)


_SPANS = "array<struct<start:int,end:int,words:int,later:boolean>>"


def _runs(least: pd.Series, found: pd.Series) -> pd.Series:
    """Runs of neighbouring shared chunks, long enough to be no chance, cut where `later` changes for long enough."""
    def weight(part):
        return part["words"] if part["chars"] <= LONG_WORD * part["words"] else max(part["words"], part["chars"] // WORD_CHARS)

    def enough(parts):
        weights = [weight(p) for p in parts]
        return sum(weights) >= (min_words if max(weights) >= LONG_CHUNK else max(min_words, LONG_RUN))

    def grouped(items, same):
        out = []
        for item in items:
            if out and same(out[-1][-1], item):
                out[-1].append(item)
            else:
                out.append([item])
        return out

    def spans(items):
        result = []
        for run in grouped(items, lambda a, b: a["end"] == b["end"] - b["chars"]):
            if not enough(run):
                continue
            for piece in grouped(run, lambda a, b: a["later"] == b["later"]):
                later = bool(piece[0]["later"]) and enough(piece)
                start, words = piece[0]["end"] - piece[0]["chars"], sum(p["words"] for p in piece)
                here = result[-1] if result else None
                if here and here["end"] == start and here["later"] == later:
                    here["end"] = piece[-1]["end"]
                    here["words"] += words
                else:
                    result.append({"start": start, "end": piece[-1]["end"], "words": words, "later": later})
        return result
    min_words = int(least.iloc[0]) if len(least) else 0
    return found.map(spans)


def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(body, gone):
        if gone is None or body is None:
            return body
        out, at = [], 0
        for span in gone:
            if span["later"]:
                out.append(body[at:span["start"]])
                at = span["end"]
        return "".join(out) + body[at:]
    return pd.Series([cut(b, s) for b, s in zip(text, spans, strict=True)], dtype=object)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` without the passages an earlier document has, and `__spans` (null if none)."""
    rows = boxed(docs, doc_id, text)
    found = repeated_passages(rows.select("id", "text"), doc_id="id", **settings).select(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "spans")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    some = F.exists(F.coalesce(F.col("spans"), F.array()), lambda s: s["later"])
    cut = F.pandas_udf(_without, "string")(F.when(some, F.col("text")), F.col("spans"))
    joined = joined.withColumn("kept", F.when(some, cut).otherwise(F.col("text")))
    return joined.select(*unboxed(joined, [c for c in docs.columns if c != "__spans"], **{text: F.col("kept")}), F.col("spans").alias("__spans"))
