"""SimHash near-duplicates: 64-bit fingerprints, a byte-position index, count filtering, components.

Two fingerprints with at most three differing bits share at least five of their
eight bytes, position by position. A posting list of one (position, byte) holds
a 256th of the corpus, so a join of such lists would grow with its square. The
index therefore intersects four positional bytes at a time: the 14 blocks of the
Steiner system S(3, 4, 8) are such that any three bad positions miss one block
entirely, so every pair with five shared bytes meets in a posting. Pairs that meet
are tallied by their shared positional bytes, those with five or more verified bit
by bit.

Copies count once: the index holds distinct fingerprints. A posting with more
than `SMALL` of them is cut again by the same design over the nibbles of its other
four bytes; such a piece fixes 48 bits and so has at most 65,536 members, whatever
the corpus. Postings return a spanning forest of their links, never all pairs, and
the forests are merged by alternating large-star and small-star rounds.

Defined cases: a text without words (null, empty) has fingerprint zero and is linked
like any other; ids may be null or repeat: each row is a document, the component's id
is its smallest id that is not null; equal rows get equal results; an empty table
stays empty; no other columns than id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import boxed, save, text_key, unboxed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
MIN_SHARED = 5            # of eight positional bytes (or nibbles) when at most three bits differ
SMALL = 512               # distinct fingerprints that a posting links in one go

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The blocks of S(3, 4, 8): 4-subsets of the 8 positions whose binary numbers cancel out (affine planes).
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, batch.num_rows)
        yield batch.drop_columns(["text"]).append_column("print", pa.array(prints.view(np.int64)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, print) per row; the print as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("text"))
    schema = rows.drop("text").schema.add("print", "long")
    return rows.mapInArrow(_fingerprints, schema)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of two broadcastable arrays are links: count the shared bytes, then the bits."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1)
    close = shared >= MIN_SHARED
    close[close] = np.bitwise_count(differ[close]) <= MAX_BITS
    return close


def forest(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among the members: at most one per member."""
    n = len(members)
    label = np.arange(n)

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    left, right = [], []
    for pivot in range(n - 1):
        if len(left) == n - 1:      # all connected
            break
        for j in pivot + 1 + np.flatnonzero(_near(members[pivot + 1:], members[pivot])):
            a, b = root(pivot), root(int(j))
            if a != b:
                label[max(a, b)] = min(a, b)
                left.append(members[pivot])
                right.append(members[j])
    return np.array(left, np.uint64), np.array(right, np.uint64)


def _pieces(value: np.ndarray, block: tuple[int, ...], width: int) -> np.ndarray:
    """The bits of the block's positions, side by side."""
    out = np.zeros(len(value), np.uint64)
    for position in block:
        out = (out << np.uint64(width)) | ((value >> np.uint64(position * width)) & np.uint64((1 << width) - 1))
    return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """14 postings (block, four bytes) per fingerprint."""
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
        for number, block in enumerate(BLOCKS):
            key = (np.uint64(number) << np.uint64(32)) | _pieces(prints, block, 8)
            yield pa.record_batch({"posting": key.view(np.int64), "piece": np.zeros(len(prints), np.int64), "print": prints.view(np.int64)})


def _second_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """14 pieces (block, four nibbles of the other bytes) per member of a large posting."""
    for batch in batches:
        posting = batch.column("posting").to_numpy(zero_copy_only=False)
        prints = batch.column("a").to_numpy(zero_copy_only=False).view(np.uint64)
        others = np.zeros(len(prints), np.uint64)
        for number, block in enumerate(BLOCKS):
            mine = (posting >> 32) == number
            rest = tuple(p for p in range(8) if p not in block)
            others[mine] = _pieces(prints[mine], rest, 8)
        for number, block in enumerate(BLOCKS):
            key = (np.uint64(number) << np.uint64(16)) | _pieces(others, block, 4)
            yield pa.record_batch({"posting": posting, "piece": key.view(np.int64), "print": prints.view(np.int64)})


def _linker(limit: int | None) -> Callable:
    """Stream rows sorted by (posting, piece): forests of links, or all rows of a posting over the limit (b is null)."""
    def rows(posting, a, b):
        return pa.record_batch({"posting": pa.array(posting, pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def link(batches):
        held, key, large = [], None, False

        def close():
            if large or not held:
                return
            members = np.unique(np.concatenate(held))
            if len(members) > 1:
                left, right = forest(members)
                if len(left):
                    yield rows(np.full(len(left), key[0]), left.view(np.int64), right.view(np.int64))

        for batch in batches:
            posting = batch.column("posting").to_numpy(zero_copy_only=False)
            piece = batch.column("piece").to_numpy(zero_copy_only=False)
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(posting):
                continue
            cuts = np.flatnonzero((posting[1:] != posting[:-1]) | (piece[1:] != piece[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(posting)]])
            # Runs of one member inside the batch link nothing; only the others and both ends are looked at.
            sizes = np.diff(bounds)
            looked = np.flatnonzero(sizes > 1)
            looked = np.union1d(looked, [0, len(sizes) - 1]).astype(np.int64)
            for at in looked:
                low, high = bounds[at], bounds[at + 1]
                here = (int(posting[low]), int(piece[low]))
                if here != key:
                    yield from close()
                    held, key, large = [], here, False
                if large:
                    yield rows(posting[low:high], prints[low:high].view(np.int64), [None] * (high - low))
                    continue
                held.append(prints[low:high])
                if limit is not None and sum(map(len, held)) > limit:
                    large = True
                    members = np.concatenate(held)
                    yield rows(np.full(len(members), key[0]), members.view(np.int64), [None] * len(members))
                    held = []
        yield from close()
    return link


_LINKS = "posting long, a long, b long"


def links(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints in reach of three bits, about one per member and posting."""
    postings = prints.mapInArrow(_postings, "posting long, piece long, print long")
    keys = [F.col("posting"), F.col("piece")]
    def in_order(rows, *by):
        return rows.repartition(*by).sortWithinPartitions("posting", "piece")
    first = save(in_order(postings, keys[0]).mapInArrow(_linker(small), _LINKS), "postings")
    large = first.where(F.col("b").isNull()).mapInArrow(_second_postings, "posting long, piece long, print long")
    second = in_order(large, *keys).mapInArrow(_linker(None), _LINKS)
    return first.where(F.col("b").isNotNull()).unionByName(second).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (a, b): alternate large-star and small-star until nothing moves.

    Each round is written to the shared folder; only its row count and a sum of hashes reach the driver.
    """
    def state(rows):
        return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lows, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(lows, "a")
        small = (joined.select("a", F.col("low").alias("b")).unionByName(
            joined.select(F.col("b").alias("a"), F.col("low").alias("b")))).where("a != b").distinct()
        edges = save(small, "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, print, component_id, first): a row per row of `docs`.

    `first` says whether the row is the component's chosen document: the smallest id, then the smallest text key.
    """
    rows = save(fingerprints(docs, doc_id, text), "fingerprints")
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")))
    prints = rows.groupBy("print").agg(chosen.alias("least"))
    roots = components(links(prints.select("print")))
    named = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = save(named, "print-components")
    least = named.groupBy("root").agg(F.min("least").alias("least"))
    named = named.drop("least").join(least, "root")
    joined = rows.join(named, "print")
    return joined.select(
        "doc_id", "text_key", "print", F.col("least.d").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.d")) & (F.col("text_key") == F.col("least.k"))).alias("first"))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every component, with its own columns."""
    rows = boxed(docs, doc_id, text)
    chosen = near_duplicates(rows.select("id", "text"), "id", "text").where("first").select(
        F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")).distinct()
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi")
    kept = kept.dropDuplicates(["id", "key"])
    return kept.select(*unboxed(kept, docs.columns))
