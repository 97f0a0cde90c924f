"""Spelling variants grouped by FM-index search schemes with one error.

Two words are near if they differ by one inserted, deleted or replaced code point. Then one half of the
word asked for, cut at length // 2, stands unchanged at that end of the other word. Two
schemes follow: match the first half exactly and extend to the right across the second with one error, or match the
second half exactly and extend to the left across the first. Each match begins and ends at a delimiter.
A match is an interval of suffix ranks; extending it takes two rank lookups in the Burrows-Wheeler transform of
the delimited vocabulary (to the left) or of its reversal (to the right).

The index is cut into shards that a task builds and searches. A word of length l lies in the
shard of its first, and in another of its last, (l - 1) // 2 code points with l. A word of length L asks the shards of the lengths L - 1, L and
L + 1; their keys are part of its exact halves, so nothing is missed, and every
target of a scheme lies in one shard. Keys with over HOT_KEY words are split by hash of the word, and
the words that ask go to all splits. Pairs never leave a shard: per asking word it returns how many near words
it found and the best of them; these are summed up. The second scheme leaves out what the first has found.

Forms are followed to their roots by pointer jumping; a form has twice the count of its word, so chains
are no longer than the logarithm of the largest count.

Defined cases: a null text has no words; a null doc_id writes nothing before the colon of the hash; repeated rows
count as often as they occur; words may have any length and any code points; an empty table gives
an empty one; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import ascii_lower, save, whole

#: Fixed by the contract of the query.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, DROP_MODULUS, FORM_FACTOR = 5, 3, 97, 2

SHARD_WORDS = 50_000          # targets of a shard, about
LEAST_SHARD = 2_000           # smaller shards are not worth a task
HOT_KEY = 10_000              # words of one key in one shard
CHUNK = 8192                  # words that a task searches at a time
END, DELIMITER = 0, 1         # codes below those of characters


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, drop_modulus: int = DROP_MODULUS) -> DataFrame:
    """(word, n) of all words; a run whose hash the modulus divides loses one code point, as a typist would lose it."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    runs = F.regexp_extract_all(ascii_lower(whole(text)), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    rows = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    length = F.char_length("run")
    h = F.crc32(F.concat("name", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, length).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, length))
    words = rows.select(F.when(F.pmod(h, F.lit(drop_modulus)) == 0, shorter).otherwise(F.col("run")).alias("word"))
    return (words.where(F.char_length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


class SuffixRanks:
    """Burrows-Wheeler transform of the reversed, delimited words: intervals of suffix ranks that grow to the right of a match."""

    def __init__(self, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = _points("".join(reversed([w[::-1] for w in words])))
        self.alphabet = np.unique(points)
        # 1 rev(last word) 1 ... 1 rev(first word) 1 0
        ends = np.cumsum(lengths[::-1] + 1)
        text = np.full(int(ends[-1]) + 2, DELIMITER, np.int64)
        text[-1] = END
        places = np.ones(len(text), bool)
        places[np.concatenate([[0], ends, [len(text) - 1]])] = False
        text[places] = np.searchsorted(self.alphabet, points) + 2
        self.n, self.sigma = len(text), len(self.alphabet) + 2
        self.order = _suffix_order(text)
        self.bwt = text[self.order - 1]
        by_code = np.argsort(self.bwt, kind="stable")
        self.keys = self.bwt[by_code] * self.n + by_code
        self.word_at = np.full(self.n, -1, np.int64)        # the word behind a delimiter
        self.word_at[np.concatenate([[0], ends[:-1]])] = np.arange(len(words))[::-1]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of characters; one that no word has gets a code that empties every interval."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 2, self.sigma)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the matches with one character more: smaller codes, and the same code before the interval's ends."""
        return np.searchsorted(self.keys, code * self.n + low), np.searchsorted(self.keys, code * self.n + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval number, code, low, high) of every extension by a character that has a match."""
        width = high - low
        few = np.flatnonzero(width <= 2 * self.sigma)
        many = np.flatnonzero(width > 2 * self.sigma)
        rows = _ranges(low[few], width[few])
        pairs = np.unique(np.repeat(few, width[few]) * self.sigma + self.bwt[rows])
        of, code = np.concatenate([pairs // self.sigma, np.repeat(many, self.sigma)]), np.concatenate(
            [pairs % self.sigma, np.tile(np.arange(self.sigma), len(many))])
        letters = code > DELIMITER
        of, code = of[letters], code[letters]
        a, b = self.extend(code, low[of], high[of])
        found = a < b
        return of[found], code[found], a[found], b[found]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number in `words`, number of an indexed word) one error apart, the first half unchanged."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = []
        by_length = np.argsort(lengths, kind="stable")
        for at in range(0, len(words), CHUNK):
            chunk = by_length[at:at + CHUNK]
            of, target = self._near([words[i] for i in chunk], lengths[chunk])
            found.append(chunk[of] * len(self.word_at) + target)
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // len(self.word_at), pairs % len(self.word_at)

    def _near(self, words: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = self.codes(_points("".join(words)))
        first = np.cumsum(length) - length
        half = length // 2
        # Matches without an error (of, low, high) and with one (of1, ...), all before character j of their word.
        of = np.arange(len(words))
        low, high = self.extend(np.full(len(words), DELIMITER), np.zeros(len(words), np.int64), np.full(len(words), self.n))
        none = np.empty(0, np.int64)
        of1, low1, high1 = none, none, none
        results = []
        for j in range(int(length.max()) + 1 if len(words) else 0):
            inexact = np.flatnonzero(j >= half[of])
            at, code, a, b = self.children(low[inexact], high[inexact])
            at = of[inexact][at]
            of1, low1, high1 = (np.concatenate(x) for x in ((of1, at), (low1, a), (high1, b)))       # a character more
            open_at, open_of = j < length[at], j < length[of]
            skip = inexact[open_of[inexact]]
            wrong = np.flatnonzero(open_at)
            wrong = wrong[code[wrong] != flat[first[at[wrong]] + j]]
            later = ((of[skip], at[wrong]), (low[skip], a[wrong]), (high[skip], b[wrong]))          # one less, or another
            ended = j == length[of1]
            a, b = self.extend(np.full(int(ended.sum()), DELIMITER), low1[ended], high1[ended])
            results.append((of1[ended][a < b], a[a < b]))
            of1, low1, high1 = of1[~ended], low1[~ended], high1[~ended]
            low1, high1 = self.extend(flat[first[of1] + j], low1, high1)
            of, low, high = of[open_of], low[open_of], high[open_of]
            low, high = self.extend(flat[first[of] + j], low, high)
            of1, low1, high1 = (np.concatenate([x[low1 < high1], *more]) for x, more in zip((of1, low1, high1), later, strict=True))
            of, low, high = (x[low < high] for x in (of, low, high))
        ranks = np.concatenate([x for _, x in results]) if results else none
        return (np.concatenate([x for x, _ in results]) if results else none), self.word_at[self.order[ranks]]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    total = int(size.sum())
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix numbers in sorted order, by doubling the length that ranks compare."""
    rank, step, n = text, 1, len(text)
    while True:
        following = np.zeros(n, np.int64)
        following[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """One shard: for each asking word the number of near words here, and the best by count, then by code point."""
    right = frame["side"].iloc[0] == 0
    targets = frame[frame["target"]].sort_values("word")      # by code point
    asking = frame.loc[~frame["target"], "word"].drop_duplicates().tolist()
    names, counts = targets["word"].tolist(), targets["n"].to_numpy()
    empty = pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []})
    if not names or not asking:
        return empty
    turn = (lambda w: w) if right else (lambda w: w[::-1])
    of, target = SuffixRanks([turn(w) for w in names]).near([turn(w) for w in asking])
    if not right:      # what begins with the first half, the first scheme has found
        alike = [names[t].startswith(asking[q][:len(asking[q]) // 2]) for q, t in zip(of, target, strict=True)]
        of, target = of[~np.array(alike, bool)], target[~np.array(alike, bool)]
    if not len(of):
        return empty
    best = np.lexsort((target, -counts[target], of))
    heads = best[np.concatenate([[True], np.diff(of[best]) != 0])]
    return pd.DataFrame({"word": [asking[i] for i in of[heads]], "n_near": np.bincount(of)[of[heads]],
                         "best_n": counts[target[heads]], "best": [names[t] for t in target[heads]]})


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n_near, best_n, best) for the words (word, n) that have near words."""
    spark = words.sparkSession
    size = words.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-size // SHARD_WORDS), min(tasks, -(-size // LEAST_SHARD)))
    length = F.char_length("word")

    def keys(of):
        known = F.floor((of - 1) / 2).cast("int")
        ends = [F.substring("word", F.lit(1), known), F.substring("word", length - known + 1, known)]
        return [F.struct(F.lit(side).alias("side"), of.alias("length"), end.alias("part")) for side, end in enumerate(ends)]

    targets = words.select("word", "n", F.lit(True).alias("target"), F.explode(F.array(*keys(length))).alias("key"))
    asked = [k for step in (-1, 0, 1) for k in keys(length + step)]
    asking = words.select("word", "n", F.lit(False).alias("target"), F.explode(F.array(*asked)).alias("key")).where(
        F.col("key.length") >= least_length)
    hot = targets.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_KEY)
    hot = hot.select("key", F.ceil(F.col("rows") / HOT_KEY).cast("int").alias("splits"))
    rows = targets.unionByName(asking).join(F.broadcast(hot), "key", "left")     # a row per HOT_KEY targets at most
    one = F.array(F.pmod(F.xxhash64("word"), F.coalesce("splits", F.lit(1))).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)
    rows = rows.withColumn("split", F.explode(F.when(F.col("target"), one).otherwise(every)))
    shard = F.pmod(F.xxhash64("key", "split"), F.lit(shards)).cast("int")
    rows = rows.select(F.col("key.side").alias("side"), shard.alias("shard"), "word", "n", "target")
    found = rows.groupBy("side", "shard").applyInPandas(_search, "word string, n_near long, best_n long, best string")
    # Largest count first, then the smallest word.
    ranked = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("top"))
    return ranked.select("word", "n_near", (-F.col("top.n")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): from word along the forms to the last."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        step = save(at.join(on, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus."""
    words = save(count_words(docs, doc_id, text, least_length, least_count), "words")
    near = near_words(words, least_length)
    better = F.coalesce(F.col("best_n") >= factor * F.col("n"), F.lit(False))
    found = save(words.join(near, "word", "left").select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(better, F.col("best_n")).alias("form_n")), "near-words")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
