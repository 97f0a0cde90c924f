"""LM scoring: a gated recurrent model in numpy, trained by truncated backpropagation, beside a unigram base.

Counts come first and cover every training document: tasks count words of their
rows, Spark adds the counts up; totals, the vocabulary and its classes follow from them.
The `VOCABULARY` most frequent words are symbols of the model, every other word is
one rare symbol times its smoothed share among the rare words, so a text's score is
the log10 probability of the whole text. Output is factored: first a class of words
of about equal frequency, then the word within its class. Biases start at the
unigram logarithms, so training begins where the base model ends.

Training averages parameters. The rounds share out all training documents by hash, so each
of them gives its gradient once. In a round every task takes its own documents of that share, trains from the common parameters by backpropagation through
`SPAN` steps with the state carried on, and returns one parameter vector; vectors are averaged
in a tree of tasks and only the last few reach the driver.

Every text is cut into words and looked up once; training and scoring read the stored symbols.
Scoring passes every document once, in lanes of similar length. The state is
carried from window to window, so a document of any length is scored whole. Counts
of the `KNOWN` most frequent words travel with the task; rarer words are joined
with their counts by shuffle, and their logarithms are added up per document.

Defined cases: a null or empty text is the end token alone; a null id belongs to the
training rows; repeated rows count, train and are scored one by one; without training rows all
counts are 0; an empty table stays empty; no other columns than id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import save, text_key

VOCABULARY = 2000         # symbols of the model
KNOWN = 50_000            # words whose counts every task holds
EMBED = 16
HIDDEN = 16
SPAN = 24                 # steps of truncated backpropagation
LANES = 512               # texts side by side in training, fewer where a task has little
LEAST_STEPS = 16          # updates of a task with little text
SCORE_LANES = 512
SCORE_SPAN = 32
ROUNDS = 3
SAMPLE = ROUNDS           # one in so many training documents per round: the rounds share out all of them
RATE = 0.02
CLIP = 1.0
FAN_IN = 32
HASH_SHARES = 1 << 20
FLUSH = 400_000           # words a task counts before it passes them on
UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(UPPER_TO_LOWER).split()


# ---- counts --------------------------------------------------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of a task's rows; the end of a text is the empty word."""
    found: Counter = Counter()

    def rows():
        return pa.record_batch({"word": pa.array(list(found), pa.binary()).cast(pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    for batch in batches:
        for text in batch.column("text"):
            found.update(words_of(text.as_py()))
            found[b""] += 1
            if len(found) > FLUSH:
                yield rows()
                found = Counter()
    if found:
        yield rows()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 7 == 2


# ---- the model -----------------------------------------------------------------------------------------------------

class Shape:
    """Symbols, their classes and the layout of the parameter vector. Symbols: words by rank, then rare, then end."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.float64) + 1
        n = len(counts)
        share = self.counts / self.counts.sum()
        order = np.argsort(-self.counts, kind="stable")
        # Classes of about equal mass of root frequency: few members where words are frequent.
        mass = np.cumsum(np.sqrt(share[order]))
        k = max(1, int(round(math.sqrt(n))))
        number = np.minimum((mass / mass[-1] * k - 1e-9).astype(int), k - 1)
        number = np.unique(number, return_inverse=True)[1]
        self.order = order                               # column -> symbol
        self.column = np.empty(n, np.int64)
        self.column[order] = np.arange(n)
        self.class_of = np.empty(n, np.int64)
        self.class_of[order] = number
        self.starts = np.concatenate([np.flatnonzero(np.diff(number, prepend=-1)), [n]])
        self.n, self.classes = n, len(self.starts) - 1
        shapes = {"embed": (n, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
                  "wc": (HIDDEN, self.classes), "bc": (self.classes,), "wo": (HIDDEN, n), "bo": (n,)}
        self.slots, at = {}, 0
        for name, shape in shapes.items():
            size = math.prod(shape)
            self.slots[name] = (at, at + size, shape)
            at += size
        self.size = at

    def views(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        return {name: vector[a:b].reshape(shape) for name, (a, b, shape) in self.slots.items()}

    def start(self, seed: int = 7) -> np.ndarray:
        vector = np.zeros(self.size, np.float32)
        p, rng = self.views(vector), np.random.default_rng(seed)
        p["embed"][:] = rng.normal(0, 0.3, p["embed"].shape)
        p["wx"][:] = rng.normal(0, 1 / math.sqrt(EMBED), p["wx"].shape)
        p["wh"][:] = rng.normal(0, 1 / math.sqrt(HIDDEN), p["wh"].shape)
        p["b"][HIDDEN:2 * HIDDEN] = 1.0                  # remember by default
        by_column = self.counts[self.order]
        sums = np.add.reduceat(by_column, self.starts[:-1])
        p["bc"][:] = np.log(sums / sums.sum())
        p["bo"][:] = np.log(by_column / np.repeat(sums, np.diff(self.starts)))
        return vector


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(gates_x, h, wh):
    """One gated step: the new state and what its gradient needs."""
    gates_h = h @ wh
    rz = _sigmoid(gates_x[:, :2 * HIDDEN] + gates_h[:, :2 * HIDDEN])
    r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
    inner = gates_h[:, 2 * HIDDEN:]
    new = np.tanh(gates_x[:, 2 * HIDDEN:] + r * inner)
    return new + z * (h - new), (r, z, inner, new)


def _softmax_loss(logits, target):
    """(log probability of the targets, probabilities less 1 at the targets); the logits' place is reused."""
    rows = np.arange(len(target))
    at = logits[rows, target]
    np.exp(logits, out=logits)          # logits stay small: they start as logarithms of shares
    total = logits.sum(axis=1, keepdims=True)
    logits /= total
    logits[rows, target] -= 1
    return at - np.log(total[:, 0]), logits


def _by_class(shape: "Shape", classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The order of symbols by class, and per class with members and a choice its part of the order and its columns."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(shape.classes + 1))
    parts = [(cuts[c], cuts[c + 1], shape.starts[c], shape.starts[c + 1]) for c in range(shape.classes)]
    return order, [x for x in parts if x[0] < x[1] and x[3] - x[2] > 1]


def log_probabilities(shape: Shape, p: dict, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural logarithms of the symbols' probabilities after the states."""
    classes = shape.class_of[symbols]
    logits = states @ p["wc"] + p["bc"]
    rows = np.arange(len(symbols))
    out = logits[rows, classes].copy()
    np.exp(logits, out=logits)
    out -= np.log(logits.sum(axis=1))
    order, parts = _by_class(shape, classes)
    sorted_states, columns, gains = states[order], shape.column[symbols[order]], np.zeros(len(order), states.dtype)
    for low, high, a, b in parts:
        logits = sorted_states[low:high] @ p["wo"][:, a:b] + p["bo"][a:b]
        gains[low:high] = logits[np.arange(high - low), columns[low:high] - a]
        np.exp(logits, out=logits)
        gains[low:high] -= np.log(logits.sum(axis=1))
    out[order] += gains
    return out


def _backward(shape: Shape, p: dict, h0, x, y, fresh):
    """Loss, gradient and last state of one span; x, y, fresh are (steps, lanes). Targets below 0 are padding and count nothing."""
    steps, lanes = x.shape
    gates = (p["embed"] @ p["wx"] + p["b"])[x]
    h, states, kept, before = h0, np.empty((steps, lanes, HIDDEN), np.float32), [], []
    for t in range(steps):
        h = np.where(fresh[t][:, None], np.float32(0), h)
        before.append(h)
        h, inside = _step(gates[t], h, p["wh"])
        kept.append(inside)
        states[t] = h
    flat, target = states.reshape(-1, HIDDEN), y.reshape(-1)
    padded = bool((target < 0).any())
    if padded:
        real = np.flatnonzero(target >= 0)
        flat, target = flat[real], target[real]
    vector = np.zeros(shape.size, np.float32)
    g = shape.views(vector)
    n = max(1, len(target))
    classes = shape.class_of[target]
    logp, slope = _softmax_loss(flat @ p["wc"] + p["bc"], classes)
    loss = -float(logp.sum())
    slope /= n
    g["wc"][:] = flat.T @ slope
    g["bc"][:] = slope.sum(axis=0)
    d_flat = slope @ p["wc"].T
    order, parts = _by_class(shape, classes)
    sorted_flat, columns, d_sorted = flat[order], shape.column[target[order]], np.zeros((len(order), HIDDEN), d_flat.dtype)
    for low, high, a, b in parts:
        own = sorted_flat[low:high]
        logp, slope = _softmax_loss(own @ p["wo"][:, a:b] + p["bo"][a:b], columns[low:high] - a)
        loss -= float(logp.sum())
        slope /= n
        g["wo"][:, a:b] = own.T @ slope
        g["bo"][a:b] = slope.sum(axis=0)
        d_sorted[low:high] = slope @ p["wo"][:, a:b].T
    d_flat[order] += d_sorted
    if padded:
        every = np.zeros((steps * lanes, HIDDEN), d_flat.dtype)
        every[real] = d_flat
        d_flat = every
    d_states = d_flat.reshape(steps, lanes, HIDDEN)
    d_gates, d_h_gates = np.empty((steps, lanes, 3 * HIDDEN), np.float32), np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    carry = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        r, z, inner, new = kept[t]
        dh = d_states[t] + carry
        d_new = dh * (1 - z) * (1 - new * new)
        d_z = dh * (before[t] - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_gates[t, :, :HIDDEN], d_gates[t, :, HIDDEN:2 * HIDDEN], d_gates[t, :, 2 * HIDDEN:] = d_r, d_z, d_new
        own = d_h_gates[t]
        own[:, :2 * HIDDEN], own[:, 2 * HIDDEN:] = d_gates[t, :, :2 * HIDDEN], d_new * r
        carry = dh * z + own @ p["wh"].T
        carry[fresh[t]] = 0
    g["wh"][:] = np.concatenate(before).T @ d_h_gates.reshape(-1, 3 * HIDDEN)
    flat_gates = d_gates.reshape(-1, 3 * HIDDEN)
    g["b"][:] = flat_gates.sum(axis=0)
    # Gradients of a symbol's gates are added up first, so both products run over symbols, not over tokens.
    flat_x = x.reshape(-1)
    order = np.argsort(flat_x.astype(np.int16) if shape.n < 1 << 15 else flat_x, kind="stable")
    starts = np.flatnonzero(np.diff(flat_x[order], prepend=-1))
    seen, summed = flat_x[order][starts], np.add.reduceat(flat_gates[order], starts, axis=0)
    g["wx"][:] = p["embed"][seen].T @ summed
    g["embed"][seen] = summed @ p["wx"].T
    return loss, vector, h


def train(shape: Shape, vector: np.ndarray, texts: list[np.ndarray], rate: float = RATE) -> tuple[np.ndarray, float]:
    """Parameters after one pass over texts of symbols (each with its end), and the mean loss."""
    vector = vector.copy()
    p = shape.views(vector)
    y = np.concatenate(texts)
    fresh = np.zeros(len(y), bool)
    fresh[np.cumsum([0, *map(len, texts[:-1])])] = True
    x = np.concatenate([[shape.n - 1], y[:-1]])          # a text begins after an end
    lanes = max(1, min(LANES, len(y) // (SPAN * LEAST_STEPS)))
    steps = -(-len(y) // lanes)
    tokens, gap = len(y), lanes * steps - len(y)         # the last lane is padded, so every token gives a gradient
    x, y, fresh = (np.concatenate([a, np.full(gap, fill, a.dtype)]).reshape(lanes, steps).T
                   for a, fill in ((x, shape.n - 1), (y, -1), (fresh, False)))
    mean, square = np.zeros_like(vector), np.zeros_like(vector)
    h, loss, step = np.zeros((lanes, HIDDEN), np.float32), 0.0, 0
    for at in range(0, steps, SPAN):
        part, gradient, h = _backward(shape, p, h, x[at:at + SPAN], y[at:at + SPAN], fresh[at:at + SPAN])
        loss += part
        norm = float(np.sqrt(np.dot(gradient, gradient)))
        if norm > CLIP:
            gradient *= CLIP / norm
        step += 1
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient * gradient - square)
        vector -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
    return vector, loss / max(1, tokens)


def score_texts(shape: Shape, vector: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text of symbols (each with its end)."""
    p = shape.views(vector)
    table = p["embed"] @ p["wx"] + p["b"]
    lengths = np.array([len(t) for t in texts])
    out = np.zeros(len(texts))
    order = np.argsort(-lengths, kind="stable")
    for first in range(0, len(order), SCORE_LANES):
        lanes = order[first:first + SCORE_LANES]
        sizes = lengths[lanes]
        h = np.zeros((len(lanes), HIDDEN), np.float32)
        last = np.full(len(lanes), shape.n - 1)
        for at in range(0, int(sizes[0]), SCORE_SPAN):
            live = int(np.searchsorted(-sizes, -at, side="left"))      # lanes longer than `at`, which come first
            width = min(SCORE_SPAN, int(sizes[0]) - at)
            y = np.full((width, live), -1)
            for lane in range(live):
                piece = texts[lanes[lane]][at:at + width]
                y[:len(piece), lane] = piece
            x = np.concatenate([last[None, :live], np.maximum(y[:-1], 0)])
            states = np.empty((width, live, HIDDEN), np.float32)
            h = h[:live]
            for t in range(width):
                h, _ = _step(table[x[t]], h, p["wh"])
                states[t] = h
            last = y[-1].copy()
            real = y >= 0
            values = log_probabilities(shape, p, states[real], y[real])
            out[lanes[:live]] += np.bincount(np.nonzero(real)[1], values, live)
    return out


# ---- on Spark ------------------------------------------------------------------------------------------------------

class Lexicon:
    """What every task holds: the ranks and counts of the most frequent words, and the totals."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int, n_tokens: int, n_distinct: int):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.ends, self.n_tokens, self.n_distinct = ends, n_tokens, n_distinct
        self.symbols = min(VOCABULARY, len(words))
        self.rare_tokens = n_tokens - ends - int(self.counts[:self.symbols].sum())
        self.rare_distinct = n_distinct - self.symbols - (1 if ends else 0)
        self.shape = Shape(np.concatenate([self.counts[:self.symbols], [self.rare_tokens, ends]]))

    def ranks(self):
        return {w: i for i, w in enumerate(self.words)}

    def symbols_of(self, ranks: np.ndarray) -> np.ndarray:
        """Symbols of a text's ranks (-1: none), with its end."""
        rare = (ranks < 0) | (ranks >= self.symbols)
        return np.concatenate([np.where(rare, self.symbols, ranks), [self.symbols + 1]])

    @property
    def base_floor(self) -> float:
        """log10 of what divides a token's count + 1 in the base model."""
        return math.log10(self.n_tokens + self.n_distinct + 1)

    @property
    def rare_floor(self) -> float:
        return math.log10(self.rare_tokens + self.rare_distinct + 1)


def _ranks(words: list[bytes], get) -> np.ndarray:
    return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The texts of symbols of a batch."""
    column = batch.column(batch.schema.get_field_index("symbols"))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _trainer(lexicon: Lexicon, vector: np.ndarray):
    def run(batches):
        total, mean = 0, None
        for batch in batches:
            texts = _texts(batch)
            if not texts:
                continue
            mean, _ = train(lexicon.shape, vector if mean is None else mean.astype(np.float32), texts)
            total += sum(map(len, texts))
        if mean is not None:
            yield pa.record_batch({"n": pa.array([total], pa.int64()), "p": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})
    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, mean = 0, None
    for batch in batches:
        for n, blob in zip(batch.column("n").to_pylist(), batch.column("p").to_pylist(), strict=True):
            vector = np.frombuffer(blob, np.float32).astype(np.float64)
            total += n
            mean = vector if mean is None else mean + (vector - mean) * (n / total)
    if mean is not None:
        yield pa.record_batch({"n": pa.array([total], pa.int64()), "p": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def _most_frequent(counts: DataFrame, known: int) -> list[tuple[str, int]]:
    """The most frequent words, about `known`.

    The bound on the count comes from a histogram of logarithms (about a thousand rows); a sort
    with a limit would send `known` rows of every task to the driver.
    """
    bucket = F.floor(F.log2("n") * 16)
    sizes = sorted(((r["bucket"], r["count"]) for r in counts.groupBy(bucket.alias("bucket")).count().collect()), reverse=True)
    total, bound, share, rest = 0, None, 0, None
    for at, n in sizes:
        if total + n > known:
            share, rest = int((known - total) / n * HASH_SHARES), at
            break
        total, bound = total + n, at
    # Of the bucket that would be too much, a share by hash, so that some words are known however many are alike.
    taken = F.lit(False) if bound is None else bucket >= bound
    if rest is not None:
        taken = taken | ((bucket == rest) & (F.pmod(F.xxhash64("word"), F.lit(HASH_SHARES)) < share))
    found = counts.where(taken).select("word", "n").collect()
    return sorted(((r["word"], r["n"]) for r in found), key=lambda x: (-x[1], x[0].encode()))


def fit(training: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, sample: int = SAMPLE) -> np.ndarray:
    """Parameters after `rounds` of training on the tasks' own documents (`symbols`, or `text` to be looked up) and averaging."""
    if "symbols" not in training.columns:
        training = encoded(training.select("text", text_key().alias("text_key")), lexicon)
    vector = lexicon.shape.start()
    for turn in range(rounds):
        mine = training.where(F.pmod(F.xxhash64("text_key", F.lit(11)), F.lit(sample)) == turn % sample).select("symbols")
        n = mine.rdd.getNumPartitions()
        found = mine.mapInArrow(_trainer(lexicon, vector), "n long, p binary")
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            found = found.repartition(n).mapInArrow(_average, "n long, p binary")
        rows = found.collect()      # FAN_IN vectors at most
        if rows:
            weights = np.array([r["n"] for r in rows], np.float64)
            vector = np.average([np.frombuffer(r["p"], np.float32) for r in rows], axis=0, weights=weights).astype(np.float32)
    return vector


_ENCODED = (("symbols", T.ArrayType(T.ShortType())), ("n_tokens", "long"), ("n_known", "long"), ("base_log", "double"), ("rare_log", "double"),
            ("rare_n", "long"), ("others", T.ArrayType(T.StringType())))


def _encoder(lexicon: Lexicon):
    """Per row its symbols, what its frequent words give, and its rarer words."""
    def run(batches):
        get = lexicon.ranks().get
        logs = np.log10(lexicon.counts + 1.0)
        end = math.log10(lexicon.ends + 1.0)
        for batch in batches:
            symbols, base, rare_log, rare_n, others, tokens, known = [], [], [], [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                ranks = _ranks(words, get)
                held = ranks[ranks >= 0]
                gains = logs[held]
                beyond = held >= lexicon.symbols
                symbols.append(lexicon.symbols_of(ranks).astype(np.int16))
                base.append(float(gains.sum()) + end)
                rare_log.append(float(gains[beyond].sum()))
                rare_n.append(int(beyond.sum()) + len(words) - len(held))
                others.append([words[i] for i in np.flatnonzero(ranks < 0)])
                tokens.append(len(words) + 1)
                known.append(len(held) + (lexicon.ends > 0))
            out = batch.drop_columns(["text"])
            flat = np.concatenate([np.empty(0, np.int16), *symbols])
            columns = {
                "symbols": pa.ListArray.from_arrays(np.cumsum([0, *map(len, symbols)]).astype(np.int32), pa.array(flat)),
                "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "base_log": pa.array(base, pa.float64()), "rare_log": pa.array(rare_log, pa.float64()),
                "rare_n": pa.array(rare_n, pa.int64()),
                "others": pa.array(others, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([*out.columns, *columns.values()], names=[*out.schema.names, *columns])
    return run


def encoded(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`rows` with their text looked up: each text is cut into words once for training and scoring."""
    schema = rows.drop("text").schema
    for name, kind in _ENCODED:
        schema = schema.add(name, kind)
    return rows.mapInArrow(_encoder(lexicon), schema)


def _scorer(lexicon: Lexicon, vector: np.ndarray):
    """Per row the model's log10 probability of its symbols."""
    def run(batches):
        for batch in batches:
            scores = score_texts(lexicon.shape, vector, _texts(batch)) / math.log(10)
            yield batch.drop_columns(["symbols"]).append_column("model_log", pa.array(scores, pa.float64()))
    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: int = KNOWN, rounds: int = ROUNDS,
          sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of `docs`."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"), held_out(F.col(doc_id)).alias("held_out"),
                       F.col(text).alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = save(training.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                        F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0)).alias("ends")).first()
    top = _most_frequent(counts.where("word != ''"), known)
    lexicon = Lexicon([w.encode() for w, _ in top], [n for _, n in top], totals["ends"], totals["n"], totals["v"])
    stored = save(encoded(rows, lexicon).withColumn("row", F.monotonically_increasing_id()), "encoded")
    vector = fit(stored.where(~F.col("held_out")), lexicon, rounds, sample)
    bare = stored.drop("others")
    scored = bare.mapInArrow(_scorer(lexicon, vector), bare.drop("symbols").schema.add("model_log", "double"))
    words = stored.select("row", F.explode("others").alias("word"))
    met = words.join(counts, "word")
    rest = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more_log"), F.count(F.lit(1)).alias("more_known"))
    joined = scored.join(rest, "row", "left")
    more, found = F.coalesce("more_log", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return joined.select(
        "doc_id", "text_key", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"),
        F.lit(int(lexicon.n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_log") + more - F.col("n_tokens") * F.lit(lexicon.base_floor)).alias("base_score"),
        (F.col("model_log") + F.col("rare_log") + more - F.col("rare_n") * F.lit(lexicon.rare_floor)).alias("score"))
