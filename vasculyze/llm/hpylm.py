"""A hierarchical Pitman-Yor language model over whole words.

Restaurants: one per previous word (and one for the start of a text), all with the same parent, the word restaurant, whose own
base is uniform over the training vocabulary and one unknown word. Every context that the corpus has gets its restaurant.

Seats: a dish is a word in a restaurant. Its customers sit at tables, and each table of a context is a customer of its word in
the word restaurant. A Gibbs round unseats all customers of every dish and seats them again: given the other restaurants, a
dish of c customers has t tables with probability in proportion to S(c, t) * w^t, where S are the generalised Stirling numbers
of the discount and w is the weight of a new table, (strength + discount * tables of the context) * P(word). Tables are drawn
from just this law (customers beyond EXACT: from its saddle point, whose error falls as 1/c). All dishes of a round are drawn
at once, from the totals that the round before left, and their tables go to the parent, whose dishes are drawn likewise.
After BURN rounds, predictive probabilities are averaged over KEEP rounds. The discounts are estimated from counts of counts.

Flow: texts become blocks, stored as word numbers with the block's vocabulary as 64-bit hashes. Hashes of words, and of pairs,
are dealt out to buckets of the hash range, as packed arrays, a row for each block and bucket: a hot word is one number per
block, whatever its share of the corpus. Buckets add up counts and answer each block in the order in which it asked. Of pairs
that occur once, nothing is left to draw; for each of the others one block tells the bucket the two words, and rounds are
messages between buckets of pairs and buckets of words. Texts, counts and model never meet in one place.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, forget, let_go, release, small_batches, splitmix, tidy, written

#: Characters of a block, training tokens that a bucket stands for, rows of an Arrow batch of packed arrays.
BLOCK_CHARS, BUCKET_TOKENS, PACKED_ROWS = 12_000_000, 2_500_000, 32
#: Rounds before those that are averaged, and these; customers up to which the law of tables is summed term by term.
BURN, KEEP, EXACT = 2, 2, 256
#: Strengths of contexts and of the word restaurant.
STRENGTH = (2.0, 50.0)
#: No word is empty or a blank: the end of a text, and the context before its first word.
END = b""
H_END, H_START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (END, b" "))

_BLOCK = "block bigint, keys binary, nulls binary, sizes binary, held binary, tokens binary, vocabulary binary, counts binary, n bigint"
#: A message: to a block or bucket from another, with packed arrays and sums.
_MESSAGE = "dst bigint, src bigint, a binary, b binary, c binary, d binary, x double, y double"
_NAMES = ["dst", "src", "a", "b", "c", "d", "x", "y"]


def pack(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unpack(b, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_rising(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_rising(b, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of ascending hashes begins; and the end."""
    return np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _uniform(names: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on names and salt alone."""
    return ((splitmix(names ^ splitmix(np.full(1, salt, np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


# Seats.


class Tables:
    """Draws the number of tables of dishes with so many customers, for one discount."""

    def __init__(self, discount: float):
        self.d, self.rows = discount, [np.zeros(1)]

    def stirling(self, c: int) -> np.ndarray:
        """log S(c, t) for t from 1 to c, of the generalised Stirling numbers: sums over seatings of (1-d)(2-d)...(size-1-d)."""
        while len(self.rows) < c:
            n, last = len(self.rows), self.rows[-1]
            t = np.arange(1, n + 1)
            stay = np.append(last + np.log(n - t * self.d), -np.inf)
            self.rows.append(np.logaddexp(stay, np.concatenate([[-np.inf], last])))
        return self.rows[c - 1]

    def draw(self, count: np.ndarray, weight: np.ndarray, names: np.ndarray, salt: int) -> np.ndarray:
        """count: customers of each dish; weight: of a new table. -> tables."""
        out = np.minimum(count, 1).astype(np.int64)
        some = np.flatnonzero(count > 1)
        order = some[np.argsort(count[some], kind="stable")]
        u, log_w = _uniform(names[order], 2 * salt), np.log(weight[order])
        c = count[order]
        for n, a, z in zip(*(x.tolist() for x in _runs(c[c <= EXACT]))):
            s, t = self.stirling(n), np.arange(1, n + 1)
            step = max(1, 2_000_000 // n)
            for i in range(a, z, step):
                k = slice(i, min(z, i + step))
                law = s + t * log_w[k, None]
                law = np.cumsum(np.exp(law - law.max(1, keepdims=True)), axis=1)
                out[order[k]] = 1 + np.minimum((law < u[k, None] * law[:, -1:]).sum(1), n - 1)
        many = order[c > EXACT]
        if len(many):
            mean, sd = self.saddle(count[many].astype(float), weight[many])
            v = _uniform(names[many], 2 * salt + 1)
            z = np.sqrt(-2 * np.log(u[c > EXACT])) * np.cos(2 * np.pi * v)
            out[many] = np.clip(np.rint(mean + sd * z), 1, count[many])
        return out

    def saddle(self, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the tables of many customers. One customer's table stands for itself; the others, of all
        sizes, are as Poisson with generating function w * (1 - (1-x)^d) / d, given the customers' number: x is where the
        expected number is c."""
        low, high = np.zeros(len(c)), np.full(len(c), 300.0)  # of y = -log(1 - x)
        for _ in range(60):
            y = (low + high) / 2
            less = -np.expm1(-y) * (w * np.exp((1 - self.d) * y) + (1 - self.d) * np.exp(y)) < c - 1
            low, high = np.where(less, y, low), np.where(less, high, y)
        y = (low + high) / 2
        x, g1 = -np.expm1(-y), np.exp((1 - self.d) * y)
        others = w * -np.expm1(-self.d * y) / self.d
        cross = w * x * g1
        spread = cross + (1 - self.d) * (w * x * x * g1 * np.exp(y) + x * np.exp(2 * y))
        return 1 + others, np.sqrt(np.maximum(others - cross * cross / spread, 0))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of an ascending array with the begin and end of each."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[begin], begin, np.append(begin[1:], len(x)) if len(x) else begin


def discount(ones: float, twos: float) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones + twos else 0.5


# Blocks.


def _blocks(mod: int, held: int):
    """Texts to blocks. A block's name is its task's number and its own in the task; the table is written once."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), itertools.count()

        def close():
            words, tokens = list(vocabulary), np.concatenate(ids)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            out = np.fromiter((zlib.crc32(b"" if k is None else str(k).encode()) % mod == held for k in keys), np.bool_, len(keys))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            counts = np.bincount(tokens[~np.repeat(out, size)], minlength=len(words))
            hashes, counts = np.append(hashes, H_START), np.append(counts, (~out).sum())
            order = np.argsort(hashes)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            packed = [pack(np.array([0 if k is None else k for k in keys], np.int64)), pack(np.array([k is None for k in keys])), pack(size.astype(np.uint32)), pack(out), pack(rank[tokens]), pack_rising(hashes[order]), pack(counts[order].astype(np.uint32))]
            n = int(counts.sum() - (~out).sum())
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | next(seq)], pa.int64()), *(pa.array([x], pa.binary()) for x in packed), pa.array([n], pa.int64())], names=[x.split()[0] for x in _BLOCK.split(", ")])

        keys, ids, chars = [], [], 0
        vocabulary: dict[bytes, int] = defaultdict(itertools.count().__next__)
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if keys and chars + len(x) > BLOCK_CHARS:
                    yield close()
                    keys, ids, chars = [], [], 0
                    vocabulary = defaultdict(itertools.count().__next__)
                ws = x.lower().split()
                ws.append(END)
                ids.append(np.fromiter(map(vocabulary.__getitem__, ws), np.uint32, len(ws)))
                keys.append(k)
                chars += len(x)
        if keys:
            yield close()

    return run


class Block:
    """A block read back, with its pairs in the order of their hashes."""

    def __init__(self, row: dict, pairs: bool = True):
        self.vocabulary = unpack_rising(row["vocabulary"])
        self.sizes, self.held = unpack(row["sizes"], np.uint32).astype(np.int64), unpack(row["held"], np.bool_)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        if not pairs:
            return
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = np.searchsorted(self.vocabulary, H_START)
        h = splitmix(splitmix(self.vocabulary[context]) + self.vocabulary[self.tokens])
        self.pairs, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        self.context, self.word = context[first], self.tokens[first]

    def training(self) -> np.ndarray:
        return np.bincount(self.at, ~np.repeat(self.held, self.sizes), len(self.pairs)).astype(np.uint32)


def _each(make):
    """A mapInArrow function: for each row, the messages that make(row) gives."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from _messages(make(row)).to_batches()

    return tidy(run)


def _per_bucket(make):
    """A function of a bucket's messages (and of a second table's, if there is one)."""

    def run(*tables: pa.Table) -> pa.Table:
        let_go()
        out = _messages(make(*(t.sort_by([("src", "ascending")]).to_pylist() for t in tables)))
        release()
        return out

    return (lambda key, table: run(table)) if make.__code__.co_argcount == 1 else (lambda key, left, right: run(left, right))


# Counts of words and of pairs.


def _ask_words(buckets: int):
    def make(row):
        h, n = unpack_rising(row["vocabulary"]), unpack(row["counts"], np.uint32)
        cut = _cuts(h, buckets)
        return [(i, row["block"], pack_rising(h[a:z]), pack(n[a:z])) for i, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]

    return _each(make)


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hashes that the messages have, their sums, and where each message's are."""
    hashes, counts = [unpack_rising(r["a"]) for r in rows], [unpack(r["b"], np.uint32) for r in rows]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
    return every, total, np.split(at, np.cumsum([len(x) for x in hashes])[:-1])


def _count_words(rows):
    """src -1: the bucket's words with their counts, x tokens and y words; else where a block's words are among them."""
    h, n, where = _merged(rows)
    words = n[h != H_START]
    out = [(r["dst"], r["src"], pack_rising(at.astype(np.uint32))) for r, at in zip(rows, where)]
    return [(rows[0]["dst"], -1, pack_rising(h), pack(n), None, None, float(words.sum()), float((words > 0).sum())), *out]


def _ask_pairs(buckets: int):
    def make(row):
        b = Block(row)
        n, cut = b.training(), _cuts(b.pairs, buckets)
        return [(i, row["block"], pack_rising(b.pairs[a:z]), pack(n[a:z])) for i, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]

    return _each(make)


def _count_pairs(rows):
    """To each block: the counts of its pairs up to 2, and of those with more than one customer the dish's number and (b) the
    count where this block is to name its words, else 0. x, y: dishes with one and with two customers, in the first answer."""
    _, n, where = _merged(rows)
    number = np.cumsum(n > 1) - 1
    owned, out = np.zeros(len(n), np.bool_), []
    for i, (r, at) in enumerate(zip(rows, where)):
        many = n[at] > 1
        dish = at[many]
        own = many[many] & (unpack(r["b"], np.uint32)[many] > 0) & ~owned[dish]
        owned[dish[own]] = True
        sums = (float((n == 1).sum()), float((n == 2).sum())) if i == 0 else (0.0, 0.0)
        out.append((r["src"], r["dst"], pack(np.minimum(n[at], 2).astype(np.uint8)), pack_rising(number[dish].astype(np.uint32)), pack(np.where(own, n[dish], 0)), None, *sums))
    return out


def _name_dishes(blocks: list[dict], answers: list[dict]):
    """A block's answers (ascending buckets) -> to each bucket: dish, context's hash, word's hash, customers."""
    if not blocks:
        return []
    b, at, out = Block(blocks[0]), 0, []
    for r in answers:
        n = unpack(r["a"], np.uint8)
        own = unpack(r["c"], np.int64)
        mine = np.flatnonzero(n == 2)[own > 0] + at
        if len(mine):
            out.append((r["src"], r["dst"], pack(unpack_rising(r["b"], np.uint32)[own > 0]), pack(b.vocabulary[b.context[mine]]), pack(b.vocabulary[b.word[mine]]), pack(own[own > 0])))
        at += len(n)
    return out


def _gather_dishes(rows):
    """A bucket's dishes in their order: words that they have, each dish's context and word among them, customers."""
    dish, context, word, n = (np.concatenate([unpack(r[k], t) for r in rows]) for k, t in zip("abcd", (np.uint32, np.uint64, np.uint64, np.int64)))
    order = np.argsort(dish)
    words, at = np.unique(np.concatenate([context[order], word[order]]), return_inverse=True)
    at = at.astype(np.uint32)
    return [(rows[0]["dst"], 0, pack_rising(words), pack(at[: len(dish)]), pack(at[len(dish) :]), pack(n[order]))]


# Rounds: buckets of pairs and buckets of words in turn.


def _tell(row: dict, tables: np.ndarray, buckets: int) -> list[tuple]:
    """To each bucket of words: its words here; tables less customers as context, and as dish."""
    words, context, word, n = unpack_rising(row["a"]), unpack(row["b"], np.uint32), unpack(row["c"], np.uint32), unpack(row["d"], np.int64)
    less = [np.bincount(x, n - tables, len(words)).astype(np.int64) for x in (context, word)]
    cut = _cuts(words, buckets)
    return [(i, row["dst"], pack_rising(words[a:z]), *(pack(x[a:z]) for x in less)) for i, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]


def _first(buckets: int):
    """Every dish at one table."""
    return _each(lambda row: _tell(row, np.ones(len(unpack(row["d"], np.int64)), np.int64), buckets))


def _seat_words(d: float | None, weight: float, salt: int):
    """A bucket's words and what buckets of pairs tell -> src -1: tables as context, customers and tables in the word restaurant
    (x, y: their sums); to each bucket of pairs: tables as context and customers less discounts, of its words."""

    def make(words, told):
        h, n = unpack_rising(words[0]["a"]), unpack(words[0]["b"], np.int64)
        as_context, as_dish, where = n * (h != H_END), n * (h != H_START), []
        for r in told:
            at = np.searchsorted(h, unpack_rising(r["a"]))
            where.append(at)
            as_context[at] -= unpack(r["b"], np.int64)
            as_dish[at] -= unpack(r["c"], np.int64)
        if d is None:
            return [(words[0]["dst"], -1, None, None, None, None, float((as_dish == 1).sum()), float((as_dish == 2).sum()))]
        t = Tables(d).draw(as_dish, np.full(len(h), weight), h, salt)
        out = [(words[0]["dst"], -1, pack(as_context), pack(as_dish), pack(t), None, float(as_dish.sum()), float(t.sum()))]
        left = (as_dish - d * t).astype(np.float32)
        return out + [(r["src"], words[0]["dst"], pack(as_context[at]), pack(left[at])) for r, at in zip(told, where)]

    return _per_bucket(make)


def _seat_pairs(d: float, d0: float, customers: float, tables: float, types: int, salt: int, buckets: int):
    """A bucket's dishes and the answers of buckets of words -> src -1: each dish's tables; and what it tells them next."""

    def make(dishes, answers):
        row = dishes[0]
        context, word, n = (unpack(row[k], t) for k, t in zip("bcd", (np.uint32, np.uint32, np.int64)))
        total, left = np.concatenate([unpack(r["a"], np.int64) for r in answers]), np.concatenate([unpack(r["b"], np.float32) for r in answers])
        p = (left + (STRENGTH[1] + d0 * tables) / (types + 1)) / (STRENGTH[1] + customers)
        names = splitmix(np.arange(len(n), dtype=np.uint64) + (np.uint64(row["dst"]) << np.uint64(40)))
        t = Tables(d).draw(n, ((STRENGTH[0] + d * total.astype(float))[context] * p[word]), names, salt)
        return [(row["dst"], -1, pack(t)), *_tell(row, t, buckets)]

    return _per_bucket(make)


# Scores.


def _answer_pairs(d: float):
    """To each block: of its pairs, customers less the discounts of the mean tables; src is the bucket."""

    def make(asked, states):
        tables = sum(unpack(r["a"], np.int64).astype(float) for r in states) / max(1, len(states)) if states else np.zeros(0)
        n = np.zeros(len(tables))
        for r in asked:
            dish, own = unpack_rising(r["b"], np.uint32), unpack(r["c"], np.int64)
            n[dish[own > 0]] = own[own > 0]
        left = (n - d * tables).astype(np.float32)
        return [(r["src"], 2 * r["dst"], r["a"], pack(left[unpack_rising(r["b"], np.uint32)])) for r in asked]

    return _per_bucket(make)


def _answer_words(d0: float, sums: list[tuple[float, float]], types: int):
    """To each block: of its words, counts, and for each kept round tables as context and P(word)."""

    def make(asked, states):
        n = next(unpack(r["b"], np.int64) for r in asked if r["src"] < 0)
        rounds = []
        for r in states:
            c, t = unpack(r["b"], np.int64), unpack(r["c"], np.int64)
            customers, tables = sums[int(r["x"])]
            rounds.append((unpack(r["a"], np.int64), ((c - d0 * t + (STRENGTH[1] + d0 * tables) / (types + 1)) / (STRENGTH[1] + customers)).astype(np.float32)))
        out = []
        for r in asked:
            if r["src"] >= 0:
                at = unpack_rising(r["a"], np.uint32)
                out.append((r["src"], 2 * r["dst"] + 1, pack(n[at]), pack(np.concatenate([c[at] for c, _ in rounds])), pack(np.concatenate([p[at] for _, p in rounds]))))
        return out

    return _per_bucket(make)


def _score(d: float, n: int, v: int):
    """A block and its answers: a row per document."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        let_go()
        answers = right.sort_by([("src", "ascending")]).to_pylist()
        del right
        rows = left.to_pylist()
        if not rows:
            return pa.table({"key": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        row = rows[0]
        b = Block(row)
        some, sure = [], []
        for r in answers:
            if r["src"] % 2:
                some.append((unpack(r["a"], np.int64), unpack(r["b"], np.int64).reshape(KEEP, -1), unpack(r["c"], np.float32).reshape(KEEP, -1)))
            else:
                code = unpack(r["a"], np.uint8)
                x = np.where(code == 1, 1 - d, 0.0)
                x[code == 2] = unpack(r["b"], np.float32)
                sure.append(x)
        count, tables, p0 = (np.concatenate([x[i] for x in some], axis=-1) for i in range(3))
        heads = np.where(b.vocabulary == H_END, 0, count)[b.context] + STRENGTH[0]
        p = np.concatenate(sure)
        for k in range(KEEP):
            p += (STRENGTH[0] + d * tables[k, b.context]) * p0[k, b.word] / KEEP
        p = np.log10(p / heads)
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
        sums = lambda x: np.bincount(doc, x, len(b.sizes))
        base = np.log10((count + 1.0) / (n + 1 * (v + 1)))
        keys = pa.array(unpack(row["keys"], np.int64), mask=unpack(row["nulls"], np.bool_))
        out = [keys, pa.array(b.held), pa.array(b.sizes), pa.array(sums(count[b.tokens] > 0).astype(np.int64)), pa.array(sums(base[b.tokens])), pa.array(sums(p[b.at]))]
        release()
        return pa.Table.from_arrays(out, names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, *, key: str = "doc_id", mod: int = 7, held: int = 2, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from rows whose crc32 of the key's text, modulo `mod`, is not `held`. Null texts are empty: one end token. A
    null key hashes as empty text. Repeated rows each count and come back, as do rows of one id with different texts; an
    empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(setting)
    blocks = written(docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(tidy(_blocks(mod, held)), _BLOCK), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).head()[0] or 0
    buckets = max(1, -(-tokens // bucket_tokens))
    try:
        spark.conf.set(setting, PACKED_ROWS)
        scored = _scored(blocks, buckets)
    finally:
        spark.conf.set(setting, rows)
    return scored.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _scored(blocks: DataFrame, buckets: int) -> DataFrame:
    per = lambda df, f: df.groupBy("dst").applyInArrow(_per_bucket(f), _MESSAGE)
    both = lambda a, b, f: a.groupBy("dst").cogroup(b.groupBy("dst")).applyInArrow(f, _MESSAGE)

    words = written(per(blocks.select("block", "vocabulary", "counts").mapInArrow(_ask_words(buckets), _MESSAGE), _count_words), "lm-words")
    table = words.where("src < 0")
    n, v = (int(x or 0) for x in table.agg(F.sum("x"), F.sum("y")).head())
    whole = blocks.select("block", "sizes", "held", "tokens", "vocabulary")
    pairs = written(per(whole.mapInArrow(_ask_pairs(buckets), _MESSAGE), _count_pairs), "lm-pairs")
    forget(blocks.sparkSession)
    d = discount(*(x or 0.0 for x in pairs.agg(F.sum("x"), F.sum("y")).head()))
    named = whole.withColumnsRenamed({"block": "dst"}).withColumn("src", F.lit(0)).groupBy("dst").cogroup(pairs.groupBy("dst")).applyInArrow(_per_bucket(_name_dishes), _MESSAGE)
    dishes = written(per(named, _gather_dishes), "lm-dishes")
    forget(blocks.sparkSession)

    told = dishes.mapInArrow(_first(buckets), _MESSAGE)
    d0 = discount(*(x or 0.0 for x in both(table, told, _seat_words(None, 0.0, 0)).agg(F.sum("x"), F.sum("y")).head()))
    tables, kept, sums, state = float(v), [], [], None
    for i in range(BURN + KEEP + 1):
        weight = (STRENGTH[1] + d0 * tables) / (v + 1)
        seated = written(both(table, told, _seat_words(d0, weight, 2 * i)), "lm-seats")
        customers, tables = (float(x or 0) for x in seated.where("src < 0").agg(F.sum("x"), F.sum("y")).head())
        if i > BURN:
            kept.append((seated, state))
            sums.append((customers, tables))
        elif state is not None:
            drop(state)
        if i < BURN + KEEP:
            state = written(both(dishes, seated.where("src >= 0"), _seat_pairs(d, d0, customers, tables, v, 2 * i + 1, buckets)), "lm-tables")
            told = state.where("src >= 0")
        if i <= BURN:
            drop(seated)

    named_by = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "a", "b", "c", "d", "x", "y")
    states = kept[0][1].where("src < 0")
    seats = kept[0][0].where("src < 0").withColumn("x", F.lit(0.0))
    for i, (seated, state) in enumerate(kept[1:], 1):
        states = states.unionByName(state.where("src < 0"))
        seats = seats.unionByName(seated.where("src < 0").withColumn("x", F.lit(float(i))))
    seats = seats.withColumn("src", F.col("x").cast("long"))
    # Answers of pairs name themselves 2 * bucket, of words 2 * bucket + 1; a block reads each in the order of buckets.
    answers = both(named_by, states, _answer_pairs(d)).unionByName(both(words, seats, _answer_words(d0, sums, v)))
    answers = written(answers, "lm-answers")
    drop(words, pairs, dishes, *itertools.chain(*kept))
    rows = blocks.select(F.col("block").alias("dst"), "keys", "nulls", "sizes", "held", "tokens", "vocabulary")
    out = rows.groupBy("dst").cogroup(answers.groupBy("dst")).applyInArrow(_score(d, n, v), "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op3(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
