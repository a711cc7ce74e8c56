"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, and every document's set with
it. Two sets that link at threshold t differ in at most H = (1-t)/(1+t) * (|A|+|B|) n-grams, so of m > H fragments at
least m-H hold the same n-grams in both: documents that agree on a fragment are candidates. H depends on size, so sizes
form levels; a document takes part in its own level, and in the one below if that holds sizes it can link with.

Fragments that are empty in both agree too, which says nothing. So m has spare fragments, more than a set of the level
nearly ever has empty; sets that have still more empty ones also send those, and are compared apart, bucket by bucket.
Where small sizes leave no room for that, the fragment is the order's prefix: its n-grams stand alone.

Fragments of nothing but common n-grams (a passage that many texts quote) would make candidates of all who quote it. So m
has a few more, and a set whose common fragments are so few leaves them out; sets with more keep them. Two sets that link
agree on more fragments than one of them leaves out. In the prefix's order common n-grams come last. Which n-grams count as common is learnt from a sample of texts and changes the candidates' number, never the links.

Candidates become classes by connected components, equal sets having been one node from the start. A class too large for
one task is first broken up by an exact bound: sets keep a bitmap of the parities of their n-grams' hash buckets, and no
two bitmaps differ in more bits than their sets in n-grams. In a class, overlaps are counted fragment by fragment over
the n-grams that sets share, and summed per pair. What is still large is cut into blocks of documents and every pair of
blocks is a task of its own, so no task grows with a class; only links come back, as trees, and components of those are
the result.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, let_go, release, small_batches, splitmix, tidy, written

#: A verifying task's documents and n-grams, and a bitmap task's documents, of each of two blocks; shared n-grams of a
#: fragment; words remembered; rows held back.
BLOCK_DOCS, BLOCK_GRAMS, BLOCK_MAPS, FRAGMENT, KNOWN_WORDS, HELD_ROWS = 1200, 1_000_000, 16_000, 4096, 200_000, 1_500_000
#: Texts that common n-grams are learnt from, about; texts of these that hold a common one, at least; common ones, at most.
SAMPLE, COMMON_TEXTS, MOST_COMMON = 16_000, 8, 100_000
#: Common fragments that a set may leave out: so many, and this share of those that may differ.
OUT_LEAST, OUT_SHARE = 3, 0.05


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sets of n-gram hashes, ascending, of whole texts. A-Z count as a-z; words are cut at \\x20 and \\x09-\\x0D."""

    def __init__(self, n: int):
        self.n, self.known = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, ws), np.uint64, len(ws))
        n = min(self.n, len(ws))
        out = splitmix(h[: len(h) - n + 1] + np.uint64(n))
        for j in range(1, n):
            out = splitmix(out ^ h[j : len(h) - n + 1 + j])
        return np.unique(out)


class Levels:
    """Size levels for a threshold of `percent`: level k holds sizes from starts[k]; none links beyond the middle of the next."""

    def __init__(self, percent: int, common: np.ndarray | None = None):
        self.percent, self.starts, self._m, self._cuts = percent, [1], {}, {}
        #: By the low bits of an n-gram, so that one in some hundreds counts as common by chance; None if nothing is.
        self.common = None
        if common is not None and len(common):
            self.common = np.zeros(1 << 22, np.bool_)
            self.common[(common & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def reach(self, size: int) -> int:
        """The largest size that can link with this."""
        return 100 * size // self.percent

    def differ(self, sizes):
        """H, from the sum of two sizes."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.reach(self.reach(self.starts[-1]) + 1) + 1)
        return bisect.bisect_right(self.starts, size) - 1

    def taken(self, size: int) -> list[int]:
        """The levels of a size."""
        k = self.of(size)
        return [k, k - 1] if k and self.reach(self.starts[k] - 1) >= size else [k]

    def fragments(self, k: int) -> tuple[int, int, int]:
        """m, the spare ones among them, and common ones that a set may leave out; m is 0 where the prefix serves, 1 where only equal sets link."""
        if k not in self._m:
            a = self.starts[k + 1] - 1
            least = self.differ(a + self.reach(a)) + 1
            n = self.starts[k]
            out = OUT_LEAST + int(OUT_SHARE * least) if self.common is not None else 0
            m, self._m[k] = least + out, (0, 0, 0)
            for _ in range(12):
                empty = m * (1 - 1 / m) ** n
                more = least + out + math.ceil(empty + 3 * math.sqrt(empty))
                if least == 1:
                    self._m[k] = (1, 0, 0)
                    break
                if more == m:
                    self._m[k] = (m, m - least - out, out)
                    break
                m = more
        return self._m[k]

    def is_common(self, grams: np.ndarray) -> np.ndarray:
        if self.common is None:
            return np.zeros(len(grams), np.bool_)
        return self.common[(grams & np.uint64(len(self.common) - 1)).astype(np.int64)]

    def cuts(self, m: int) -> np.ndarray:
        if m not in self._cuts:
            self._cuts[m] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
        return self._cuts[m]

    def signatures(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a set: a hash for each fragment that holds something, and for each empty one where they are too many, by level."""
        n, common = len(grams), self.is_common(grams)
        upto = np.concatenate([[0], np.cumsum(common)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(splitmix(grams), dtype=np.uint64)])
        full, empty = [NONE], [NONE]
        for k in self.taken(n):
            m, spare, out = self.fragments(k)
            if m == 1:
                continue
            if not m:
                front = np.concatenate([grams[~common], grams[common]])[: n - -(-n * self.percent // 100) + 1]
                full.append(splitmix(front ^ splitmix(np.array([k + (1 << 60)], np.uint64))))
                continue
            at = np.concatenate([[0], np.searchsorted(grams, self.cuts(m)), [n]])
            name = np.arange(m, dtype=np.uint64) + np.uint64(k << 40)
            holds = at[1:] > at[:-1]
            quoted = holds & (upto[at[1:]] - upto[at[:-1]] == at[1:] - at[:-1])
            sent = holds if quoted.sum() > out else holds & ~quoted
            full.append(splitmix((total[at[1:]] - total[at[:-1]]) ^ splitmix(name))[sent])
            if m - holds.sum() > spare:
                empty.append(splitmix(name[~holds]))
        return np.concatenate(full), np.concatenate(empty)


NONE = np.zeros(0, np.uint64)


def node_of(grams: np.ndarray) -> int:
    """A set's 64-bit name, from two sums over it and its size; as a signed number."""
    a, b = np.bitwise_xor.reduce(splitmix(grams)), np.add.reduce(splitmix(~grams), dtype=np.uint64)
    x = splitmix(np.array([a], np.uint64) ^ splitmix(np.array([b], np.uint64) + np.uint64(len(grams))))
    return int(x.view(np.int64)[0])


def bitmap(grams: np.ndarray) -> bytes:
    """Parities of the hash buckets, at least two buckets for each n-gram; bucket numbers are low bits, so that halves fold."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length())
    odd = np.bincount((splitmix(grams ^ np.uint64(0xB17)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _documents(n: int, percent: int):
    """(key, at, text) -> (key, at, node, n, bits)."""

    def run(batches):
        shingle = Shingler(n)
        for b in batches:
            sets = [shingle(x.as_py()) for x in b.column(2)]
            cols = [pa.array([node_of(g) if len(g) else 0 for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([bitmap(g) if len(g) else b"" for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["key", "at", "node", "n", "bits"])

    return tidy(run)


def _grams(n: int):
    """Texts -> the n-grams of each, once."""

    def run(batches):
        shingle = Shingler(n)
        for b in batches:
            sets = [shingle(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([NONE, *sets]).view(np.int64))], names=["gram"])

    return tidy(run)


def common_grams(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of n-grams that many texts hold, ascending: from about SAMPLE texts, the same in each run, equal ones counted once."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    found = some.mapInArrow(_grams(n), "gram bigint").groupBy("gram").count().where(F.col("count") >= COMMON_TEXTS)
    rows = found.orderBy(F.desc("count"), "gram").limit(MOST_COMMON).select("gram").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _signatures(n: int, percent: int, common: np.ndarray | None = None):
    """Texts -> (sig, node, empty): of equal fragments within a task one row goes on, and the others as links to it,
    each link being a signature of its own that two rows have."""

    def run(batches):
        shingle, levels = Shingler(n), Levels(percent, common)
        held, count, gone = [], 0, set()

        def rows(sig, node, empty):
            for a in range(0, len(sig), 200_000):
                z = slice(a, a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(sig[z].view(np.int64)), pa.array(node[z]), pa.array(np.full(len(node[z]), empty))], names=["sig", "node", "empty"])

        def flush():
            sig, node, empty = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, sig))
            sig, node, empty = sig[order], node[order], empty[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            least = node[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            link = ~first & ~empty & (node != least)
            if link.any():
                pairs = np.unique(np.stack([least[link], node[link]], 1), axis=0)
                name = splitmix(splitmix(pairs[:, 0].copy().view(np.uint64)) ^ pairs[:, 1].copy().view(np.uint64))
                yield from rows(np.repeat(name, 2), pairs.ravel(), False)
            for mask, e in ((first & ~empty, False), (empty, True)):
                yield from rows(sig[mask], node[mask], e)

        for b in batches:
            for text in b.column(0):
                g = shingle(text.as_py())
                if not len(g) or (node := node_of(g)) in gone:
                    continue
                gone.add(node)
                full, empty = levels.signatures(g)
                if k := len(full) + len(empty):
                    held.append((np.concatenate([full, empty]), np.full(k, node, np.int64), np.arange(k) >= len(full)))
                    count += k
            if count > HELD_ROWS:
                yield from flush()
                held, count, gone = [], 0, set()
        if held:
            yield from flush()

    return tidy(run)


def _forest(near, n: int) -> list[tuple[int, int]]:
    """Trees over 0..n-1: near(front, rest) says which of rest some of front is near to."""
    rest, edges = np.arange(n), []
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            hit = near(front, rest)
            front, rest = rest[hit], rest[~hit]
            edges.extend((root, x) for x in front)
    return edges


def _compatible(percent: int):
    """A pair of blocks of a large class: trees of documents whose bitmaps and sizes leave a link possible."""

    def run(key, table):
        let_go()
        levels = Levels(percent)
        node, at = np.unique(table["node"].to_numpy(), return_index=True)
        size, column = table["n"].to_numpy()[at], table["bits"].combine_chunks()
        del table
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        maps = [np.frombuffer(column.buffers()[2], np.uint64, (ends[i + 1] - ends[i]) // 8, ends[i]) for i in at.tolist()]
        own = np.fromiter(map(levels.of, size.tolist()), np.int64, len(size))
        out = []
        for k in np.unique(own):
            at = np.flatnonzero((own == k) | ((own == k + 1) & (size <= levels.reach(levels.starts[k + 1] - 1))))
            words = min(len(maps[i]) for i in at)
            bits = np.stack([np.bitwise_xor.reduce(maps[i].reshape(-1, words), axis=0) for i in at])
            s = size[at]

            def near(front, rest, bits=bits, s=s):
                hit = np.zeros(len(rest), np.bool_)
                step = max(1, 4_000_000 // (len(rest) * bits.shape[1] + 1))
                for a in range(0, len(front), step):
                    f, r = front[a : a + step], rest[~hit]
                    if not len(r):
                        break
                    apart = np.bitwise_count(bits[f][:, None, :] ^ bits[r][None, :, :]).sum(2, dtype=np.int64)
                    hit[np.flatnonzero(~hit)] = (apart <= levels.differ(s[f][:, None] + s[r][None, :])).any(0)
                return hit

            out.extend((node[at[a]], node[at[b]]) for a, b in _forest(near, len(at)))
        del maps, column, ends
        release()
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(np.array(a, np.int64)), "b": pa.array(np.array(b, np.int64))})

    return run


def _verify(n: int, percent: int):
    """One pair of blocks of a class: trees of links, and how many documents each node links to."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        pdf = pdf.drop_duplicates("node").reset_index(drop=True)
        shingle = Shingler(n)
        sets = [shingle(x) for x in pdf["text"]]
        k = len(sets)
        sizes = np.fromiter(map(len, sets), np.int64, k)
        grams, doc = np.concatenate(sets), np.repeat(np.arange(k), sizes)
        order = np.argsort(grams, kind="stable")
        grams, doc = grams[order], doc[order]
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        run_of = np.cumsum(new) - 1
        shared = np.bincount(run_of)[run_of] > 1
        _, col = np.unique(run_of[shared], return_inverse=True)
        doc = doc[shared]
        overlap = np.zeros((k, k), np.float32)
        ends = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + FRAGMENT, FRAGMENT))
        for a, b in zip(ends[:-1], ends[1:]):
            if b > a:
                part = np.zeros((k, FRAGMENT), np.float32)
                part[doc[a:b], col[a:b] % FRAGMENT] = 1
                overlap += part @ part.T
        o = np.rint(overlap).astype(np.int64)
        link = 100 * o >= percent * (sizes[:, None] + sizes[None, :] - o)
        np.fill_diagonal(link, False)
        block, group = pdf["block"].to_numpy(), pdf["class"].to_numpy()
        _, i, j, empty = (int(x) for x in key)
        if i != j:
            link &= block[:, None] != block[None, :]
        if empty:
            link &= group[:, None] != group[None, :]
        node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        del overlap, o, grams, doc, order
        if k > BLOCK_DOCS // 4:
            release()
        if empty:
            a, b = np.nonzero(np.triu(link))
            return pd.DataFrame({"a": node[a], "b": node[b], "la": copies[b], "lb": copies[a]})
        links = link @ copies
        tree = _forest(lambda front, rest: link[np.ix_(front, rest)].any(0), k)
        a, b = (np.array(x, np.int64) for x in zip(*tree)) if tree else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"a": np.concatenate([node[a], node[some]]), "b": np.concatenate([node[b], node[some]]), "la": np.concatenate([np.zeros(len(a), np.int64), links[some]]), "lb": np.zeros(len(a) + len(some), np.int64)})

    return run


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for every pair (i, j) of its group's blocks that its block is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def classes(docs: DataFrame, *, n: int = 3, percent: int = 90, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (the least key that links reach, its own included), n_links.

    Texts of one word or two have one shingle, the whole; null texts and texts with no word have none, and link with
    nothing. n_links counts the other rows that the row links to directly, copies included. Rows with equal sets link;
    repeated rows each come back. A null key is never a component's least unless all of its keys are null. Sets stand by
    64-bit hashes: two different sets are taken for one with a chance of 2^-64 a pair.
    """
    return _classes(docs, n=n, percent=percent, key=key).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "n_links")


def _classes(docs: DataFrame, *, n: int, percent: int, key: str) -> DataFrame:
    """Per row of docs: key, at (the hash of key and text), n, component (null where the text has no shingle), component_id, n_links."""
    small_batches(docs.sparkSession)
    at = F.xxhash64(key, "text")
    rows = written(docs.select(F.col(key).cast("long").alias("key"), at.alias("at"), "text").mapInArrow(_documents(n, percent), "key bigint, at bigint, node bigint, n bigint, bits binary"), "sets")
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"), F.min("at").alias("at"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "nodes")

    # Each task gave one row per fragment (and links as pairs), so a group here has as many rows as there were tasks, at most.
    w = Window.partitionBy("sig")
    sigs = docs.select("text").mapInArrow(_signatures(n, percent, common_grams(docs, n)), "sig bigint, node bigint, empty boolean")
    agree = sigs.select("sig", "node", "empty", F.min("node").over(w).alias("least"), F.max("node").over(w).alias("most"))
    agree = written(agree.where("least <> most and (empty or node <> least)"), "agreeing")
    group = written(components(agree.where("not empty"), "node", "least").select("node", F.col("component").alias("class")), "classes")

    # Large classes, broken up by the bitmaps' bound.
    sizes = group.join(nodes.select("node", "n"), "node")
    large = sizes.groupBy("class").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams")).where((F.col("docs") > BLOCK_DOCS) | (F.col("grams") > BLOCK_GRAMS)).withColumn("blocks", F.ceil(F.col("docs") / BLOCK_MAPS).cast("int"))
    bits = rows.where("n > 0").select("node", "n", "bits").join(sizes.join(large.select("class", "blocks"), "class").select("node", "class", "blocks"), "node").dropDuplicates(["node"])
    bits = _in_pairs(bits.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))).select("class", "i", "j", "node", "n", "bits")
    likely = components(bits.groupBy("class", "i", "j").applyInArrow(_compatible(percent), "a bigint, b bigint"))
    parts = group.join(large.select("class", F.lit(True).alias("large")), "class", "left").join(likely, "node", "left")
    group = written(parts.select("node", F.when(F.col("large"), F.coalesce("component", "node")).otherwise(F.col("class")).alias("class")), "parts")

    bare = agree.where("empty").select(F.col("sig").alias("group"), "node").unionByName(agree.where("empty").select(F.col("sig").alias("group"), F.col("least").alias("node"))).distinct()
    bare = bare.join(group, "node", "left").select("group", "node", F.coalesce("class", "node").alias("class"), F.lit(1).alias("empty"))
    members = group.select(F.col("class").alias("group"), "node", "class", F.lit(0).alias("empty")).unionByName(bare).join(nodes, "node")
    size = members.groupBy("group", "empty").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("docs")).where("docs > 1").drop("docs")
    members = members.join(size, ["group", "empty"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    tasks = _in_pairs(members).select("group", "empty", "node", "class", "copies", "block", "at", "i", "j")
    texts = docs.select(at.alias("at"), "text")
    found = tasks.join(texts, "at").groupBy("group", "i", "j", "empty").applyInPandas(_verify(n, percent), "a bigint, b bigint, la bigint, lb bigint")
    found = written(found, "links")

    apart = found.where("lb > 0").distinct()
    degree = found.where("lb = 0 and la > 0").select("a", "la").unionByName(apart.select("a", "la")).unionByName(apart.select(F.col("b").alias("a"), F.col("lb").alias("la"))).groupBy("a").agg(F.sum("la").alias("links"))
    whole = components(found)
    named = nodes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(degree.withColumnRenamed("a", "node"), "node", "left").select("node", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = rows.where("n > 0").join(named, "node").select("key", "at", "n", "component", "component_id", "n_links")
    none = rows.where("n = 0").select("key", "at", "n", F.lit(None).cast("long").alias("component"), F.col("key").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(none)


def keep_one(docs: DataFrame, *, n: int = 3, percent: int = 90, key: str = "doc_id") -> DataFrame:
    """docs with one row of each class: that of the least key (nulls last), then of the least hash of key and text, then of
    all columns. Rows of no shingle stay."""
    rows = _classes(docs, n=n, percent=percent, key=key).where("n > 0").groupBy("component", "at").agg(F.min(F.struct(F.col("key").isNull().alias("null"), "key", "at")).alias("row"), F.count(F.lit(1)).alias("rows"))
    rows = written(rows, "class-rows")
    least = rows.groupBy("component").agg(F.min("row").alias("least"))
    kept = rows.join(least, "component").select(F.col("at").alias("_gone"), "rows", (F.col("row") == F.col("least")).alias("first"))
    kept = written(kept.where("not first or rows > 1"), "class-repeats")
    at = F.xxhash64(key, "text")
    left = docs.join(kept.select("_gone"), at == F.col("_gone"), "left_anti")
    hashed = F.xxhash64(*[c.name for c in docs.schema.fields if "map<" not in c.dataType.simpleString()])
    again = docs.join(kept.where("first").select("_gone"), at == F.col("_gone"))
    again = again.groupBy("_gone").agg(F.min_by(F.struct(*docs.columns), hashed).alias("_row")).select("_row.*")
    return left.unionByName(again)


def op8(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
