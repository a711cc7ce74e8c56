"""Token ids as raw binary shards with a minimal perfect hash index.

A shard holds consecutive documents of the key order: the ids one after the other, little-endian, 2 bytes each if the
vocabulary allows, else 4; the keys in their order with each document's length; and an index that maps a key to its
document in constant time. The index is a minimal perfect hash of the shard's distinct keys (levels of bits: a key rests
at the first level where no other hashes to its bit; its number is the rank of that bit) with a 16-bit fingerprint per
slot, which turns away most foreign keys before the stored key settles it. Shards are binary values of a Parquet table,
for executors have no common file system but Spark's.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, kept, ordered_buckets, partitions, release, running_total, small_batches, splitmix, tidy, written

MAGIC = b"VTOK1\0\0\0"
HEAD = struct.Struct("<8sQQQIIq")
#: Ids of a shard, from which it is closed; entries of the table of known words, from which it is emptied; buckets of the key order at most.
SHARD_IDS, KNOWN_WORDS, MOST_BUCKETS = 1 << 20, 800_000, 20_000
#: Characters of the texts whose words are held as objects at once; a longer text is taken alone.
HELD_CHARS = 1 << 19
NO_KEY = -(1 << 63)


class Index:
    """A minimal perfect hash over distinct 64-bit keys."""

    GAMMA, SEED, MARK = 2.0, 0x51_7C_C1_B7, 0x2545F4914F6CDD1D

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> Index:
        left, sizes, levels = keys.astype(np.int64).view(np.uint64), [], []
        while len(left):
            m = max(8, int(cls.GAMMA * len(left)))
            at = cls._at(left, len(sizes), m)
            n = np.bincount(at, minlength=m)
            levels.append(n == 1)
            sizes.append(m)
            left = left[n[at] != 1]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.bool_))

    @classmethod
    def _at(cls, keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (splitmix(keys ^ splitmix(np.full(1, cls.SEED + level, np.uint64))) % np.uint64(m)).astype(np.int64)

    @classmethod
    def marks(cls, keys: np.ndarray) -> np.ndarray:
        return (splitmix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(cls.MARK)) >> np.uint64(48)).astype(np.uint16)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; -1 for some keys that aren't in, an arbitrary slot for the others that aren't."""
        keys = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            at = self.starts[level] + self._at(keys[open_], level, m)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
        return out


def pack(keys: list[int | None], ids: list[np.ndarray], wide: bool) -> bytes:
    """A shard's bytes. Repeated keys keep their rows; the index leads to the first."""
    key = np.array([NO_KEY if k is None else k for k in keys], np.int64)
    null = np.array([k is None for k in keys], np.bool_)
    sizes = np.array([len(x) for x in ids], np.uint32)
    flat = (np.concatenate(ids) if ids else np.zeros(0)).astype("<u4" if wide else "<u2")
    known, first = np.unique(key[~null], return_index=True)
    first = np.flatnonzero(~null)[first]
    index = Index.build(known)
    slot = index.slots(known)
    doc, mark = np.zeros(len(known), "<u4"), np.zeros(len(known), "<u2")
    doc[slot], mark[slot] = first, Index.marks(known)
    head = HEAD.pack(MAGIC, len(key), len(known), len(flat), 4 if wide else 2, len(index.sizes), int(null.sum()))
    return b"".join([head, np.array(index.sizes, "<u8").tobytes(), np.packbits(index.bits).tobytes(), doc.tobytes(), mark.tobytes(), key.astype("<i8").tobytes(), np.packbits(null).tobytes(), sizes.astype("<u4").tobytes(), flat.tobytes()])


class Shard:
    """A shard read back: keys in order, and ids by key."""

    def __init__(self, blob: bytes):
        magic, n, n_known, n_ids, width, levels, _ = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.at = HEAD.size

        def take(dtype, count):
            x = np.frombuffer(blob, dtype, count, self.at)
            self.at += x.nbytes
            return x

        sizes = take("<u8", levels).astype(np.int64).tolist()
        bits = np.unpackbits(take(np.uint8, -(-sum(sizes) // 8)), count=sum(sizes)).astype(np.bool_)
        self.index = Index(sizes, bits)
        self.doc, self.mark, self.keys = take("<u4", n_known), take("<u2", n_known), take("<i8", n)
        self.null = np.unpackbits(take(np.uint8, -(-n // 8)), count=n).astype(np.bool_)
        self.sizes = take("<u4", n)
        self.ends = np.cumsum(self.sizes.astype(np.int64))
        self.ids = take("<u4" if width == 4 else "<u2", n_ids)
        if self.at != len(blob) or (len(self.ends) and self.ends[-1] != n_ids):
            raise ValueError("a damaged shard of token ids")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 if there is none: index, fingerprint, stored key."""
        keys = np.asarray(keys, np.int64)
        slot = self.index.slots(keys)
        if not len(self.doc):
            return np.full(len(keys), -1, np.int64)
        safe = np.maximum(slot, 0)
        good = (slot >= 0) & (self.mark[safe] == Index.marks(keys))
        doc = self.doc[safe].astype(np.int64)
        return np.where(good & (self.keys[doc] == keys), doc, -1)

    def at_doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]

    def get(self, key: int) -> np.ndarray | None:
        i = int(self.find(np.array([key]))[0])
        return None if i < 0 else self.at_doc(i)


def cuttable(text: str) -> bool:
    """Whether the text's white space is single blanks and line ends between other characters: the pieces that the
    tokenizer makes never cross a blank or line end that stands alone, so such texts can be cut there."""
    y = text.replace("\n", " ")
    return y.isprintable() and "  " not in y and y[0] != " " and y[-1] != " " and "<|endoftext|>" not in y


class _Known(dict):
    """Words to numbers; a word that is met for the first time gets the next number and waits in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def _portions(texts: list[str | None]):
    """The texts in their order, in lists of HELD_CHARS characters at most or one longer text."""
    held, n = [], 0
    for x in texts:
        size = len(x or "")
        if held and n + size > HELD_CHARS:
            yield held
            held, n = [], 0
        held.append(x)
        n += size
    if held:
        yield held


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or its entries in a longer array, so that n have room."""
    if len(x) >= n:
        return x
    out = np.zeros(max(n, len(x) * 3 // 2), x.dtype)
    out[: len(x)] = x
    return out


class Encoder:
    """Whole texts to ids by the tokenizers library, each distinct word once.

    Words are what stands between blanks; \\1 before a word marks the first of a text, \\0 one after a line end, and
    any other has its blank before it. The first n_words of starts, sizes and hits are the known words', in the order
    of their numbers, and the first n_ids of flat their ids; the rest is room.
    """

    def __init__(self, path: str):
        # Batches are of one text: the library's threads would only keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        (self.line,) = self.tok.encode("\n", add_special_tokens=False).ids
        self.stops = {c: self.tok.encode(c, add_special_tokens=False).ids[0] for c in ".,"}
        vocab = self.tok.get_vocab()
        self.blank = np.zeros(max(vocab.values()) + 1, np.bool_)
        self.blank[[i for x, i in vocab.items() if x[0] == "\u0120"]] = True
        self.wide = len(self.blank) > 1 << 16
        self.known = _Known()
        self.n_words = self.n_ids = 0
        self.flat = np.zeros(0, np.uint32 if self.wide else np.uint16)
        self.starts, self.sizes, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keeps the words that were met most, half of the table at most."""
        sizes, hits = self.sizes[: self.n_words], self.hits[: self.n_words]
        least = max(2, int(np.partition(hits, -(KNOWN_WORDS // 2))[-(KNOWN_WORDS // 2)]) + 1)
        stay = hits >= least
        words = list(compress(self.known, stay.tolist()))
        self.known.clear()
        self.known.update(zip(words, range(len(words))))
        self.flat = self.flat[: self.n_ids][np.repeat(stay, sizes)]
        self.sizes, self.hits = sizes[stay], hits[stay]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.n_words, self.n_ids = len(self.sizes), len(self.flat)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words without their marks: encoded as one text, a line each; line ends, which no word has, part the ids."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat = np.array(self._raw(["\n".join([w[1:] if w[0] < "\2" else " " + w for w in words])])[0], np.uint32)
        cut = np.flatnonzero(flat == self.line)
        if len(cut) != len(words) - 1:
            raise ValueError("the tokenizer does not keep line ends apart")
        return np.delete(flat, cut), np.diff(np.concatenate([[-1], cut, [len(flat)]])) - 1

    def _blanks(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words that have a blank before them, encoded as one text without line ends: only a word's first id begins with a blank."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat = np.array(self._raw([" " + " ".join(words)])[0], np.uint32)
        first = np.flatnonzero(self.blank[flat])
        if len(first) != len(words) or first[0]:
            return self._lines(words)
        return flat, np.diff(np.append(first, len(flat)))

    def _learn(self) -> None:
        """Ids of the new words, in their order. A full stop or comma that ends a word after a letter is a piece of its own."""
        words, self.known.new = self.known.new, []
        if not words:
            return
        tail = [w[-1] in ".," and len(w) > 1 and w[-2].isalpha() for w in words]
        stems = [w[:-1] if t else w for w, t in zip(words, tail)]
        have, old, ids = self.known.get, self.n_words, self.n_ids
        seen = np.array([n if t and (n := have(x, old)) < old else -1 for x, t in zip(stems, tail)], np.int64)
        fresh = [x for x, n in zip(stems, seen.tolist()) if n < 0]
        marked = np.fromiter((x[0] < "\2" for x in fresh), np.bool_, len(fresh))
        (flat, sizes), (more, most) = self._blanks([x for x in fresh if x[0] > "\1"]), self._lines([x for x in fresh if x[0] < "\2"])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, most])
        # All stems' ids behind the old ones, where then each word's own stand, with line end and stop.
        stop_at = ids + len(flat)
        self.flat = _room(self.flat, stop_at + 3)
        self.flat[ids:stop_at], self.flat[stop_at : stop_at + 3] = flat, (self.line, self.stops["."], self.stops[","])
        place = np.empty(len(fresh), np.int64)
        place[np.argsort(marked, kind="stable")] = np.arange(len(fresh))
        start, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[seen < 0], n[seen < 0] = ids + (np.cumsum(sizes) - sizes)[place], sizes[place]
        start[seen >= 0], n[seen >= 0] = self.starts[seen[seen >= 0]], self.sizes[seen[seen >= 0]]
        before = np.fromiter((w[0] == "\0" for w in words), np.bool_, len(words)) & (seen < 0)
        stop = np.fromiter((0 if not t else 1 if w[-1] == "." else 2 for w, t in zip(words, tail)), np.int64, len(words))
        total = n + before + (stop > 0)
        upto = np.cumsum(total)
        pick = np.repeat(start - (upto - total) - before, total) + np.arange(upto[-1])
        pick[(upto - total)[before]] = stop_at
        pick[upto[stop > 0] - 1] = stop_at + stop[stop > 0]
        own = self.flat[pick]
        self.n_words, self.n_ids = old + len(words), ids + len(own)
        self.flat = _room(self.flat, self.n_ids)
        self.flat[ids : self.n_ids] = own
        self.starts, self.sizes, self.hits = (_room(x, self.n_words) for x in (self.starts, self.sizes, self.hits))
        self.starts[old : self.n_words], self.sizes[old : self.n_words], self.hits[old : self.n_words] = ids + upto - total, total, 0

    def encode(self, texts: list[str | None]):
        """Ids of each text and the end id 0."""
        for some in _portions(texts):
            yield from self._portion(some)

    def _portion(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        words, ends, docs = [], [], []
        for i, x in enumerate(texts):
            if not x:
                out[i] = np.zeros(1, self.flat.dtype)
            elif not cuttable(x):
                out[i] = np.array([*self._raw([x])[0], 0], self.flat.dtype)
            else:
                words += ("\1" + x.replace("\n", " \0")).split(" ")
                ends.append(len(words))
                docs.append(i)
        if docs:
            k = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            del words
            self._learn()
            n = self.sizes[k]
            upto = np.cumsum(n, dtype=np.int64)
            at = np.repeat(self.starts[k] - (upto - n), n)
            at += np.arange(upto[-1])
            ids = self.flat[at]
            np.add.at(self.hits, k, 1)
            a = 0
            for i, z in zip(docs, upto[np.array(ends) - 1].tolist()):
                out[i] = np.append(ids[a:z], self.flat.dtype.type(0))
                a = z
        return out


def encoder(path: str) -> Encoder:
    return kept(f"tokenizer {path}", lambda: Encoder(path))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", batch: int = 1000) -> DataFrame:
    """The written shards (bucket, seq, n_docs, n_ids, shard), keys ascending over (bucket, seq) and within each.

    Null keys come last and are in no index; null texts are only the end id; an empty table gives no shards.
    """
    small_batches(docs.sparkSession)
    starts = ordered_buckets(docs, key, min(MOST_BUCKETS, 8 * partitions(docs.sparkSession)))
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("bucket", bucket_of(F.col("key"), starts)["no"]).repartition("bucket").sortWithinPartitions("bucket", F.col("key").asc_nulls_last(), "text")

    def run(batches):
        enc = encoder(path)
        keys, ids, n, now, seq = [], [], 0, None, 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([n], pa.int64()), pa.array([pack(keys, ids, enc.wide)], pa.binary())], names=["bucket", "seq", "n_docs", "n_ids", "shard"])

        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                for k, bucket, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    if keys and (bucket != now or n >= SHARD_IDS):
                        yield close()
                        seq = seq + 1 if bucket == now else 0
                        keys, ids, n = [], [], 0
                    now = bucket
                    keys.append(k)
                    ids.append(x)
                    n += len(x)
                # Else what encoding needed for a moment stays with the worker while the next words come.
                release()
        if keys:
            yield close()

    return written(d.mapInArrow(tidy(run, "tokenizer"), "bucket int, seq int, n_docs bigint, n_ids bigint, shard binary"), "token-shards")


def read_shards(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per document, from the shards' bytes, each found by its index where it has a key."""

    def run(batches):
        for b in batches:
            for bucket, seq, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = Shard(blob.as_buffer())
                found = s.find(s.keys)
                wrong = (found < 0) & ~s.null | (found >= 0) & (s.keys[np.maximum(found, 0)] != s.keys)
                if wrong.any():
                    raise ValueError("a shard's index misses its own keys")
                crc = [zlib.crc32(s.at_doc(i).astype("<u4").tobytes()) for i in range(len(s.keys))]
                n = len(s.keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.keys, pa.int64(), mask=s.null), pa.array(s.ends - s.sizes, pa.int64()), pa.array(s.sizes.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["bucket", "seq", "key", "within", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("bucket", "seq", "shard").mapInArrow(tidy(run), "bucket int, seq int, key bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    base = running_total(shards.select("bucket", "seq", "n_ids"), "bucket", ["seq"], "n_ids", "before").select("bucket", "seq", "before")
    return rows.join(base, ["bucket", "seq"]).select(F.col("key").alias(key), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def lookup(shards: DataFrame, keys: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few keys: only shards whose key range may hold them do more than read their header and index."""

    def run(batches):
        want = np.array(sorted(keys), np.int64)
        for b in batches:
            for blob in b.column(0):
                s = Shard(blob.as_buffer())
                at = s.find(want)
                for k, i in zip(want[at >= 0], at[at >= 0]):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([s.at_doc(i).astype("<u4").tobytes()], pa.binary())], names=["key", "ids"])

    return {r["key"]: np.frombuffer(bytes(r["ids"]), "<u4") for r in shards.select("shard").mapInArrow(run, "key bigint, ids binary").collect()}


def op6(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path))
