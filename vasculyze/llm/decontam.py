"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be found with up to k errors (insertions, deletions, substitutions). Cut into k+1 pieces, at
least one of them is in the text unchanged. All pieces of all items are looked for at once; around each exact piece hit,
Myers' bit-parallel algorithm finds the least distance of the item to a substring of the text.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, tidy

#: Errors allowed per hundred characters; characters of items looked for at once.
PERCENT, AT_ONCE = 8, 4_000_000
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, anything but letters and digits one blank, a blank at either end; nothing if there is no letter or digit."""
    x = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {x} " if x else ""


def budget(item: str, percent: int = PERCENT) -> int:
    return len(item) * percent // 100


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k+1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """The least distance of pattern to a substring of text and that substring's end, if it is at most k."""
    m = len(pattern)
    if masks is None:
        masks = masks_of(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= k and (best is None or score < best[0]):
                best = (score, i + 1)
        ph = (ph << 1) & full
        pv = ((mh << 1) & full) | ~(xv | ph) & full
        mv = ph & xv
    return best


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Items:
    """Benchmark items ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT):
        import ahocorasick

        self.ids, self.texts, self.k, self.masks = [], [], [], []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not (x := normal(text)):
                continue
            k = budget(x, percent)
            for offset, piece in pieces(x, k):
                at.setdefault(piece, []).append((len(self.ids), offset))
            self.ids.append(item_id)
            self.texts.append(x)
            self.k.append(k)
            self.masks.append(masks_of(x))
        self.machine = ahocorasick.Automaton()
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), where))
        if at:
            self.machine.make_automaton()
        self.any = bool(at)

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normal text) for each item that the whole text holds; just one of them if `first`."""
        x = normal(text)
        if not x or not self.any:
            return []
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.machine.iter(x):
            for i, offset in where:
                start = end + 1 - size - offset
                k = self.k[i]
                if (i in found and found[i][0] == 0) or (i, start) in tried:
                    continue
                tried.add((i, start))
                m = len(self.texts[i])
                if x.startswith(self.texts[i], max(0, start)) and start >= 0:
                    hit, at = (0, m), start
                elif k:
                    at = max(0, start - k)
                    hit = myers(self.texts[i], x[at : start + m + k], k, self.masks[i])
                else:
                    continue
                if hit and (i not in found or hit[0] < found[i][0]):
                    found[i] = (hit[0], at + hit[1])
                    if first:
                        break
            if first and found:
                break
        return [(self.ids[i], d, e) for i, (d, e) in sorted(found.items())]


def _blocks(benchmark: DataFrame):
    """The items in blocks of about AT_ONCE characters, each of which may come to the driver."""
    b = benchmark.where("text is not null").select("item_id", "text")
    n = b.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = n // AT_ONCE + 1
    for i in range(parts):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield [(r["item_id"], r["text"]) for r in part.dropDuplicates().collect()]


def _items(name: str, items: tuple, percent: int) -> Items:
    """The machine of a broadcast's items, which the worker keeps for its next tasks with them."""
    return kept(f"items {name}", lambda: Items(list(items), percent))


def matches(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """(key, item_id, distance, end): every item within its error budget in a row's whole text, with its least distance.

    Null and empty texts hold nothing, nor do items of no letter or digit; repeated rows each give their matches; an
    empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id bigint, distance int, end int"
    out = None
    for items in _blocks(benchmark):
        shared, name = spark.sparkContext.broadcast(tuple(items)), uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            look = _items(name, shared.value, percent)
            for b in batches:
                rows = [(i, *hit) for i, text in enumerate(b.column(1)) for hit in look.find(text.as_py())]
                at, item, d, e = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(e, pa.int32())], names=[key, "item_id", "distance", "end"])

        part = docs.select(key, "text").mapInArrow(tidy(run, "items"), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """docs without the rows whose text holds an item; one pass a block of items, nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    for items in _blocks(benchmark):
        shared, name = spark.sparkContext.broadcast(tuple(items)), uuid.uuid4().hex
        at = docs.columns.index("text")

        def run(batches, shared=shared, name=name, at=at):
            look = _items(name, shared.value, percent)
            for b in batches:
                yield b.filter(pa.array([not look.find(x.as_py(), first=True) for x in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(tidy(run, "items"), docs.schema)
    return docs


def op9(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
