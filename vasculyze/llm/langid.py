"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of a bounded sample of labelled text. A text is cut greedily into the longest phrases
that occur in a language's sample; phrases times log2 of the sample's length, over the text's symbols, estimate the cross
entropy. The language that needs least wins.

Symbols are the bytes of UTF-8, so that every letter of every script is told apart, and a table has a column for each of the
at most 256 bytes that its language's sample has. The automata become flat transition tables. A transition that a state
lacks starts the next phrase from the root and is marked.

A text is parsed whole. So that the work per symbol is a few array operations, its segments are first parsed side by side,
each as if a phrase began with it; then each is parsed again from the state that the one before really leaves, until a
phrase begins where one did the first time, from which on both parses are the same.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, small_batches, tidy, written

UNKNOWN = "und"
#: Symbols of a language's sample, labelled documents it comes from at least (if there are), symbols of a span.
SYMBOLS, SAMPLE_DOCS, SPAN = 16_000, 64, 250
SEGMENT, CHUNK, MISS = 256, 1_000_000, 1 << 15
#: Parts of the hash range by which a language's texts are counted before any are ordered.
HASH_PARTS = 4096


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)


def _fold(text: str) -> str:
    return text.lower()


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of a sequence: transitions and suffix links, state 0 the root."""
    go, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in go[p]:
            go[p][s] = cur
            p = link[p]
        if p >= 0:
            q = go[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                new = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(s) == q:
                    go[p][s] = new
                    p = link[p]
                link[q] = link[cur] = new
        last = cur
    return go, link


def table(symbols: list[int], width: int) -> np.ndarray:
    """Flat transitions: state * width + symbol -> next state; MISS is set where a new phrase begins, as every phrase does that starts at the root."""
    go, _ = automaton(symbols)
    root = np.zeros(width, np.uint16)
    for s, t in go[0].items():
        root[s] = t
    out = np.empty((len(go), width), np.uint16)
    out[:] = root | MISS
    for state, edges in enumerate(go):
        for s, t in edges.items():
            out[state, s] = t
    out[0] = root | MISS
    return out.ravel()


class Model:
    """Languages in code point order with their tables; symbol 0 is any run of non-letters, the others are bytes of letters in UTF-8."""

    def __init__(self, samples: dict[str, list[str]], symbols: int = SYMBOLS):
        self.langs = sorted(samples)
        self.columns, self.widths, self.tables, self.bits = [], [], [], []
        for lang in self.langs:
            seq = self.symbols([_fold(x) for x in samples[lang]])[0][:symbols]
            has = np.unique(seq)
            # Column 0 stands for the bytes that the sample lacks.
            column = np.zeros(256, np.uint8)
            column[has] = np.arange(1, len(has) + 1)
            self.columns.append(column)
            self.widths.append(len(has) + 1)
            self.tables.append(table(column[seq].tolist(), len(has) + 1))
            self.bits.append(float(np.log2(max(2, len(seq)))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols after each other, each text's number of symbols, and whether it has a letter."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        at = np.concatenate([[0], np.cumsum(sizes)])
        keep = np.ones(len(points), np.bool_)
        keep[1:] = letter[1:] | letter[:-1]
        begins = at[:-1][sizes > 0]
        keep[begins] = True
        letters = np.concatenate([[0], np.cumsum(letter)])
        code = np.where(letter, points, 0)[keep]
        high = np.flatnonzero(code >= 0x80)
        big = code[high]
        more = np.zeros(len(code), np.int64)
        more[high] = 1 + (big >= 0x800) + (big >= 0x10000)
        last = np.arange(len(code)) + np.cumsum(more)
        out = np.empty(len(code) + more.sum(), np.uint8)
        out[last] = np.where(code < 0x80, code, 0x80 | (code & 0x3F))
        at_high, more_high = last[high], more[high]
        for n in (1, 2, 3):
            lead = more_high == n
            out[at_high[lead] - n] = (0, 0xC0, 0xE0, 0xF0)[n] | (big[lead] >> (6 * n))
            inner = more_high > n
            out[at_high[inner] - n] = 0x80 | (big[inner] >> (6 * n) & 0x3F)
        kept = np.concatenate([[0], np.cumsum(keep)])[at]
        total = np.concatenate([[0], last + 1])[kept]
        return out, np.diff(total), (letters[at[1:]] - letters[at[:-1]]) > 0

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits that each language needs for each text (texts by languages), symbols, and whether there is a letter."""
        seq, sizes, letter = self.symbols(texts)
        pieces = -(-sizes // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(len(doc)) - (np.cumsum(pieces) - pieces)[doc]
        start = (np.cumsum(sizes) - sizes)[doc] + part * SEGMENT
        size = np.minimum(SEGMENT, sizes[doc] - part * SEGMENT)
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            own, state = self.columns[k][seq], 0
            step = CHUNK // SEGMENT
            for a in range(0, len(doc), step):
                z = slice(a, a + step)
                phrases, state = self._parse(k, own, start[z], size[z], part[z], state)
                out[:, k] += np.bincount(doc[z], phrases, len(texts)) * self.bits[k]
        return out, sizes, letter

    def _parse(self, k: int, own: np.ndarray, start: np.ndarray, size: np.ndarray, part: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Phrases that begin in each segment; the segments of a text follow each other. state: what the segment before the first leaves."""
        t, width, n = self.tables[k], self.widths[k], len(start)
        # Segments in the order of their sizes, so that those still going on stand in front; their symbols as columns.
        order = np.argsort(-size, kind="stable")
        going = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")
        grid = own[np.minimum(start[order] + np.arange(SEGMENT)[:, None], len(own) - 1)] if n else np.zeros((SEGMENT, 0), np.uint8)
        begins = np.zeros((SEGMENT, n), np.bool_)
        ends, row = np.zeros(n, np.int32), np.empty(n, np.int32)
        for j in range(SEGMENT):
            m = going[j]
            if not m:
                break
            at = np.multiply(ends[:m], width, out=row[:m])
            at += grid[j, :m]
            x = t.take(at)
            np.greater_equal(x, MISS, out=begins[j, :m])
            np.bitwise_and(x, MISS - 1, out=ends[:m], casting="unsafe")
        column = np.empty(n, np.int64)
        column[order] = np.arange(n)
        leaves, thought = ends[column], ends[column]
        upto = np.cumsum(begins, axis=0, dtype=np.int16)
        total = upto[-1] if n else np.zeros(0, np.int16)
        phrases = total[column].astype(np.int64)
        todo, rest, rounds = np.flatnonzero(part > 0), np.zeros(0, np.int64), 0
        while len(todo):
            before = np.where(todo > 0, leaves[todo - 1], state)
            now, count = before.astype(np.int32), np.zeros(len(todo), np.int64)
            # Of those still apart: number in todo, length, column, state, phrases so far.
            live, ends_at = np.arange(len(todo)), size[todo]
            col, at, some = column[todo], now.copy(), np.zeros(len(todo), np.int32)
            for j in range(int(ends_at.max())):
                x = t.take(at * width + grid[j].take(col))
                new = x >= MISS
                same = new & begins[j].take(col)
                some += new
                at = (x & (MISS - 1)).astype(np.int32)
                if (out := same | (ends_at <= j + 1)).any():
                    met, over = np.flatnonzero(same), np.flatnonzero(out & ~same)
                    count[live[met]] = some[met] + total[col[met]] - upto[j, col[met]]
                    now[live[met]] = thought[todo[live[met]]]
                    count[live[over]] = some[over]
                    now[live[over]] = at[over]
                    left = np.flatnonzero(~out)
                    live, ends_at, col, at, some = live[left], ends_at[left], col[left], at[left], some[left]
                    if not len(live):
                        break
            phrases[todo] = count
            # Where the parses never met, the next segment starts from another state than thought.
            changed = todo[leaves[todo] != now]
            leaves[todo] = now
            todo = np.union1d(rest, changed[changed + 1 < n] + 1)
            todo = todo[part[todo] > 0]
            # In texts that repeat themselves parses may never meet: then a segment waits until the one before is settled.
            rounds += 1
            waits = np.isin(todo - 1, todo) & (rounds > 4)
            todo, rest = todo[~waits], todo[waits]
        return phrases, int(leaves[-1]) if n else state

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores, from whole texts taken together up to CHUNK characters."""
        cost, letter = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.bool_)
        folded = [_fold(x or "") for x in texts]
        a = 0
        while a < len(folded):
            b, n = a, 0
            while b < len(folded) and (b == a or n + len(folded[b]) <= CHUNK):
                n += len(folded[b])
                b += 1
            cost[a:b], _, letter[a:b] = self.costs(folded[a:b])
            a = b
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = cost.argmin(1)
        least = cost.min(1)
        if len(self.langs) > 1:
            margin = np.partition(cost, 1, axis=1)[:, 1] - least
        else:
            margin = least
        score = np.where(letter, 1 - np.exp2(-margin / 16), 0.0)
        return [self.langs[k] if has else UNKNOWN for k, has in zip(best, letter)], np.clip(score, 0, 1)


def _shares(sizes: list[int], budget: int) -> list[int]:
    """The budget dealt to texts of so many symbols (each plus a gap): short texts whole, the long ones alike."""
    out, left = [0] * len(sizes), budget
    for done, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[i] = min(sizes[i] + 1, left // (len(sizes) - done))
        left -= out[i]
    return out


def fit(labelled: DataFrame, key: str = "doc_id", symbols: int = SYMBOLS) -> Model:
    """From (key, text, lang): per language `symbols` symbols of its distinct texts with a letter, in the order of their hash.

    Texts are taken until there are SAMPLE_DOCS and they hold the symbols, so a language falls short only where all its
    texts do. They share the symbols; a text longer than its share gives spans at hashed offsets, one from each of equally
    long parts of the whole text. What reaches the driver is bounded by the symbols of each language.
    """
    letters = F.trim(F.regexp_replace("text", r"\P{L}+", " "))
    rows = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64(F.lit("sample"), "text").alias("h"), "text")
    known = rows.select("lang", "h", letters.alias("t")).select("lang", "h", F.octet_length("t").alias("n"), F.length("t").alias("c")).where("n > 0").groupBy("lang", "h").agg(F.max("n").alias("n"), F.max("c").alias("c"))
    # Sums by parts of the hash range say up to which part a language's texts are needed; only those are put in order.
    known = known.withColumn("part", F.pmod(F.shiftrightunsigned("h", 40), F.lit(HASH_PARTS)))
    known = written(known, "letters")
    w = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = known.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") + 1).alias("s"))
    sums = sums.select("lang", "part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s"))
    parts = written(sums.where((F.col("c") < SAMPLE_DOCS) | (F.col("s") < symbols)).select("lang", "part"), "parts")
    w = Window.partitionBy("lang").orderBy("part", "h")
    few = known.join(parts, ["lang", "part"]).withColumn("rn", F.row_number().over(w))
    few = few.withColumn("before", F.sum(F.col("n") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - 1)
    found: dict[str, list[tuple[int, int, int]]] = {}
    for r in few.where((F.col("rn") <= SAMPLE_DOCS) | (F.col("before") < symbols)).select("lang", "h", "n", "c").collect():
        found.setdefault(r["lang"], []).append((r["h"], r["n"], r["c"]))
    wanted = [(lang, h, n, c, share) for lang, texts in found.items() for (h, n, c), share in zip(texts, _shares([n for _, n, _ in texts], symbols)) if share > 1]
    if not wanted:
        return Model({})
    at = labelled.sparkSession.createDataFrame(wanted, "lang string, h bigint, n bigint, c bigint, share bigint")
    spans = F.greatest(F.lit(1), F.floor(F.col("share") / SPAN)).cast("int")
    width = F.greatest(F.lit(1), F.floor((F.floor(F.col("share") / spans) - 1) * F.col("c") / F.col("n")))

    def span(i):
        part, end = F.floor(i * F.col("c") / spans), F.floor((i + 1) * F.col("c") / spans)
        return F.substring("t", (part + F.pmod(F.xxhash64("h", i), F.greatest(F.lit(1), end - part - width + 1)) + 1).cast("int"), width.cast("int"))

    cut = F.when(F.col("n") < F.col("share"), F.array("t")).otherwise(F.transform(F.sequence(F.lit(0), spans - 1), span))
    texts = rows.join(F.broadcast(at), ["lang", "h"]).withColumn("t", letters).select("lang", "h", cut.alias("spans")).dropDuplicates(["lang", "h"]).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["h"])):
        samples.setdefault(r["lang"], []).extend(_fold(x) + " " for x in r["spans"])
    return Model(samples, symbols)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, lang_pred, score) per row. Null texts and texts with no letter are `und` with score 0; repeated rows
    and ties give each its row, the least language winning a tie; an empty table or model gives no rows or only `und`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(F.col(key), *keep, F.col("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-1]), "lang_pred string", "score double"])
    n = len(keep) + 1

    def run(batches):
        for b in batches:
            langs, scores = shared.value.predict(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names[:n], "lang_pred", "score"])

    return out.mapInArrow(tidy(run), schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc32_of("doc_id") % 4 == 2
    model = fit(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
