"""Document fingerprints, natively: a threshold-scaled sketch of five-word shingles.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so that it grows with its document,
sketches of parts merge by union, and containment can be estimated between documents of very unequal length. The fraction is
one in eight, or the whole for a text of at most 64 shingles, of which an eighth would say little; a sketch carries its
fraction, two are compared below the lower of theirs, and a union is brought to the fraction that its own size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, ordered_buckets, partitions

SEPARATOR = "[\\x20\\x09-\\x0D]+"
K, ONE_IN, WHOLE = 5, 8, 64
#: Buckets of the key order at most.
MOST_BUCKETS = 20_000
#: Hashes are non-negative 63-bit numbers.
TOP = (1 << 63) - 1


def word_hashes(text) -> F.Column:
    """The hash of each word of a text, in order; A-Z count as a-z, other case is kept."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(lower, SEPARATOR), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes, k: int = K) -> F.Column:
    """The hashes of a text's shingles from those of its words. Fewer than k words are one shingle; none, none."""
    n = F.size(hashes)
    shingle = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]).bitwiseAND(F.lit(TOP))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), shingle)).when(n > 0, F.array(F.xxhash64(hashes).bitwiseAND(F.lit(TOP)))).otherwise(F.array().cast("array<bigint>"))


def _low(hashes, one_in: int) -> F.Column:
    return F.filter(hashes, lambda x: x < F.lit(TOP // one_in))


def sketch(distinct, one_in: int = ONE_IN, whole: int = WHOLE) -> F.Column:
    """(one_in, hashes ascending) of a set of shingle hashes: all of at most `whole`, else those below the threshold."""
    every = F.size(distinct) <= whole
    return F.struct(F.when(every, 1).otherwise(one_in).alias("one_in"), F.array_sort(F.when(every, distinct).otherwise(_low(distinct, one_in))).alias("hashes"))


def as_text(s) -> F.Column:
    """The fraction's denominator, then 16 hexadecimal digits a hash; nothing for an empty set."""
    return F.when(F.size(s["hashes"]) == 0, F.when(s["one_in"] == 1, "").otherwise(F.concat(s["one_in"].cast("string"), F.lit(":")))).otherwise(F.concat(s["one_in"].cast("string"), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def from_text(text) -> F.Column:
    """The sketch that a fingerprint stands for, for merging and comparing stored ones."""
    digits = F.substring_index(text, ":", -1)
    n = (F.length(digits) / 16).cast("int")
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 16 + 1, F.lit(16)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.struct(F.when(text == "", 1).otherwise(F.substring_index(text, ":", 1).cast("int")).alias("one_in"), hashes.alias("hashes"))


def merge(a, b, one_in: int = ONE_IN, whole: int = WHOLE) -> F.Column:
    """The sketch of the two sets' union, exactly: a part that is no longer whole holds more than `whole` shingles, and so does the union."""
    both = F.array_union(a["hashes"], b["hashes"])
    every = (a["one_in"] == 1) & (b["one_in"] == 1) & (F.size(both) <= whole)
    return F.struct(F.when(every, 1).otherwise(one_in).alias("one_in"), F.array_sort(F.when(every, both).otherwise(_low(both, one_in))).alias("hashes"))


def containment(a, b, one_in: int = ONE_IN) -> F.Column:
    """The estimated share of the smaller document's shingles that the other has; 1 if both are empty, 0 if one is or nothing of it was kept."""
    same = (a["one_in"] == 1) & (b["one_in"] == 1)
    na, nb = (F.when(same, F.size(x["hashes"])).otherwise(F.size(_low(x["hashes"], one_in))) for x in (a, b))
    shared = F.array_intersect(a["hashes"], b["hashes"])
    both = F.when(same, F.size(shared)).otherwise(F.size(_low(shared, one_in)))
    empty = lambda x: (x["one_in"] == 1) & (F.size(x["hashes"]) == 0)
    return F.when(empty(a) & empty(b), F.lit(1.0)).when(F.least(na, nb) == 0, F.lit(0.0)).otherwise(both / F.least(na, nb)).cast("double")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, text and sketch with the next row's text and sketch, keys ascending; after the last comes the first.

    Keys are cut into buckets at their own quantiles. A bucket's first rows go to the bucket before as well, as its
    end, so a row finds its successor in its own bucket: one shuffle of the texts and no global sort. Null keys come
    last; equal keys are ordered by text. Sketches are made before the shuffle, once a row, and travel beside the text.
    """
    spark = docs.sparkSession
    starts = ordered_buckets(docs, key, min(MOST_BUCKETS, 8 * partitions(spark)))
    n = max(1, len(starts))
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = _with_sketch(d, "text", "key", "text")
    d = d.withColumn("own", bucket_of(F.col("key"), starts))
    copies = F.array(F.struct(F.col("own.no").alias("bucket"), F.lit(False).alias("end")))
    before = F.array(F.struct(F.pmod(F.col("own.no") - 1, F.lit(n)).alias("bucket"), F.lit(True).alias("end")))
    copies = F.when(F.col("own.first"), F.concat(copies, before)).otherwise(copies)
    d = d.select("key", "text", "sketch", F.explode(copies).alias("b")).select("key", "text", "sketch", "b.bucket", "b.end")
    d = d.repartition("bucket")
    w = Window.partitionBy("bucket").orderBy("end", F.col("key").asc_nulls_last(), "text")
    after = F.lead(F.struct("text", "sketch")).over(w)
    if not starts:
        after = F.coalesce(after, F.first(F.struct("text", "sketch")).over(w))
    return d.withColumn("next", after).where(~F.col("end")).select("key", "text", "sketch", "next")


def _with_sketch(d: DataFrame, text: str, *keep: str) -> DataFrame:
    """Adds the sketch of a text, in steps whose results later ones read more than once."""
    d = d.select(*keep, word_hashes(F.col(text)).alias("_w"))
    d = d.select(*keep, F.array_distinct(shingles(F.col("_w"))).alias("_s"))
    return d.select(*keep, sketch(F.col("_s")).alias("sketch"))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty: no shingles, an empty fingerprint. Empty tables give no rows; repeated rows each give one; rows of
    equal ids follow each other by text; other columns are not read.
    """
    d = with_next(docs, key).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)))
    d = d.select("key", "n_chars", F.col("sketch").alias("own"), F.col("next.sketch").alias("after"), "edited", F.sha2("edited", 256).alias("edited_sha256"))
    d = _with_sketch(d, "edited", "key", "n_chars", "own", "after", "edited_sha256")
    own, edited = F.col("own"), F.col("sketch")
    return d.select(F.col("key").alias(key), "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"), containment(own, edited).alias("near_edited"), containment(own, F.col("after")).alias("near_next"))


def op10(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
