"""Mixing sources to target weights, natively: exact quotas, a hypergeometric splitting tree, disjoint permuted blocks.

1. Each source gets a target number of words: its weight's share of the budget, stopped at `most` times its own size.
2. A source's rows fall into blocks by a hash. Whole passes take every block; a last pass takes blocks in a hashed
   order up to the target; where that ends, in a short run of blocks (one, or until 256 rows), rows in a hashed order,
   then the largest that still fit.
3. A tree halves the output shards again and again. At each node every source's quota of block draws is split by a
   hypergeometric draw, source after source, which is the multivariate law of dealing a random permutation of draws.
   The two sides of each split add up exactly to the node's quotas.
4. A source's draws, in their permuted order, go to the shards by these quotas: no draw is dealt twice. Inside a shard
   the rows are ordered by a hash.

All is DataFrame expressions. Wide texts are never shuffled to decide anything: the plan works on (size, source, hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus target. One row per source.

    The least ratio of cap to weight is filled first; where the level that the rest can reach lies above a source's
    ratio, the source is full, and what it leaves goes to the others by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (share * total - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return s.withColumn("target", F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).cast("double")).select("source", "source_size", "target")


def _uniform(*cols) -> F.Column:
    """A number in (0, 1) that depends on the columns alone."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _let(value, then) -> F.Column:
    """then(value), with value computed once and named: an expression that says it twice would hold it twice."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hypergeometric(n, k, m, u) -> F.Column:
    """Of m draws out of n of which k are marked: how many marked, at the quantile u, by summing the law outward from its mode.

    Weights relative to the mode's are carried by ratios of neighbours, over 12 deviations either side.
    """
    start = lambda: F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("all"))
    seq = lambda n_: F.when(n_ > 0, F.sequence(F.lit(1).cast("long"), n_)).otherwise(F.array().cast("array<bigint>"))

    def grow(ratio):
        return lambda acc, x: _let(acc["w"] * ratio(x), lambda w: F.struct(w.alias("w"), F.concat(acc["all"], F.array(w)).alias("all")))

    def draw(law, b):
        total = F.aggregate(law, F.lit(0.0), lambda a, x: a + x)
        at = F.aggregate(law, F.struct((u * total).alias("left"), F.lit(0).cast("long").alias("i")), lambda a, x: F.struct((a["left"] - x).alias("left"), (a["i"] + F.when(a["left"] > x, 1).otherwise(0)).alias("i")))["i"]
        return F.least(b["last"], b["first"] + at)

    def around(b):
        mode = b["mode"]
        up = F.aggregate(seq(b["last"] - mode), start(), grow(lambda i: (k - (mode + i - 1)) * (m - (mode + i - 1)) / ((mode + i) * (n - k - m + mode + i)).cast("double")))["all"]
        down = F.aggregate(seq(mode - b["first"]), start(), grow(lambda i: (mode - i + 1) * (n - k - m + mode - i + 1) / ((k - mode + i) * (m - mode + i)).cast("double")))["all"]
        return _let(F.concat(F.reverse(down), F.array(F.lit(1.0)), up), lambda law: draw(law, b))

    def ends(b):
        return _let(F.struct(b["mode"].alias("mode"), F.greatest(b["lo"], b["mode"] - b["reach"]).alias("first"), F.least(b["hi"], b["mode"] + b["reach"]).alias("last")), around)

    lo, hi = F.greatest(F.lit(0).cast("long"), m + k - n), F.least(m, k)
    mode = F.least(hi, F.greatest(lo, F.floor((m + 1) * (k + 1) / (n + 2)).cast("long")))
    sd = F.sqrt(F.greatest(F.lit(1.0), m * (k / n) * (1 - k / n)))
    some = _let(F.struct(lo.alias("lo"), hi.alias("hi"), mode.alias("mode"), (F.ceil(12 * sd).cast("long") + 3).alias("reach")), ends)
    return F.when((n <= 0) | (k <= 0) | (m <= 0), F.lit(0).cast("long")).otherwise(some)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) -> (source, shard, quota): the tree. Rows: sources times shards at most; each level is one grouping by node.

    Within a node the sources are taken one after the other: each gets a hypergeometric share of what the left side
    still has to take out of what is still there.
    """
    q = quotas.select("source", F.col("quota").cast("long").alias("quota"), F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    width = shards
    level = 0
    while width > 1:
        width, level = (width + 1) // 2, level + 1
        node = q.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("source").alias("h"), "source", "quota"))).alias("all"), F.sum("quota").alias("n"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = node.withColumn("mid", mid).withColumn("take", F.when(F.col("hi") - F.col("lo") < 2, F.col("n")).otherwise(F.floor((F.col("n") * (F.col("mid") - F.col("lo")) + _uniform(F.lit(seed), F.lit(level), "lo") * (F.col("hi") - F.col("lo"))) / (F.col("hi") - F.col("lo"))).cast("long")))
        node = node.withColumn("take", F.least("take", "n"))

        def deal(acc, x):
            left = F.when(F.col("hi") - F.col("lo") < 2, x["quota"]).otherwise(_hypergeometric(acc["n"], x["quota"], acc["m"], _uniform(F.lit(seed), F.lit(level), F.col("lo"), x["h"])))
            return _let(left, lambda got: F.struct((acc["n"] - x["quota"]).alias("n"), (acc["m"] - got).alias("m"), F.concat(acc["got"], F.array(got)).alias("got")))

        got = F.aggregate("all", F.struct(F.col("n"), F.col("take").alias("m"), F.array().cast("array<bigint>").alias("got")), deal)["got"]
        both = node.withColumn("got", got).select("lo", "hi", "mid", F.explode(F.arrays_zip("all", "got")).alias("x"))
        one = F.col("hi") - F.col("lo") < 2
        sides = F.array(
            F.struct(F.col("lo").alias("lo"), F.when(one, F.col("hi")).otherwise(F.col("mid")).alias("hi"), F.col("x.got").alias("quota")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.when(one, F.lit(0).cast("long")).otherwise(F.col("x.all.quota") - F.col("x.got")).alias("quota")),
        )
        q = both.select(F.col("x.all.source").alias("source"), F.explode(sides).alias("s")).select("source", "s.quota", "s.lo", "s.hi").where("quota > 0")
    return q.select("source", F.col("lo").alias("shard"), "quota")


def _words() -> F.Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, copies and the shard of each copy.

    Size counts the words of text (null: 0). Null is a source like others, the last. Rows that are alike in key,
    source and size share their block and are drawn by the same order; an empty table gives an empty plan; texts of
    no words are never drawn. Extra columns of docs are neither read nor returned.
    """
    return _plan(docs, **options)[0].drop("edge")


def _hash(seed: int, key) -> F.Column:
    return F.xxhash64(F.lit(seed), key, "size")


def _plan(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, shards: int = 16, blocks: int = 1024, seed: int = 7, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The plan, with edge where a row's copies are its own and not its block's, and the draws of each block: source, block, room, full, last."""
    rows = docs.select(F.col(key).alias("key"), F.col("source"), _words().alias("size"))
    rows = rows.withColumn("h", _hash(seed, "key")).withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    rows = written(rows, "sizes")
    cells = written(rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("n")), "blocks")
    goals = written(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights), "targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    g = goals.alias("g")
    c = cells.where("words > 0").alias("c").join(g, F.expr("c.source <=> g.source")).select("c.source", "c.block", "c.words", "c.n", "g.target", "g.source_size")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block", "source"), "block")
    c = c.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("source")))
    passes = F.floor(F.col("target") / F.col("source_size")).cast("int")
    c = c.withColumn("passes", passes).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    c = c.withColumn("whole", F.col("upto") <= F.col("rest")).withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    source = Window.partitionBy("source")
    c = c.withColumn("left", F.col("rest") - F.coalesce(F.max(F.when(F.col("whole"), F.col("upto"))).over(source), F.lit(0))).withColumn("near", F.min(F.when(~F.col("whole"), F.col("before"))).over(source) + 256)
    c = c.withColumn("room", F.when(~F.col("whole") & (F.col("before") < F.col("near")), F.col("left")).otherwise(0))
    c = written(c, "draws")

    quotas = c.groupBy("source").agg(F.sum(F.col("passes") + F.when(F.col("whole") | (F.col("room") > 0), 1).otherwise(0)).alias("quota"))
    dealt = split_quotas(quotas, shards, seed).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("quotas"))
    ends = F.aggregate("quotas", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ends")), lambda a, x: F.struct((a["n"] + x["quota"]).alias("n"), F.concat(a["ends"], F.array(a["n"] + x["quota"])).alias("ends")))["ends"]
    dealt = written(dealt.select("source", ends.alias("ends"), F.col("quotas.shard").alias("shards")), "dealt")
    c, d = c.alias("c"), dealt.alias("d")
    draws = c.join(d, F.expr("c.source <=> d.source"), "left").select("c.*", "d.ends", "d.shards")

    def shard_of(pass_no):
        draw = pass_no * F.col("n_blocks") + F.col("rank")
        return F.element_at("shards", (F.size(F.filter("ends", lambda x: x <= draw)) + 1).cast("int"))

    full = F.transform(F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")), shard_of)
    last = F.when(F.col("whole") | (F.col("room") > 0), F.array(shard_of(F.col("passes")))).otherwise(F.array().cast("array<int>"))
    draws = written(draws.select("source", "block", "rank", "room", full.alias("full"), last.alias("last")), "block-draws")

    r, k = rows.alias("r"), draws.alias("k")
    joined = r.join(k, (F.col("r.block") == F.col("k.block")) & same({"source": F.col("r.source")}, {"source": F.col("k.source")}), "left")
    joined = joined.select("r.key", "r.source", "r.size", "r.h", "k.rank", "k.room", "k.full", "k.last")
    none = F.array().cast("array<int>")
    easy = joined.where("room is null or room <= 0").select("key", "source", "size", F.when(F.col("size") > 0, F.concat("full", "last")).otherwise(none).alias("shards"), F.lit(False).alias("edge"))

    # The short run of blocks where a source's last pass ends: rows that fit in the hashed order, then the largest that still fit.
    cell = Window.partitionBy("source")
    line = cell.orderBy("rank", "h", "key", "size")
    edge = joined.where("room > 0 and size > 0").withColumn("rn", F.row_number().over(line)).withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("fits", F.max(F.when(F.col("upto") <= F.col("room"), F.struct("rn", "upto"))).over(cell))
    edge = edge.withColumn("rn0", F.coalesce("fits.rn", F.lit(0))).withColumn("left", F.col("room") - F.coalesce("fits.upto", F.lit(0).cast("long")))
    near = F.sort_array(F.collect_list(F.when((F.col("rn") > F.col("rn0")) & (F.col("rn") <= F.col("rn0") + 256), F.struct("size", "rn"))).over(cell), asc=False)

    def fill(acc, x):
        yes = x["size"] <= acc["left"]
        return F.struct((acc["left"] - F.when(yes, x["size"]).otherwise(0)).alias("left"), F.when(yes, F.concat(acc["rns"], F.array(x["rn"]))).otherwise(acc["rns"]).alias("rns"))

    edge = edge.withColumn("more", F.aggregate(near, F.struct(F.col("left"), F.array().cast("array<int>").alias("rns")), fill)["rns"])
    taken = (F.col("rn") <= F.col("rn0")) | F.array_contains("more", F.col("rn"))
    edge = edge.select("key", "source", "size", F.when(taken, F.concat("full", "last")).otherwise(F.col("full")).alias("shards"), F.lit(True).alias("edge"))
    zero = joined.where("room > 0 and size <= 0").select("key", "source", "size", none.alias("shards"), F.lit(False).alias("edge"))

    out = easy.unionByName(edge).unionByName(zero).withColumn("shards", F.coalesce("shards", none)).alias("o").join(g, F.expr("o.source <=> g.source"), "left")
    out = out.select(F.col("o.key").alias(key), "o.source", "o.size", "g.source_size", "g.target", F.size("o.shards").alias("copies"), F.col("o.shards").alias("shards"), "o.edge")
    return out, draws


def _mixed(docs: DataFrame, p: DataFrame, draws: DataFrame, *, key: str, seed: int, blocks: int = 1024, **_) -> DataFrame:
    """docs' columns, _shards (the row's copies), mix_shard and mix_order: a row for each copy that the plan p has.

    A row finds its block's draws by its hash, so texts are not shuffled. Only the rows of edge blocks look for their own
    copies; where rows alike in key, source and size differ there, they are numbered in the order of their columns' hash,
    and the numbers go to the plan's kinds of copies in turn.
    """
    alike = [F.col(key).alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_n")]
    kinds = p.where("edge").groupBy(*alike, "shards").agg(F.count(F.lit(1)).alias("rows")).groupBy("_k", "_s", "_n").agg(F.array_sort(F.collect_list(F.struct("shards", "rows"))).alias("kinds"))
    kinds = written(kinds, "kinds")
    more = kinds.where(F.size("kinds") > 1)
    d = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col("source").alias("s"), _words().alias("size"))
    d = d.where("size > 0").withColumn("b", F.pmod(_hash(seed, "k"), F.lit(blocks)).cast("int"))
    d = d.join(draws.select(F.col("source").alias("_source"), "block", "room", "full", "last"), F.col("s").eqNullSafe(F.col("_source")) & (F.col("b") == F.col("block")))
    on = F.col("k").eqNullSafe(F.col("_k")) & F.col("s").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    whole = d.join(kinds, on, "left").where("kinds is null or size(kinds) = 1").select("row.*", F.when(F.col("kinds").isNull(), F.concat("full", "last")).otherwise(F.col("kinds")[0]["shards"]).alias("_shards"))

    near = docs.join(more.select("_k").distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    near = near.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("k"), F.col("source").alias("s"), _words().alias("size")).join(more, on)
    hashed = F.xxhash64(*[F.col("row")[c.name] for c in docs.schema.fields if "map<" not in c.dataType.simpleString()])
    no = F.row_number().over(Window.partitionBy("_k", "_s", "_n").orderBy(hashed))
    pick = F.aggregate("kinds", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<int>").alias("got")), lambda a, x: F.struct((a["n"] + x["rows"]).alias("n"), F.when((F.col("_no") > a["n"]) & (F.col("_no") <= a["n"] + x["rows"]), x["shards"]).otherwise(a["got"]).alias("got")))["got"]
    split = near.withColumn("_no", no).select("row.*", pick.alias("_shards"))

    out = whole.unionByName(split).select(*docs.columns, "_shards", F.posexplode("_shards").alias("_copy", "mix_shard"))
    return out.withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", key, "_copy")).drop("_copy")


def mix(docs: DataFrame, *, key: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: docs' columns plus mix_shard and mix_order, a row for each copy, hashed order within each shard.

    Documents that no draw takes are absent. Rows alike in key, source and size get the copies of as many plan rows, one
    each; which row gets which is told by the hash of its columns.
    """
    return _mixed(docs, *_plan(docs, key=key, seed=seed, **options), key=key, seed=seed, **options).drop("_shards")


def report(docs: DataFrame, *, key: str = "doc_id", seed: int = 7, **options) -> DataFrame:
    """One row per row of docs, as the plan has it, plus taken: the words that the written mixed corpus has of the row.

    The corpus is drawn, copied, and written in slices of its shards, sorted by mix_order within each.
    """
    p, draws = _plan(docs, key=key, seed=seed, **options)
    p = written(p, "mix-plan")
    mixed = _mixed(docs.select(key, "source", "text"), p, draws, key=key, seed=seed, **options)
    mixed = written(mixed.repartition("mix_shard", F.shiftright("mix_order", 60)).sortWithinPartitions("mix_shard", "mix_order"), "mixed")
    alike = [F.col(key).alias("_k"), F.col("source").alias("_s")]
    words = mixed.select(*alike, F.regexp_count("text", F.lit(WORD)).cast("long").alias("_n"), "_shards").groupBy("_k", "_s", "_n", "_shards").agg(F.sum("_n").alias("words"))
    rows = p.groupBy(*alike, F.col("size").alias("_n"), F.col("shards").alias("_shards")).agg(F.count(F.lit(1)).alias("rows"))
    same = lambda a, b: F.expr(" and ".join(f"{a}.{c} <=> {b}.{c}" for c in ("_k", "_s", "_n", "_shards")))
    # Alike rows with the same copies have the same share of the corpus.
    each = rows.alias("r").join(words.alias("w"), same("r", "w")).select("r._k", "r._s", "r._n", "r._shards", F.expr("w.words div r.rows").alias("taken"))
    p = p.select("*", *alike, F.col("size").alias("_n"), F.col("shards").alias("_shards"))
    return p.alias("p").join(each.alias("e"), same("p", "e"), "left").select(key, "source", "size", "source_size", "target", F.coalesce("e.taken", F.lit(0).cast("long")).alias("taken"), "copies", "shards")


def op1(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
