"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import written

#: Rows that a block of a source has about, and blocks that a source has at most (beyond, blocks grow).
_BLOCK_ROWS, _BLOCKS = 256, 1 << 16
#: A document is taken at most so often.
_MOST = 3


def targets(sources: DataFrame) -> DataFrame:
    """Add weight and target to one row per source (source, source_size, n).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target stops at
    three times its source's size and the excess is shared again by weight. The level at which that ends is found
    without rounds: in order of cap per weight, the sources that are capped come first, and the share per weight of
    what these leave is largest at the first that is not.
    """
    every, order = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * float(_MOST))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("left", F.sum("source_size").over(every) - (F.sum("cap").over(by) - F.col("cap")))
    rows = rows.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.sum("weight").over(by) + F.col("weight")))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    return rows.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).drop("cap", "left", "level")


def _hypergeometric(total: str, picks: str, marked: str, u: str) -> str:
    """SQL for the number of marked ones among `picks` of `total` without replacement, by inversion of u in [0, 1).

    Chances are summed from the mode outwards by the ratio of neighbours, over 12 deviations to each side.
    """
    bind = f"struct(greatest(0, {marked} - ({total} - {picks})) as lo, least({marked}, {picks}) as hi, cast(floor(({marked} + 1D) * ({picks} + 1D) / ({total} + 2D)) as bigint) as mode, cast(ceil(12 * sqrt({marked} * ({picks} / ({total} + 0D)) + 1)) as bigint) as reach)"
    bound = "struct(greatest(z.lo, least(z.hi, z.mode)) as m, least(z.hi - greatest(z.lo, least(z.hi, z.mode)), z.reach) as up, least(greatest(z.lo, least(z.hi, z.mode)) - z.lo, z.reach) as down)"
    steps = lambda n: f"if({n} > 0, sequence(1L, {n}), cast(array() as array<bigint>))"
    rise = f"(({marked} - (y.m + i - 1)) * 1D * ({picks} - (y.m + i - 1)) / ((y.m + i) * 1D * ({total} - {marked} - {picks} + y.m + i)))"
    fall = f"((y.m - i + 1) * 1D * ({total} - {marked} - {picks} + y.m - i + 1) / (({marked} - (y.m - i)) * 1D * ({picks} - (y.m - i))))"
    mass = lambda n, ratio: f"aggregate({steps(n)}, struct(1D as w, 0D as s), (c, i) -> struct(c.w * {ratio} as w, c.s + c.w * {ratio} as s), c -> c.s)"
    walk = lambda n, ratio, t: f"aggregate({steps(n)}, struct(1D as w, 0D as s, 0L as x), (c, i) -> struct(c.w * {ratio} as w, c.s + c.w * {ratio} as s, c.x + if(c.s <= {t}, 1L, 0L) as x), c -> c.x)"
    ends = f"struct(y.m as m, y.up as up, y.down as down, {mass('y.up', rise)} as above, {mass('y.down', fall)} as below)"
    thrown = f"{u} * (1 + y.above + y.below) - 1"
    value = f"case when {thrown} < 0 then y.m when {thrown} < y.above then y.m + {walk('y.up', rise, thrown)} else y.m - {walk('y.down', fall, f'{thrown} - y.above')} end"
    return f"transform(transform(transform(array({bind}), z -> {bound}), y -> {ends}), y -> {value})[0]"


def quotas(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, quota): exact block quotas of each shard, from one row per source (source, units).

    The blocks of all sources together are halved level by level, each shard count a power of two: a node's left half
    takes half of its blocks, and how many of each source these are is drawn by the multivariate hypergeometric
    distribution, source after source. Quotas of a source add up to its units, and shards differ by one block per level
    at most. The table has one row per node; its arrays have one entry per source.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    rows = counts.select(F.struct(F.col("source").isNull().alias("none"), "source", F.col("units").cast("long").alias("q")).alias("s"))
    nodes = rows.agg(F.array_sort(F.collect_list("s")).alias("qs")).select(F.lit(1).cast("long").alias("node"), "qs")
    for _ in range(shards.bit_length() - 1):
        u = f"(shiftrightunsigned(xxhash64({seed}, node, s.source), 11) / 9007199254740992D)"
        one = f"if(s.q > 0 and a.picks > 0, {_hypergeometric('a.total', 'a.picks', 's.q', u)}, 0L)"
        drawn = (
            "aggregate(qs, struct(aggregate(qs, 0L, (t, s) -> t + s.q) as total, aggregate(qs, 0L, (t, s) -> t + s.q) div 2 as picks, cast(array() as array<bigint>) as xs), "
            f"(a, s) -> transform(array({one}), x -> struct(a.total - s.q as total, a.picks - x as picks, array_append(a.xs, x) as xs))[0], a -> a.xs)"
        )
        nodes = nodes.withColumn("xs", F.expr(drawn))
        halves = "array(struct(node * 2 as node, zip_with(qs, xs, (s, x) -> struct(s.none as none, s.source as source, x as q)) as qs), struct(node * 2 + 1 as node, zip_with(qs, xs, (s, x) -> struct(s.none as none, s.source as source, s.q - x as q)) as qs))"
        nodes = nodes.select(F.expr(f"inline({halves})"))
    return nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("qs").alias("s")).select("s.source", "shard", F.col("s.q").alias("quota"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", shards: int = 16, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, shards (array, one per copy).

    size is the number of words `[^\\x20\\x09-\\x0D]+` (null text: 0). A source whose target is r times its size is taken
    floor(r) times whole; the rest of its target is filled by blocks drawn without replacement. Blocks are hash
    classes of doc_id in an affine order; the block that would pass the target is filled document by document: a pass in
    hash order and three by falling size each skip what does not fit, then the document that is nearest to what is
    missing is added if that brings the sum nearer. So whole documents are taken, at most three times, and a
    source misses its target by less than its block's smallest document left out. Reruns agree. Rows that repeat a doc_id, source and size are taken alike. Empty sources have
    target 0; null sources form one source; a null doc_id falls into one block. No rows, no result.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    rows = written(rows, "sizes").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    wanted = F.greatest(F.lit(1.0), F.least(F.lit(float(_BLOCKS)), F.pow(2.0, F.ceil(F.log2(F.col("n") / _BLOCK_ROWS)))))
    per = targets(per).withColumn("blocks", wanted.cast("long"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(_MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    per = per.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    per = per.withColumn("turn", F.xxhash64(F.lit(seed), "source", F.lit("a")).bitwiseOR(F.lit(1))).withColumn("shift", F.xxhash64(F.lit(seed), "source", F.lit("b")))
    per = written(per, "sources")

    def joined(left, right, key="source"):
        return left.join(right.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")

    # turn is odd and blocks a power of two, so this permutes a source's blocks.
    place = F.expr("pmod(pmod(turn, blocks) * pmod(h, blocks) + pmod(shift, blocks), blocks)")
    dealt = joined(rows, per.select("source", "blocks", "turn", "shift")).withColumn("place", place).drop("blocks", "turn", "shift")
    line = Window.partitionBy("source").orderBy("place")
    sums = joined(dealt.groupBy("source", "place").agg(F.sum("size").alias("words")), per.select("source", "rest"))
    sums = sums.withColumn("past", F.sum("words").over(line))
    edge = sums.filter("past > rest").groupBy("source").agg(F.min_by(F.struct("place", (F.col("rest") - F.col("past") + F.col("words")).alias("room")), "place").alias("e"))
    edge = written(edge.select("source", F.col("e.place").alias("edge"), F.col("e.room").alias("room")), "edges")

    each = joined(dealt, edge).filter("place = edge and size > 0").groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"), F.first("h").alias("h"), F.first("room").alias("room"))
    each = each.withColumn("words", F.col("size") * F.col("times")).withColumn("got", F.lit(False))
    of = Window.partitionBy("source")
    for by in (["h"], *[[F.col("words").desc(), "h"]] * 3):
        upto = of.orderBy(*by, "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        fits = ~F.col("got") & (F.col("words") <= F.col("room"))
        each = each.withColumn("now", fits & (F.sum(F.when(fits, F.col("words")).otherwise(0)).over(upto) <= F.col("room")))
        each = each.withColumn("room", F.col("room") - F.sum(F.when(F.col("now"), F.col("words")).otherwise(0)).over(of)).withColumn("got", F.col("got") | F.col("now"))
    off = F.abs(F.col("words") - F.col("room"))
    nearest = F.row_number().over(of.orderBy("got", off, "h", "doc_id", "size"))
    each = each.withColumn("got", F.col("got") | ((nearest == 1) & (off < F.col("room"))))
    chosen = each.filter("got").select("source", "doc_id", "size")

    per = per.join(edge.withColumnRenamed("source", "__e"), F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e")
    per = per.withColumn("units", F.col("epochs") * F.col("blocks") + F.when(F.col("rest") > 0, F.coalesce(F.col("edge") + 1, F.col("blocks"))).otherwise(0))
    shares = quotas(per.select("source", "units"), shards, seed)
    ends = shares.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    ends = ends.select("source", F.expr("aggregate(q, cast(array() as array<bigint>), (a, s) -> array_append(a, s.quota + if(size(a) = 0, 0L, a[size(a) - 1])))").alias("ends"))
    per = written(joined(per, ends).select("source", "source_size", "target", "blocks", "epochs", "rest", "edge", "ends"), "shares")

    out = joined(dealt, per)
    same = [F.col("source").eqNullSafe(F.col("c.source")), F.col("doc_id").eqNullSafe(F.col("c.doc_id")), F.col("size") == F.col("c.size")]
    picked = chosen.select(F.struct("source", "doc_id", "size").alias("c"))
    out = out.join(picked, same[0] & same[1] & same[2], "left")
    extra = (F.col("rest") > 0) & (F.col("size") > 0) & (F.coalesce(F.col("place") < F.col("edge"), F.lit(True)) | F.col("c").isNotNull())
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs")).otherwise(0) + F.when(extra, 1).otherwise(0))
    # The unit of a copy: blocks of one pass after another, in their order; its shard is the first whose range holds it.
    out = out.withColumn("units", F.expr("if(copies > 0, transform(sequence(1, copies), e -> (e - 1) * blocks + place), cast(array() as array<bigint>))"))
    out = out.withColumn("shards", F.expr("transform(units, r -> size(filter(ends, b -> b <= r)))"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "shards", "h")


def mixed_rows(mixed: DataFrame, *, seed: int = 42) -> DataFrame:
    """One row per taken copy: doc_id, source, size, copy (from 0), shard, and order, by which a shard is shuffled locally."""
    out = mixed.select("doc_id", "source", "size", F.posexplode("shards").alias("copy", "shard"))
    return out.withColumn("order", F.xxhash64(F.lit(seed), "shard", "doc_id", "copy"))
