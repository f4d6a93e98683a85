"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. Built-in functions only.

1. Sizes per source give each source's target: its weighted share of the whole, at most max_epochs times its own size, the
   excess shared again by weight. This is one level for all sources: target = min(cap, level * weight).
2. Documents fall into blocks of about block_docs by a hash of id, text, source and, where rows repeat all three, a number
   of the copy; so a block number is already a random place in a permutation of the source and a hot source or a group of
   copies is spread over as many blocks as it needs. A source draws whole passes over all of its blocks, then blocks in order
   up to the remainder; in the last one, documents are taken in hash order while they fit, and what is still free is filled
   with the largest documents of the later blocks that fit, then with smaller ones until none fits.
3. The whole blocks drawn of each source are its quota. The quotas are split among output shards by a binary tree: each node deals
   its quotas to its two halves by a multivariate hypergeometric draw (one source after another), exactly conserving them.
4. Consecutive drawn blocks of a source go to the shards in order of its leaf quotas, and the documents of its remainder to
   shards by hash; a document's copy is placed in its shard by a hash, which is the local shuffle.

Texts are read once for a thin table (hash, size, source) that decides what to take, and once for the result. Of the thin
table only sources, blocks (one row for some hundred documents) and the last block of each source are aggregated; texts are
never moved to decide.

Cases: null and empty texts have size 0 and are never taken; the null source is a source of its own and comes last; sources
without words have target 0; repeated rows, null ids and different texts under one id are separate documents, each drawn on
its own (which of two equal rows is taken is not told apart); very long documents are taken where they fit; ties of hashes
cannot be told apart either and are taken together; columns of the names that are added are replaced, and other names may
clash with nothing inside; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
BLOCK_DOCS = 256
SHARD_WORDS = 8_000_000
SEED = 20240611
#: The table of sources is broadcast only up to this many sources; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per source: its place, rows, size, weight, target, whole passes, remaining words and number of blocks.

    sizes has _source, rows and source_size. The windows here run over one row per source.
    """
    place = Window.orderBy(F.col("_source").asc_nulls_last())
    df = sizes.withColumn("_sidx", (F.row_number().over(place) - 1).cast("int"))
    df = df.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_sidx") % len(weights) + 1))
    df = df.withColumn("_cap", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_sidx")
    done, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    goal = share * F.sum("source_size").over(Window.partitionBy())
    # The level if exactly the sources before this one are capped; sources are capped while theirs lies under it.
    level = (goal - F.coalesce(F.sum("_cap").over(done), F.lit(0.0))) / F.sum("_weight").over(ahead)
    df = df.withColumn("_level", level).withColumn("_free", F.col("_cap") / F.col("_weight") > F.col("_level"))
    least = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_weight"), "_sidx", "_level"))).over(Window.partitionBy())
    df = df.withColumn("target", F.when(least.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), least["_level"] * F.col("_weight"))))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("int")
    df = df.withColumn("_passes", passes).withColumn("_rest", F.greatest(F.round("target").cast("long") - F.col("_passes") * F.col("source_size"), F.lit(0).cast("long")))
    blocks = F.greatest(F.ceil(F.col("rows") / F.lit(block_docs)), F.lit(1)).cast("int")
    return df.withColumn("_n_blocks", blocks).select("_source", "_sidx", "rows", "source_size", "_weight", "target", "_passes", "_rest", "_n_blocks")


def _running(df: DataFrame, key: str, order: str, value: str, span: int = 1024) -> DataFrame:
    """df with _before: the sum of value over the rows of the key that come earlier. Two levels, so no task sees a whole key."""
    parts = df.groupBy(key, F.floor(F.col(order) / span).alias("_part")).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(key, F.floor(F.col(order) / span)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = df.join(parts, (F.col(key) == F.col("_k")) & (F.floor(F.col(order) / span) == F.col("_p")))
    return joined.withColumn("_before", F.col("_base") + F.col("_within")).drop("_k", "_p", "_base", "_within")


def _uniform(*columns) -> Column:
    """A repeatable draw in (0, 1) for these values."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _ln_factorial(n: Column) -> Column:
    """ln n! for whole n >= 0: exact products up to 8, Stirling's series beyond (error under 1e-9)."""
    n = n.cast("double")
    x = n + 1.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0))) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(9)]), F.least(n, F.lit(8.0)).cast("int") + 1)
    return F.when(n <= 8, small).otherwise(series)


def _let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` items are among `drawn` of `total`: the inverse of the distribution function at u, over a range
    of twelve deviations around the mean (or all there is)."""
    lnc = lambda n, k: _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)

    def spread(v):
        mean = v["n"] * v["m"] / F.greatest(v["t"], F.lit(1.0))
        sd = F.sqrt(F.greatest(mean * (1 - v["m"] / F.greatest(v["t"], F.lit(1.0))) * (v["t"] - v["n"]) / F.greatest(v["t"] - 1, F.lit(1.0)), F.lit(0.0)))
        low = F.greatest(F.lit(0.0), v["n"] + v["m"] - v["t"], F.floor(mean - 12 * sd - 2).cast("double"))
        high = F.least(v["m"], v["n"], F.ceil(mean + 12 * sd + 2).cast("double"))
        return F.struct(v["t"].alias("t"), v["m"].alias("m"), v["n"].alias("n"), v["u"].alias("u"), low.alias("low"), high.alias("high"), lnc(v["t"], v["n"]).alias("whole"))

    def search(v):
        mass = lambda x: F.exp(lnc(v["m"], x) + lnc(v["t"] - v["m"], v["n"] - x) - v["whole"])
        start = F.struct(F.lit(0.0).alias("p"), v["high"].alias("x"), F.lit(False).alias("found"))

        def step(s, x):
            more = F.when(s["found"], s["p"]).otherwise(s["p"] + mass(x.cast("double")))
            return _let(more, lambda p: F.struct(p.alias("p"), F.when(~s["found"] & (p >= v["u"]), x.cast("double")).otherwise(s["x"]).alias("x"), (p >= v["u"]).alias("found")))

        return F.aggregate(F.sequence(v["low"].cast("long"), v["high"].cast("long")), start, step, lambda s: s["x"].cast("long"))

    whole = F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("n"), u.alias("u"))
    return _let(_let(whole, spread), search)


def split_quotas(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """(_sidx, quota) of the whole -> (_sidx, _shard, quota) of 2**levels shards.

    One row for each node and source on the way. At each node the left half takes half of the node's blocks; the sources draw
    in order, each from what the earlier ones left, by running sums over the node's sources.
    """
    df = quotas.select("_sidx", F.col("quota").cast("long").alias("quota"), F.lit(0).cast("long").alias("_shard"))
    for level in range(levels):
        # The sources' draws depend on each other, so each node folds over its list of sources.
        node = df.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("_sidx", "quota"))).alias("_q"), F.sum("quota").alias("_all"))
        start = F.struct(F.col("_all").alias("total"), F.floor((F.col("_all") + F.col("_shard") % 2) / 2).cast("long").alias("need"), F.array().cast("array<struct<_sidx:int,quota:bigint,_shard:bigint>>").alias("out"))
        dealt = F.aggregate("_q", start, _deal(_uniform, seed, level), lambda s: s["out"])
        df = node.select(F.inline(dealt))
    return df


def _deal(draw, seed: int, level: int):
    """A fold step: one source's quota of a node is dealt to the left and the right half."""

    def step(s, q):
        got = hypergeometric(s["total"], q["quota"], s["need"], draw(F.lit(seed), F.lit(level), F.col("_shard"), q["_sidx"]))
        half = lambda n, side: F.struct(q["_sidx"].alias("_sidx"), n.alias("quota"), (F.col("_shard") * 2 + side).alias("_shard"))
        return _let(got, lambda g: F.struct((s["total"] - q["quota"]).alias("total"), (s["need"] - g).alias("need"), F.concat(s["out"], F.array(half(g, 0), half(q["quota"] - g, 1))).alias("out")))

    return step


ADDED = ["size", "source_size", "target", "copies", "taken", "shards"]
#: Documents of later blocks that are tried first for what the last block leaves free, the largest that fit before others; where
#: that is not enough, rounds of smaller ones follow.
FILL = 256


def _numbered(rows: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """rows with _u, a hash of each row's own: its _h, or for rows that repeat a _h, that and a number of the copy."""
    if repeats is None:
        return rows.withColumn("_u", F.col("_h"))
    marked = rows.join(repeats, F.col("_h") == F.col("_r"), "left")
    again = marked.where("_r IS NOT NULL").drop("_r").withColumns({"_o": F.monotonically_increasing_id(), "_one": F.lit(1)})
    again = _running(materialize(again, "mix-repeated"), "_h", "_o", "_one", 1 << 20)
    again = again.withColumn("_u", F.when(F.col("_before") == 0, F.col("_h")).otherwise(F.xxhash64("_h", "_before"))).drop("_o", "_one", "_before")
    return marked.where("_r IS NULL").drop("_r").withColumn("_u", F.col("_h")).unionByName(again)


def _fold(items: Column, room: Column) -> Column:
    """(room, ids): items (o, u, w) in order, each taken if its words w still fit."""
    start = F.struct(room.alias("room"), F.array().cast("array<bigint>").alias("ids"))

    def take(s, d):
        fits = (d["w"] > 0) & (d["w"] <= s["room"])
        return F.struct(F.when(fits, s["room"] - d["w"]).otherwise(s["room"]).alias("room"), F.when(fits, F.concat(s["ids"], F.array(d["u"]))).otherwise(s["ids"]).alias("ids"))

    return F.aggregate(items, start, take)


def _fill_on(thin: DataFrame, picked: DataFrame, small, seed: int) -> DataFrame | None:
    """(_sidx, _u) of further documents that fill what the largest ones left free, where many small ones are needed.

    Each round takes, of the documents of a source's later blocks that still fit, as many in hash order as fit together (running
    sums, in tasks of bounded size); what is free is then less than the next one's size, so rounds are few. It ends when the
    free room of every source is under the size of its smallest document left.
    """
    spare = lambda room, taken: thin.join(small(room), "_sidx").where((F.col("_block") > F.col("_last")) & F.col("size").between(1, F.col("_room"))).join(taken, ["_sidx", "_u"], "left_anti")
    taken = picked.select("_sidx", F.explode("_ids").alias("_u"))
    room, more, step = picked.select("_sidx", "_last", "_room"), None, 0
    while True:
        left = spare(room, taken)
        if left.isEmpty():
            return more
        order = F.pmod(F.xxhash64(F.lit(seed + 3), "_u"), F.lit(1 << 30))
        ran = _running(materialize(left.withColumn("_o", order), f"mix-left-{step}"), "_sidx", "_o", "size", 1 << 18)
        fits = materialize(ran.where(F.col("_before") + F.col("size") <= F.col("_room")).select("_sidx", "_u", "size"), f"mix-more-{step}")
        used = fits.groupBy("_sidx").agg(F.sum("size").alias("_used"))
        room = materialize(room.join(used, "_sidx").select("_sidx", "_last", (F.col("_room") - F.col("_used")).alias("_room")), f"mix-room-{step}")
        more = fits.select("_sidx", "_u") if more is None else more.unionByName(fits.select("_sidx", "_u"))
        taken, step = taken.unionByName(fits.select("_sidx", "_u")), step + 1


def _mixed(
    docs: DataFrame, text: str, source: str, doc_id: str, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
    block_docs: int = BLOCK_DOCS, shard_words: int = SHARD_WORDS, seed: int = SEED, sized: str | None = None,
) -> DataFrame:
    """mix() of docs whose column names clash with nothing here, with _u, the hash of each row's own."""
    own = F.col(sized).cast("long") if sized else n_words(text)
    keyed = docs.withColumns({"size": own, "_source": F.col(source), "_h": F.xxhash64(F.lit(seed), doc_id, text, source)})
    thin = materialize(keyed.select("_h", "size", "_source"), "mix-thin")
    repeats = materialize(thin.groupBy("_h").count().where("count > 1").select(F.col("_h").alias("_r")), "mix-repeats")
    repeats = None if repeats.isEmpty() else repeats
    sizes = thin.groupBy("_source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, max_epochs, block_docs), "mix-sources")
    totals = targets.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    small = lambda df: F.broadcast(df) if totals["n"] <= BROADCAST_SOURCES else df
    of_source = small(targets.select(F.col("_source").alias("_s"), "_sidx", "_n_blocks"))
    thin = _numbered(thin, repeats).join(of_source, F.col("_source").eqNullSafe(F.col("_s")))
    bucket = F.pmod("_u", F.col("_n_blocks")).cast("int")
    thin = thin.select("_sidx", "_u", "size", bucket.alias("_block"))
    if repeats is not None:
        thin = materialize(thin, "mix-numbered")
    blocks = materialize(thin.groupBy("_sidx", "_block").agg(F.sum("size").alias("words")), "mix-blocks")
    # The block in which each source's remainder ends, what of it fits, and what fills the rest.
    reach = _running(blocks, "_sidx", "_block", "words").join(small(targets.select("_sidx", "_rest")), "_sidx")
    last = reach.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("words")))
    last = last.select("_sidx", F.col("_block").alias("_last"), (F.col("_rest") - F.col("_before")).alias("_room"))
    item = F.struct(F.xxhash64(F.lit(seed + 1), "_u").alias("o"), F.col("_u").alias("u"), F.col("size").alias("w"))
    inside = thin.join(small(last), "_sidx").where(F.col("_block") == F.col("_last"))
    lists = inside.groupBy("_sidx", "_last", "_room").agg(F.sort_array(F.collect_list(item)).alias("_d"))
    picked = materialize(lists.select("_sidx", "_last", _fold(F.col("_d"), F.col("_room")).alias("_got")), "mix-last")
    later = thin.join(small(picked.select("_sidx", "_last", F.col("_got.room").alias("_room"))), "_sidx").where((F.col("_block") > F.col("_last")) & F.col("size").between(1, F.col("_room")))
    largest = Window.partitionBy("_sidx").orderBy(F.desc("size"), "_u")
    later = later.withColumn("_n", F.row_number().over(largest)).where(F.col("_n") <= FILL)
    ordered = F.sort_array(F.collect_list(F.struct("_n", F.col("_u").alias("u"), F.col("size").alias("w"))))
    fill = later.groupBy("_sidx", "_room").agg(ordered.alias("_d")).select("_sidx", _fold(F.col("_d"), F.col("_room")).alias("_fill"))
    ids = F.concat(F.col("_got.ids"), F.coalesce("_fill.ids", F.array().cast("array<bigint>")))
    picked = picked.join(small(fill), "_sidx", "left").select("_sidx", "_last", ids.alias("_ids"), F.coalesce("_fill.room", "_got.room").alias("_room"))
    picked = materialize(picked, "mix-picked")
    more = _fill_on(thin, picked, small, seed)
    picked = picked.drop("_room")
    plan = targets.join(small(picked), "_sidx", "left").withColumn("_last", F.coalesce("_last", F.when(F.col("_rest") > 0, F.col("_n_blocks")).otherwise(F.lit(-1))))
    plan = materialize(plan, "mix-plan")
    # Shards: leaf quotas as runs over each source's drawn blocks (pass after pass, then the remainder's).
    shards = max(8, math.ceil((totals["words"] or 0) / shard_words))
    levels = math.ceil(math.log2(shards))
    quotas = plan.select("_sidx", (F.col("_passes") * F.col("_n_blocks") + F.greatest(F.col("_last"), F.lit(0))).alias("quota"))
    leaves = materialize(split_quotas(quotas, levels, seed), "mix-quotas")
    runs = _running(leaves, "_sidx", "_shard", "quota").where("quota > 0")
    drawn = runs.select("_sidx", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("quota") - 1)).alias("_rank"), "_shard")
    drawn = drawn.join(small(plan.select("_sidx", "_n_blocks")), "_sidx")
    in_order = F.sort_array(F.collect_list(F.struct("_rank", F.col("_shard").cast("int").alias("s"))))
    drawn = drawn.groupBy("_sidx", F.pmod("_rank", "_n_blocks").cast("int").alias("_block")).agg(F.transform(in_order, lambda x: x["s"]).alias("_shards"))
    of_source = small(plan.select(F.col("_source").alias("_s"), "_sidx", "source_size", "target", "_passes", "_n_blocks", "_last", "_ids"))
    out = _numbered(keyed, repeats).join(of_source, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_block", bucket)
    chosen = F.coalesce(F.array_contains("_ids", F.col("_u")), F.lit(False))
    if more is not None:
        out = out.join(more.select(F.col("_sidx").alias("_m"), F.col("_u").alias("_n"), F.lit(True).alias("_more")), (F.col("_sidx") == F.col("_m")) & (F.col("_u") == F.col("_n")), "left")
        chosen = chosen | F.coalesce("_more", F.lit(False))
    chosen = (F.col("_block") >= F.col("_last")) & chosen
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("_passes") + ((F.col("_block") < F.col("_last")) | chosen).cast("int")).cast("int")
    out = out.withColumn("copies", copies).join(drawn, ["_sidx", "_block"], "left")
    # What is taken of the last block, and what fills the rest, goes to shards by hash: whole blocks only are dealt by quota.
    extra = F.array(F.pmod("_u", F.lit(1 << levels)).cast("int"))
    held = F.slice(F.concat(F.coalesce("_shards", F.array().cast("array<int>")), extra), F.lit(1), F.col("copies"))
    out = out.withColumn("shards", held).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*docs.columns, *ADDED, "_u")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", sized: str | None = None, **settings) -> DataFrame:
    """docs with size, source_size, target, copies (how often the document is taken), taken (words), and shards (one per copy).

    sized: a column of sizes, where they are known; text may then be a fingerprint of the text. settings: weights of the
    sources in order, share of all words, max_epochs, block_docs, shard_words, seed.
    """
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    out = _mixed(docs.toDF(*at.values()), at[text], at[source], at[doc_id], sized=sized and at[sized], **settings)
    return out.select(*[F.col(n).alias(c) for c, n in at.items() if c not in ADDED], *ADDED)


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The documents of the mix, as often as they are taken, dealt to their shards and shuffled inside each."""
    at = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    out = _mixed(docs.toDF(*at.values()), at[text], at[source], at[doc_id], **settings)
    out = out.withColumn("_shard", F.explode("shards")).withColumn("_place", F.xxhash64(F.lit(SEED + 2), "_shard", "_u"))
    return out.repartition("_shard").sortWithinPartitions("_shard", "_place").select([F.col(n).alias(c) for c, n in at.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text"), n_words().alias("words"))
    return mix(materialize(thin, "mix-sizes"), sized="words").select("doc_id", "size", "source_size", "target", "taken", "shards")
