"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.llm._common import NON_WS, WS, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
#: Words of a block; small sources have smaller ones, so that each has BLOCKS_PER_SOURCE at least.
BLOCK_WORDS = 4096
BLOCKS_PER_SOURCE = 512
#: Words an output shard holds, up to twice as many; the number of shards is the power of two that follows.
SHARD_WORDS = 1 << 21
SEED = "mix"
#: Rounds of the permutation of a source's blocks, and how often a block outside them is sent on at most.
PERMUTATION_ROUNDS, WALKS = 4, 64
#: Up to so many shards of all sources are looked up in lists of their bounds; more meet the draws in a join.
LISTED_SHARDS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"{NON_WS}+")).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Targets per source from rows (``source``, ``source_size``): one row per source, null included.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; no target passes ``most`` times its source, and what is cut off is shared again by weight.
    That ends where every uncapped source gets one rate of words per weight: with sources ordered by
    the rate at which they reach their cap, the rate is the first that the next cap does not undercut."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most)).withColumn("_at", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy("_at", F.col("source").asc_nulls_last())
    rows = rows.withColumn("_goal", F.least(F.sum("source_size").over(everything) * share, F.sum("_cap").over(everything))).withColumn("_all_w", F.sum("_w").over(everything))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rate = (F.col("_goal") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_rate", rate)
    rate = F.max(F.when(F.col("_rate") <= F.col("_at"), F.col("_rate"))).over(everything)  # they fall from the first such source on
    return rows.withColumn("target", F.when(rate.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), rate * F.col("_w")))).select("source", "source_size", "target")


def _let(value: Column, body) -> Column:
    """``body`` of one value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric draw by inversion of ``u``: how many of ``drawn`` out of ``total`` are among ``marked``.

    Weights relative to the mode follow from the ratio of neighbours, over all values within some
    ten standard deviations of it; what lies beyond has less than 1e-20 of the mass."""

    def limits(p):
        low, high = F.greatest(F.lit(0).cast("long"), p["d"] + p["m"] - p["t"]), F.least(p["d"], p["m"])
        mode = F.least(high, F.greatest(low, F.floor((p["d"] + 1.0) * (p["m"] + 1.0) / (p["t"] + 2.0)).cast("long")))
        part = p["m"] / F.greatest(p["t"], F.lit(1).cast("long"))
        reach = (F.ceil(F.sqrt(p["d"] * part * (1 - part)) * 10) + 12).cast("long")
        ends = F.struct(mode.alias("mode"), low.alias("low"), high.alias("high"), reach.alias("reach"))
        return _let(ends, lambda e: walk(p, e))

    def walk(p, e):
        span = F.struct(e["mode"].alias("mode"), F.greatest(e["low"], e["mode"] - e["reach"]).alias("first"), F.least(e["high"], e["mode"] + e["reach"]).alias("last"))
        return _let(span, lambda s: invert(p, s))

    def invert(p, s):
        def ratio(x):  # weight(x) / weight(x - 1)
            return (p["m"] - x + 1) * (p["d"] - x + 1.0) / (x * (p["t"] - p["m"] - p["d"] + x + 0.0))

        none = F.array().cast("array<bigint>")
        downward = F.when(s["mode"] > s["first"], F.sequence(s["first"] + 1, s["mode"])).otherwise(none)
        upward = F.when(s["last"] > s["first"], F.sequence(s["first"] + 1, s["last"])).otherwise(none)
        start = F.aggregate(F.reverse(downward), F.lit(1.0), lambda w, x: w / ratio(x))

        def climb(w0):
            whole = F.aggregate(upward, F.struct(w0.alias("w"), w0.alias("s")), lambda a, x: _let(a["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))))
            return _let(whole["s"] * p["u"], lambda goal: descend(w0, goal))

        def descend(w0, goal):
            state = F.struct(s["first"].alias("x"), w0.alias("w"), w0.alias("s"))
            return F.aggregate(upward, state, lambda a, x: F.when(a["s"] >= goal, a).otherwise(_let(a["w"] * ratio(x), lambda w: F.struct(x.alias("x"), w.alias("w"), (a["s"] + w).alias("s")))))["x"]

        return _let(start, climb)

    return _let(F.struct(total.alias("t"), marked.alias("m"), drawn.alias("d"), u.alias("u")), limits)


def permuted(block: Column, blocks: Column, *key: Column) -> Column:
    """The place of ``block`` in a permutation of 0 .. ``blocks`` - 1 that the ``key`` (seed, source, round) picks.

    A block is a cell of a grid about as high as wide; by turns its row and its column are shifted by a
    hash of the other, which permutes the grid. A cell outside the blocks is permuted again until it is
    inside: the grid has less than a row too many, so that happens once in a while."""

    def shift(p, i):
        row, column = p["row"], p["column"]
        moved = lambda own, other, size: F.pmod(own + F.pmod(F.xxhash64(*key, i, other), size), size)
        return F.when(i % 2 == 0, F.struct(moved(row, column, p["high"]).alias("row"), column.alias("column"), p["high"].alias("high"), p["wide"].alias("wide"))).otherwise(
            F.struct(row.alias("row"), moved(column, row, p["wide"]).alias("column"), p["high"].alias("high"), p["wide"].alias("wide")))

    def once(x, g):
        start = F.struct(F.floor(x / g["wide"]).cast("long").alias("row"), F.pmod(x, g["wide"]).alias("column"), g["high"].alias("high"), g["wide"].alias("wide"))
        return _let(F.aggregate(F.array(*[F.lit(i) for i in range(PERMUTATION_ROUNDS)]), start, shift), lambda p: p["row"] * p["wide"] + p["column"])

    def walk(g):
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(block, g), lambda x, _: F.when(x < blocks, x).otherwise(once(x, g)))

    high = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    grid = _let(high, lambda h: F.struct(h.alias("high"), F.ceil(blocks / h).cast("long").alias("wide")))
    found = _let(grid, walk)
    return _let(found, lambda x: F.when(x < blocks, x).otherwise(F.raise_error(F.lit("a block found no place")).cast("long")))


def _shard_at(bounds: Column, turn: Column) -> Column:
    """The number of the last of the ascending ``bounds`` that is not above ``turn``, by bisection; of equal ones, the last."""

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).when(F.element_at(bounds, middle + 1) <= turn, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size(bounds) - 1).alias("high")), halve)["low"].cast("long")


def _joined_shards(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``placed`` with the shard of each of its draws, by a join of draws to the shards' ranges.

    Ranges and draws meet in steps of turns as wide as a source's ranges on average, so a step has a few of either."""
    width = F.greatest(F.lit(1).cast("long"), F.floor(F.col("quota") / F.col("_shards"))).cast("long")
    placed = materialize(placed.withColumn("_row", F.monotonically_increasing_id()), "mix-draws")
    draws = placed.select("_row", "_key", "quota", F.explode("draws").alias("_d")).withColumn("_shards", F.lit(cells.agg(F.max("shard") + 1).first()[0] or 1))
    draws = draws.withColumn("_step", F.floor(F.col("_d.turn") / width).cast("long")).select("_row", "_key", "_d", "_step")
    cells = cells.where("blocks > 0").withColumn("_shards", F.lit(cells.agg(F.max("shard") + 1).first()[0] or 1))
    steps = F.sequence(F.floor(F.col("first") / width).cast("long"), F.floor((F.col("first") + F.col("blocks") - 1) / width).cast("long"))
    ranges = cells.select(_named(F.col("source")).alias("_ck"), "shard", "first", "blocks", F.explode(steps).alias("_cstep"))
    inside = (F.col("_key") == F.col("_ck")) & (F.col("_step") == F.col("_cstep")) & (F.col("_d.turn") >= F.col("first")) & (F.col("_d.turn") < F.col("first") + F.col("blocks"))
    found = draws.join(ranges, inside).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_d.turn", "shard"))).alias("_found"))
    joined = placed.join(found, "_row", "left")
    by_turn = F.map_from_entries(F.coalesce("_found", F.array().cast("array<struct<turn:bigint,shard:bigint>>")))
    return joined.withColumn("draws", F.transform("draws", lambda d: d.withField("shard", F.element_at(by_turn, d["turn"])))).drop("_row", "_found")


def _named(source: Column) -> Column:
    """A key of a source that is never null."""
    return F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))


def _drawer(level: int, seed: str):
    """The step of a node's draw that takes the next source's share of the left child."""

    def draw(a, k):
        marked = F.element_at(F.col("q"), k)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), k), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        x = F.when(a["drawn"] <= 0, F.lit(0).cast("long")).otherwise(hypergeometric(a["total"], marked, a["drawn"], u))
        return _let(x, lambda x: F.struct(F.concat(a["left"], F.array(x)).alias("left"), (a["total"] - marked).alias("total"), (a["drawn"] - x).alias("drawn")))

    return draw


def split_quotas(quotas: DataFrame, levels: int, seed: str = SEED) -> DataFrame:
    """Block ranges of each source for 2**levels shards: rows (``source``, ``shard``, ``first``, ``blocks``).

    A node of the tree holds the exact quota of every source; its left child gets half of the node's
    blocks, drawn as one multivariate hypergeometric: source by source, each a hypergeometric draw
    from what is left of both. The right child gets the rest. So each shard has the composition that
    cutting one random permutation of all blocks would give it, and quotas add up exactly."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = quotas.select("source", "quota", (F.row_number().over(order) - 1).alias("_k"))
    node = numbered.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "quota"))), lambda x: x["quota"]).alias("q"), F.max(F.lit(0)).alias("shard"))
    node = node.where(F.size("q") > 0).select(F.lit(0).cast("long").alias("shard"), "q", F.transform("q", lambda x: F.lit(0).cast("long")).alias("first"))
    for level in range(levels):
        if level and level % 8 == 0:  # nodes by now are worth spreading
            node = materialize(node.repartition("shard"), "mix-nodes")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        node = node.withColumn("_total", total)
        empty = F.struct(F.array().cast("array<bigint>").alias("left"), F.col("_total").alias("total"), F.floor(F.col("_total") / 2).cast("long").alias("drawn"))

        node = node.withColumn("_left", F.aggregate(F.sequence(F.lit(1), F.size("q")), empty, _drawer(level, seed))["left"])
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("_left").alias("q"), F.col("first").alias("first")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("q", "_left", lambda a, b: a - b).alias("q"), F.zip_with("first", "_left", lambda a, b: a + b).alias("first")),
        )
        node = node.select(F.explode(halves).alias("_h")).select("_h.*")
    cells = node.select("shard", F.posexplode(F.arrays_zip("q", "first")).alias("_k", "_c")).select("shard", "_k", F.col("_c.q").alias("blocks"), F.col("_c.first").alias("first"))
    return cells.join(numbered.select("source", "_k"), "_k").select("source", "shard", "first", "blocks")


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``id_col``, ``size``, ``source``, ``source_size``, ``target``, ``draws``.

    A source's documents, in an order given by hashes, are one stretch of words cut into blocks; each
    round through the source visits its blocks in a permutation of its own (``permuted``), and the mix takes the first
    blocks of that sequence up to its quota, the last one cut where the target ends. ``draws`` lists
    what is taken of the document: round, shard, place (order by it within a shard), turn, first word and
    words. Quotas are dealt to the shards by ``split_quotas``; as a shard's range of a source's
    permuted blocks is its own, shards share no draw. The column's metadata has the number of ``shards``.

    Null texts and texts without words have size 0 and no draws; a null source is a source, the last.
    Rows repeated with one id follow each other in the stretch. Cumulated sizes come from a two-level
    sum over hash buckets, so a source of any share of the rows is spread; targets and quotas of all
    sources meet in one row, so sources may number thousands, not millions. Reruns agree. Columns named
    in ``carry`` come along in a struct ``row`` (and are shuffled once). An empty table gives no rows;
    further columns are ignored, whatever their names."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*carry).alias("row")] if carry else []))
    rows = materialize(rows, "mix-sizes")
    narrow = rows.select("_id", "source", "size")
    stats = narrow.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count_distinct("source").alias("sources")).first()
    levels = max(0, math.floor(math.log2(max(1, share * stats["words"] / shard_words))))
    buckets = max(256, stats["n"] // 100_000)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights=weights, share=share, most=most)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / BLOCKS_PER_SOURCE))).cast("long")
    plan = plan.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    plan = plan.withColumn("words", F.round("target").cast("long"))
    # a round visits all blocks and gives source_size words, so what is left of the target is taken in blocks of the last round
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("quota", F.col("rounds") * F.col("blocks") + F.ceil((F.col("words") - F.col("rounds") * F.col("source_size")) / F.col("block")).cast("long"))
    plan = materialize(plan, "mix-plan")
    cells = split_quotas(plan.where("quota > 0").select("source", "quota"), levels, seed)
    listed = (stats["sources"] + 1) << levels <= LISTED_SHARDS  # a proven bound of what is broadcast: sources times shards
    if listed:
        bounds = cells.select(F.col("source").alias("_bs"), "shard", "first").groupBy("_bs").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "first"))), lambda x: x["first"]).alias("bounds"))
        plan = plan.join(bounds, F.col("source").eqNullSafe(F.col("_bs")), "left").drop("_bs")
    else:
        cells = materialize(cells.join(plan.select(F.col("source").alias("_bs"), "quota"), F.col("source").eqNullSafe(F.col("_bs"))).drop("_bs"), "mix-cells")
    plan = F.broadcast(materialize(plan.withColumnRenamed("source", "_source"), "mix-shards"))  # a row for each source

    # one key that is never null, so that the window and the join after it share one partitioning of the rows
    placed = rows.withColumn("_key", _named(F.col("source"))).withColumn("_hash", F.xxhash64(F.lit(seed), F.col("_id"))).withColumn("_bucket", F.pmod(F.col("_hash"), F.lit(buckets)))
    sums = placed.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_hash", "_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_upto", F.sum("size").over(inside)).join(sums, ["_key", "_bucket"])
    placed = placed.withColumn("_at", F.col("_base") + F.col("_upto") - F.col("size")).drop("_bucket", "_base", "_upto", "_hash")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    first_block, last_block = F.floor(F.col("_at") / F.col("block")).cast("long"), F.floor((F.col("_at") + F.col("size") - 1) / F.col("block")).cast("long")
    touched = F.when((F.col("size") > 0) & (F.col("quota") > 0), F.sequence(first_block, last_block)).otherwise(F.array().cast("array<bigint>"))

    def visits(r):
        return F.transform(touched, lambda b: F.struct(F.lit(r).cast("long").alias("round"), b.alias("block"), (F.lit(r) * F.col("blocks") + permuted(b, F.col("blocks"), F.lit(seed), F.col("source"), F.lit(r))).alias("turn")))

    per_round = [visits(r) for r in range(most)]
    turns = F.filter(F.concat(*per_round), lambda t: t["turn"] < F.col("quota"))
    # words of the last round that the whole blocks before the last one leave to it; the source's last block may be short
    last_words = F.col("words") - F.col("rounds") * F.col("source_size") - (F.col("quota") - F.col("rounds") * F.col("blocks") - 1) * F.col("block")

    def taken(t):
        start = F.greatest(F.col("_at"), t["block"] * F.col("block"))
        whole = F.least(F.col("_at") + F.col("size"), (t["block"] + 1) * F.col("block"))
        cut = F.least(whole, t["block"] * F.col("block") + last_words)
        stop = F.when((t["turn"] == F.col("quota") - 1) & (t["round"] == F.col("rounds")), cut).otherwise(whole)
        shard = _shard_at(F.col("bounds"), t["turn"]) if listed else F.lit(None).cast("long")
        return F.struct(t["round"].alias("round"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), F.col("source"), t["turn"]).alias("place"), t["turn"].alias("turn"), (start - F.col("_at")).alias("first_word"), F.greatest(stop - start, F.lit(0)).cast("long").alias("words"))

    placed = placed.withColumn("draws", F.filter(F.transform(turns, taken), lambda d: d["words"] > 0))
    if not listed:
        placed = _joined_shards(placed, cells)
    return placed.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", F.col("draws").alias("draws", metadata={"shards": 1 << levels}), *(["row"] if carry else []))


def taken_words(draws: Column) -> Column:
    return F.aggregate(draws, F.lit(0).cast("long"), lambda a, d: a + d["words"])


def drawn_rows(mixed: DataFrame, text_col: str = "text", *, id_col: str = "doc_id") -> DataFrame:
    """The mix as rows of the carried columns: one per round, shard and stretch of words drawn of a document.

    Partition k holds shard k, its rows ordered by place, so that blocks of all sources alternate as
    drawn; a block's documents stay in their stretch's order by hash. Neighbouring blocks of a document are one
    row, at the first one's place, if round and shard are the same. A stretch that is the whole document keeps its text as
    it is; others are its words with the white space after each. A carried ``n_chars`` becomes the
    length of the new text."""
    kind = "array<struct<round:bigint,shard:bigint,place:bigint,first:bigint,words:bigint>>"

    def add(a, d):
        new = F.struct(d["round"].alias("round"), d["shard"].cast("long").alias("shard"), d["place"].alias("place"), d["first_word"].cast("long").alias("first"), d["words"].alias("words"))
        last = F.try_element_at(a, F.lit(-1))
        grown = F.struct(*[last[c].alias(c) for c in ("round", "shard", "place", "first")], (last["words"] + d["words"]).alias("words"))
        follows = (F.size(a) > 0) & (last["round"] == d["round"]) & (last["shard"] == d["shard"]) & (last["first"] + last["words"] == d["first_word"])
        return F.when(follows, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(new)))

    stretches = F.aggregate("draws", F.array().cast(kind), add)
    rows = mixed.withColumn("_s", F.explode(stretches))
    text = F.col("row")[text_col]
    words = F.split(F.regexp_replace(text, f"^{WS}+", ""), f"(?<={WS})(?={NON_WS})")
    part = F.array_join(F.slice(words, (F.col("_s.first") + 1).cast("int"), F.col("_s.words").cast("int")), "")
    new = F.when((F.col("_s.first") == 0) & (F.col("_s.words") == F.col("size")), text).otherwise(part)
    rows = rows.withColumn("_new", new)
    names = [f.name for f in mixed.schema["row"].dataType.fields]
    made = {text_col: F.col("_new"), "n_chars": F.length("_new").cast(dict((f.name, f.dataType) for f in mixed.schema["row"].dataType.fields).get("n_chars", "long"))}
    rows = rows.select(F.col("_s.shard").cast("int").alias("_shard"), F.col("_s.place").alias("_place"), F.col(id_col).alias("_id"), F.col("_s.first").alias("_first"), F.struct(*[made.get(n, F.col("row")[n]).alias(n) for n in names]).alias("_row"))
    # a shard is a partition by its number: hashing would pile some shards onto one task
    rows = rows.repartitionById(mixed.schema["draws"].metadata["shards"], "_shard").sortWithinPartitions("_place", F.xxhash64("_id"), "_id", "_first")
    return rows.select("_row.*")
