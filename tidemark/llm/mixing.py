"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, words_of
from tidemark.scratch import written

#: Weights given to the sources in code-point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Documents that share one stretch of a source's shuffled order.
STRETCH = 512
#: Stretches whose offsets are summed in one task.
SPAN = 4096
#: Words of a packet of the queue, packets of a range of the sorted queue, and equal rows unfolded at a time.
PACKET = 128
RANGE_PACKETS = 250_000
ALIKE = 1024


def source_targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of the sources (source, source_size) -> (+ weight, number, target).

    The targets share the sum of all sizes by weight and stop at ``max_repeats`` times the source's
    size; what is cut off is shared again by weight among the others. That fixed point is a water
    level: with the sources in order of cap / weight, the level that uses up the budget after the
    first k caps is (budget - caps) / (weights left), and the first k whose next source is not
    flooded gives it. One row per source is all this reads.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("number", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(kinds, ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = ranked.select(
        "*",
        ((F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # Past that k the quotient only falls, so the largest that fits is the first.
    level = level.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return level.select("source", "source_size", "weight", "number", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def shuffle_key(id_column: str, seed: str = "") -> Column:
    """Order of the shuffle: a digest of the id, so reruns agree."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary"))


def waiting(docs: DataFrame, size: Column, *, id_column: str = "doc_id", source_column: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "") -> DataFrame:
    """One row per document with its place in its source's shuffled stream: doc_id, source, size, key,
    source_size, target, number (the source's, in code-point order), start (words ahead of it).

    Rows that agree in id, source and size are folded into one with a count before anything is
    ordered, and unfolded in stretches at the end. Sums within a source are taken in two steps: sums of
    stretches of the shuffled order (a hash range of some hundred documents), then within a stretch,
    so that a source with a third of all rows is spread over many tasks.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), size.cast("long").alias("size"), shuffle_key(id_column, seed).alias("key"))
    base = written(rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    stretches = max(1, -(-base.count() // STRETCH))
    base = base.withColumn("stretch", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(stretches) / F.lit(2**32)).cast("long"))
    words = F.col("size") * F.col("alike")
    parts = base.groupBy("source", "stretch").agg(F.sum(words).alias("part"))
    parts = parts.withColumn("span", F.floor(F.col("stretch") / SPAN))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, max_repeats)
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.groupBy("source", "span").agg(F.sum("part").alias("part")).select("source", "span", F.coalesce(F.sum("part").over(running), F.lit(0)).alias("ahead"))
    told = ["source_size", "target", "number"]
    spans = _join(spans, targets, ["source"], told)
    within = Window.partitionBy("source", "span").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead_in_span", F.coalesce(F.sum("part").over(within), F.lit(0)))
    offsets = _join(parts, spans, ["source", "span"], ["ahead", *told]).withColumn("before", F.col("ahead") + F.col("ahead_in_span"))
    inner = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = _join(base, offsets, ["source", "stretch"], ["before", *told]).withColumn("first", F.col("before") + F.coalesce(F.sum(words).over(inner), F.lit(0)))
    some = placed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("alike") - 1) / ALIKE))))
    each = some.withColumn("no", F.explode(F.sequence(F.col("lot") * ALIKE, F.least("alike", (F.col("lot") + 1) * ALIKE) - 1)))
    return each.select("doc_id", "source", "size", "key", *told, (F.col("first") + F.col("no") * F.col("size")).cast("long").alias("start"))


def _packet(epoch, number):
    """(position in the source's stream, words, virtual finish time) of a packet of a document's copy."""
    position = F.lit(epoch).cast("long") * F.col("source_size") + F.col("start") + F.lit(PACKET) * number
    words = F.least(F.lit(PACKET), F.col("size") - F.lit(PACKET) * number)
    return position, words, (position + words).cast("double") / F.col("target")


def _last_packet() -> Column:
    return F.floor((F.col("size") - 1) / PACKET)


def budget_cut(placed: DataFrame, max_repeats: int = MAX_REPEATS):
    """The packet of the queue in which the budget, the sum of all sizes, is used up: a row of its
    finish, number, position and of the words ``left`` for it. None where there are no words.

    The packets of all copies are sorted globally by (finish, source, position) in ranges; running
    sums over the ranges find the range of the cut, those within it the packet. Two single rows reach
    the driver.
    """
    size = placed.filter("size > 0").agg(F.sum("size").alias("budget"), F.sum(_last_packet() + 1).alias("packets")).first()
    budget = size["budget"] or 0
    if not budget:
        return None
    copies = placed.filter("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), _last_packet())))
    position, words, finish = _packet(F.col("epoch"), F.col("packet"))
    order = ["finish", "number", "position"]
    packets = copies.select(finish.alias("finish"), "number", position.alias("position"), words.alias("words"))
    ranges = max(1, -(-size["packets"] * max_repeats // RANGE_PACKETS))
    queue = written(packets.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "mix-queue")
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = queue.groupBy("range").agg(F.sum("words").alias("words")).withColumn("ahead", ahead)
    hit = totals.filter((F.col("ahead") < budget) & (F.col("ahead") + F.col("words") >= budget)).first()
    ahead = F.lit(hit["ahead"]) + F.coalesce(F.sum("words").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = queue.filter(F.col("range") == hit["range"]).withColumn("ahead", ahead)
    return inside.filter((F.col("ahead") < budget) & (F.col("ahead") + F.col("words") >= budget)).select(*order, (F.lit(budget) - F.col("ahead")).alias("left")).first()


def _taken(cut, epoch: int) -> Column:
    """Words that the mix takes of a document's copy: its packets ahead of the cut, and what is left for that one."""

    def ahead(number: Column) -> Column:
        position, _, finish = _packet(epoch, number)
        tie = (F.col("number") < cut["number"]) | (F.col("number") == cut["number"]) & (position < cut["position"])
        return (finish < cut["finish"]) | (finish == cut["finish"]) & tie

    def served(acc: Column, number: Column) -> Column:
        position, words, _ = _packet(epoch, number)
        here = (F.col("number") == cut["number"]) & (position == cut["position"])
        return acc + F.when(here, F.lit(cut["left"])).when(ahead(number), words).otherwise(F.lit(0)).cast("long")

    first = F.lit(0).cast("long")
    met = ahead(first) | (F.col("number") == cut["number"])
    part = F.aggregate(F.sequence(first, _last_packet()), first, served)
    return F.when(F.col("size") <= 0, F.lit(0)).when(ahead(_last_packet() + 1), F.col("size")).when(met, part).otherwise(F.lit(0))


def fair_queue(docs: DataFrame, size: Column, *, max_repeats: int = MAX_REPEATS, **kw) -> DataFrame:
    """One row per document: the columns of waiting() and ``taken``.

    A source's stream is its shuffled order, repeated up to ``max_repeats`` times. It is queued in
    packets: a document's copy of more than PACKET words is several. The virtual finish time of a
    packet is the source's words up to and with it over the source's target. All packets are sorted
    globally by it and cut, to the word, where their running total is the budget, the sum of all
    sizes; ``taken`` is what lies ahead of the cut. Packets keep a long document from holding up its
    source, so that each source gets its target to about a packet.

    Empty or null texts have size 0 and take 0; very long texts are many packets; ties of finish times
    go by source, then by place in the stream, so reruns agree; repeated rows are served one after the
    other; an empty table gives no rows. Other columns are not read, so none can clash. One row per
    source meets in a task, to rank the sources.
    """
    placed = written(waiting(docs, size, max_repeats=max_repeats, **kw), "mix-waiting")
    cut = budget_cut(placed, max_repeats)
    taken = F.lit(0)
    for epoch in range(max_repeats if cut else 0):
        taken = taken + _taken(cut, epoch)
    return placed.withColumn("taken", taken.cast("long"))


def _join(a: DataFrame, b: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """Inner join on keys where null equals null; of b only the columns ``take`` are kept."""
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *take)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return a.join(b, on).drop(*[f"_b_{k}" for k in keys])


def copies(queue: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, in whole or in part: doc_id, source, epoch, words, finish."""
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    each = queue.filter("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    finish = (F.col("epoch") * F.col("source_size") + F.col("start") + F.col("size")) / F.col("target")
    return each.select("doc_id", "source", "epoch", words.alias("words"), finish.alias("finish"))


def served_order(queue: DataFrame) -> DataFrame:
    """The mix itself: copies() in global order of virtual finish times."""
    return copies(queue).orderBy("finish", "source", "epoch", "doc_id")


def mix_documents(docs: DataFrame, text_column: str = "text", **kw) -> DataFrame:
    """fair_queue() over a table of texts; the size is the number of words."""
    return fair_queue(docs, F.size(words_of(text_of(text_column))), **kw)
