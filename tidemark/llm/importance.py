"""Importance resampling towards a target text collection, by a dictionary of distinct n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.scratch import written

GRAMS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, "2024"
#: An n-gram is frequent if more than one in so many (text, n-gram) pairs are its own; so there are
#: never more frequent ones than that, some ten bytes each, which is what bounds their broadcast.
FREQUENT = 200_000
#: Rows of a range of the global order.
RANGE_ROWS = 250_000
#: A-Z to a-z, letters, digits and bytes above 127 as they are, all others to a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def grams_of(text: str, grams: int = GRAMS) -> tuple[int, Counter]:
    """(number of words, counts of all runs of 1 to ``grams`` words, in UTF-8)."""
    words = text.encode().translate(_PLAIN).split()
    counts = Counter(words)
    for n in range(2, grams + 1):
        counts.update(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return len(words), counts


def gram_counts(docs: DataFrame, *, text_column: str = "text", id_column: str | None = None, grams: int = GRAMS) -> DataFrame:
    """A row per text: doc_id (if ``id_column`` is told), n_words, n_features, grams and counts (arrays, each distinct n-gram once)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, totals, offsets, names, counts = [], [], [0], [], []
            for value in batch.column(batch.num_columns - 1):
                n, own = grams_of(value.as_py(), grams)
                sizes.append(n)
                totals.append(sum(own.values()))
                names += own.keys()
                counts += own.values()
                offsets.append(len(names))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), *lists], [*batch.schema.names[:-1], "n_words", "n_features", "grams", "counts"])

    ids = [] if id_column is None else [F.col(id_column).alias("doc_id")]
    first = "" if id_column is None else f"doc_id {docs.schema[id_column].dataType.simpleString()}, "
    return docs.select(*ids, text_of(text_column).alias("text")).mapInArrow(count, f"{first}n_words bigint, n_features bigint, grams array<string>, counts array<bigint>")


def _pairs(features: DataFrame, *take: str) -> DataFrame:
    return features.select(*take, F.explode(F.arrays_zip("grams", "counts")).alias("p")).select(*take, F.col("p.grams").alias("gram"), F.col("p.counts").alias("n"))


def dictionary(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Distinct n-grams of gram_counts(): gram, n (times in all), texts (that hold it), bucket. Each
    distinct string is hashed once; tasks count their own before they send them."""
    counts = _pairs(features).groupBy("gram").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    return counts.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"))


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of each bucket that the first dictionary uses:
    floor(1000 * ln of the smoothed share in the target over that in the rows)."""
    ours = own.groupBy("bucket").agg(F.sum("n").cast("double").alias("ours"))
    theirs = target.groupBy(F.col("bucket").alias("_bucket")).agg(F.sum("n").cast("double").alias("theirs"))
    # Two tables of ``buckets`` rows at most; a number of each comes to the driver.
    n_ours, n_theirs = (x.agg(F.sum(c)).first()[0] or 0.0 for x, c in ((ours, "ours"), (theirs, "theirs")))
    both = ours.join(theirs, F.col("bucket") == F.col("_bucket"), "left")
    ratio = (F.coalesce("theirs", F.lit(0.0)) + 1) * F.lit(n_ours + buckets) / ((F.col("ours") + 1) * F.lit(n_theirs + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _noise(seed: str) -> Column:
    """A Gumbel draw in thousandths, fixed by the seed and the id (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def gram_weights(features: DataFrame, gains: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(row, weight): the sum of each text's gains; texts without n-grams have no row.

    Frequent n-grams, of which there are at most ``frequent``, meet the texts by broadcast and are summed
    where the text is; pairs of all others, none of which is more than one in ``frequent`` of all, are
    shuffled by n-gram. ``gains``: gram, texts, gain.
    """
    total = gains.agg(F.sum("texts")).first()[0] or 0
    often = F.col("texts") * frequent > total
    few = F.broadcast(gains.filter(often).select(F.col("gram").alias("_gram"), "gain"))
    rest = gains.filter(~often).select(F.col("gram").alias("_gram"), "gain")
    pairs = _pairs(features, "row")
    same = F.col("gram") == F.col("_gram")
    near = pairs.join(few, same)
    far = pairs.join(few, same, "left_anti").join(rest.hint("merge"), same)
    part = lambda x: x.select("row", (F.col("gain") * F.col("n")).alias("weight"))
    return part(near).unionAll(part(far)).groupBy("row").agg(F.sum("weight").alias("weight"))


def ranked(rows: DataFrame, eligible: Column, order: list[Column], percent: int) -> DataFrame:
    """Add ``rank`` (1, 2, ...) for the first ``percent`` of a hundred of the eligible rows in the given order, null for others.

    The rows are laid out in ranges of the order and written; sums of the ranges, a row for each
    RANGE_ROWS rows, tell how many lie ahead of each, and rows are numbered within their range.
    """
    rows = rows.withColumn("_in", eligible)
    by = [F.desc("_in"), *order]
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    laid = written(rows.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()), "ranked")
    sums = laid.groupBy("_range").agg(F.count("*").alias("_rows"), F.sum(F.col("_in").cast("long")).alias("_eligible"))
    ahead = F.coalesce(F.sum("_rows").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("_eligible").over(Window.partitionBy(F.lit(1))) * percent / 100)
    offsets = sums.select(F.col("_range").alias("_of"), ahead.alias("_ahead"), drawn.alias("_drawn"))
    number = F.col("_ahead") + F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    # A row for each RANGE_ROWS rows: less than a megabyte for 10 billion rows, and joined by shuffle beyond Spark's own bound.
    placed = laid.join(offsets, F.col("_range") == F.col("_of")).withColumn("_number", number)
    return placed.withColumn("rank", F.when(F.col("_in") & (F.col("_number") <= F.col("_drawn")), F.col("_number"))).drop("_in", "_range", "_of", "_ahead", "_drawn", "_number")


def importance_resample(docs: DataFrame, target: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", target_column: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank.

    weight is the sum of the gains of a text's n-grams, score adds a Gumbel draw, so that the highest
    scores are a sample without replacement in proportion to the importance weights; rank numbers the
    drawn ones among texts of ``least_words`` words or more.

    Null and empty texts have no features, weight 0 and no rank; very long texts are counted whole; ties
    of score go to the smaller doc_id (null first), then fewer features; repeated rows are drawn one by
    one; an empty table of documents gives no rows and an empty target only smooths; other columns are
    not read, so none can clash.
    """
    features = written(gram_counts(docs, text_column=text_column, id_column=id_column, grams=grams).withColumn("row", F.monotonically_increasing_id()), "features")
    own = written(dictionary(features, buckets), "dictionary")
    gains = bucket_gains(own, dictionary(gram_counts(target, text_column=target_column, grams=grams), buckets), buckets)
    worth = written(own.join(F.broadcast(gains.withColumnRenamed("bucket", "_bucket")), F.col("bucket") == F.col("_bucket")).select("gram", "texts", "gain"), "gains")  # at most ``buckets`` rows
    weights = gram_weights(features, worth, frequent).withColumnRenamed("row", "_row")
    rows = features.join(weights, F.col("row") == F.col("_row"), "left").select("doc_id", "n_words", "n_features", F.coalesce("weight", F.lit(0)).alias("weight"))
    scored = rows.withColumn("score", F.col("weight") + _noise(seed))
    return ranked(scored, F.col("n_words") >= least_words, [F.desc("score"), F.asc("doc_id"), F.asc("n_features")], percent).select("doc_id", "n_features", "weight", "score", "rank")
