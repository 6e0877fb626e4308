"""Mixing sources to target weights with a low-discrepancy source schedule. DataFrame functions only.

Each source's documents are shuffled by hash into one stream of words, cut into blocks of equal words. Slot
``n`` of the schedule takes the van der Corput point of ``n`` through the cumulative target shares and so
names a source; the k-th slot of a source takes the k-th block of its stream, and the stream starts anew
after its last block. The last slot of a source is cut where its target ends. Slots that a source lacks
at the end of the schedule (a few, by the discrepancy of the points) follow after the others. So the points decide where in
the mix a document stands, and any first part of the mix holds the sources in their shares, up to the discrepancy; how much
of a source the whole mix holds is fixed by its target.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
never taken; repeated rows are documents of their own; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import few, keyed, materialise, on_key, query, table, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 2048
#: Shuffle buckets of a source, and slots numbered together: the parts in which hot sources are summed.
BUCKETS = 1024
SLOT_RUN = 4096
#: Binary digits of the van der Corput points, and cells in which shares are looked up.
DIGITS = 40
CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size and shuffle position (bucket, mix) of each document."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "source",
                       word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.lit("mix"), "doc_id").alias("mix")).withColumn(
        "bucket", F.pmod(F.col("mix"), F.lit(BUCKETS)).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """sid, source, source_size and target of each source, by water filling.

    Sources in order of their cap per weight: a source stops at its cap when the level that the words left
    over give is not below it; all sources after the last such one get that level times their weight. The
    windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per.withColumn("sid", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    capped = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = capped.withColumn("level", (
        F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))))
    stopped = levels.withColumn("stopped", F.col("cap") <= F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"]
    return stopped.withColumn("rest", rest).select(
        "sid", "source", "source_size",
        F.when(F.col("stopped"), F.col("cap")).otherwise(F.least("cap", F.col("rest") * F.col("weight"))).alias("target"))


def van_der_corput(n: Column, digits: int = DIGITS) -> Column:
    """The point of ``n`` in [0, 1): its binary digits mirrored at the point."""
    mirrored = F.reverse(F.lpad(F.bin(n), digits, "0"))
    return F.conv(mirrored, 2, 10).cast("double") / F.lit(float(2**digits))


def stream_plan(targets: DataFrame, block_words: int) -> DataFrame:
    """Per source with words: blocks of its stream, words to take, and how many slots that needs."""
    taken = F.round("target").cast("long")
    return targets.filter(F.col("source_size") > 0).select(
        "sid", "source", "source_size", "target", taken.alias("quota"),
        F.ceil(F.col("source_size") / block_words).alias("blocks")).withColumn(
        "needed", F.expr("quota div source_size") * F.col("blocks")
        + F.ceil(F.expr("quota % source_size") / block_words)).filter(F.col("needed") > 0)


def scheduled_slots(plan: DataFrame, slots: int) -> DataFrame:
    """(sid, rank, position): the source of each slot of the schedule, ranked within its source."""
    spark = plan.sparkSession
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("needed").over(whole)
    shares = plan.select("sid", "needed", ((F.sum("needed").over(upto) - F.col("needed")) / total).alias("low"),
                         (F.sum("needed").over(upto) / total).alias("high"))
    cells = shares.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(slots).withColumn("u", van_der_corput(F.col("id"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    named = points.join(cells, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    runs = named.withColumn("run", F.floor(F.col("id") / SLOT_RUN))
    before = runs.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("sid", "run").orderBy("id")) - 1
    return runs.withColumn("within", within).join(before, ["sid", "run"]).select(
        "sid", (F.col("before") + F.col("within")).alias("rank"), F.col("id").alias("position"), "needed").filter(
        F.col("rank") < F.col("needed")).drop("needed")


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: position, sid, rank, block and words taken of it (``upto``, from the block's start)."""
    slots = plan.agg(F.coalesce(F.sum("needed"), F.lit(0)).alias("n")).first()["n"]
    named = materialise(scheduled_slots(plan, slots), "mix-slots")
    found = named.groupBy("sid").agg((F.max("rank") + 1).alias("found"))
    left = plan.join(found, "sid", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(
        F.col("found") < F.col("needed")).select(
        "sid", F.explode(F.sequence(F.col("found"), F.col("needed") - 1)).alias("rank"), F.lit(slots).alias("position"))
    prior = F.expr("rank div blocks") * F.col("source_size") + F.col("block") * block_words
    return named.unionByName(left).join(plan, "sid").withColumn("block", F.expr("rank % blocks")).select(
        "position", "sid", "rank", "block", F.least(F.lit(block_words).cast("long"), F.col("quota") - prior).alias("upto"))


def document_spans(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each document starts in its source's shuffled stream of words.

    Words are summed per (source, bucket) first, so a hot source is numbered in as many parts as buckets.
    """
    keyed = sizes.join(targets.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    before = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn(
        "before", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).drop("words")
    inner = Window.partitionBy("sid", "bucket").orderBy("mix", "doc_id", "size")
    upto = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.withColumn("place", F.row_number().over(inner)).withColumn("_upto", upto).join(
        before, ["sid", "bucket"]).select(
        "doc_id", "text_hash", "sid", "bucket", "place", "size", (F.col("before") + F.col("_upto") - F.col("size")).alias("start"))


def taken_words(spans: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What the mix takes of each document: words (its overlap with every scheduled slot of its blocks), and the
    first ``position`` in the schedule at which it is taken, in the stream's first lap and (``again``) in its second.

    The slots of a block are gathered first: a block has at most two, as no target is above twice its source.
    """
    per_block = slots.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("position", "rank", "upto"))).alias("dealt"))
    last = F.expr(f"greatest(start, start + size - 1) div {block_words}")
    pieces = spans.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), last)))
    begin = F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))

    def words(slot: Column) -> Column:
        return F.when(slot.isNotNull(), F.greatest(F.least(end, slot["upto"]) - begin, F.lit(0))).otherwise(0).cast("long")

    one, two = F.get("dealt", 0), F.get("dealt", 1)
    return pieces.join(per_block, ["sid", "block"], "left").select(
        "sid", "bucket", "place", "doc_id", "text_hash", "size", (words(one) + words(two)).alias("words"),
        F.when(words(one) > 0, one["position"]).alias("position"), F.when(words(two) > 0, two["position"]).alias("again")).groupBy(
        "sid", "bucket", "place").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("size").alias("size"),
                                      F.sum("words").alias("taken"), F.min("position").alias("position"), F.min("again").alias("again"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken, and position and again in the schedule, of each document."""
    sizes = materialise(sized(docs), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most).coalesce(1), "mix-targets")
    slots = schedule(stream_plan(targets, block_words), block_words)
    spans = materialise(document_spans(sizes, targets), "mix-spans")
    return taken_words(spans, slots, block_words).join(targets, "sid").select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "taken", "position", "again")


def repeated(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them: whole texts, to the nearest number of times.

    Only the last document of a source's target is taken in part. Equal rows of a source share what is taken of them:
    as many whole texts as that gives, one more for some rows than for others. Only then do equal rows meet in a task.
    With ``in_order`` the rows are sorted by their positions, a shuffle of the texts; a document's second time stands
    where the second lap of its source reaches it.
    """
    times = materialise(mix(docs).filter("size > 0").groupBy("doc_id", "text_hash", "source").agg(
        F.round(F.sum("taken") / F.first("size")).cast("long").alias("all"), F.count(F.lit(1)).alias("copies"),
        F.min("position").alias("position"), F.min("again").alias("again")).filter("all > 0"), "mix-times")
    rows = keyed(docs)

    def taken(shares: DataFrame) -> DataFrame:
        shares = few(shares)
        return rows.join(shares, on_key(rows, shares) & F.col("row.source").eqNullSafe(shares["source"]))

    even, uneven = times.filter("all % copies = 0"), times.filter("all % copies > 0")
    counted = taken(even).select("row", F.expr("all div copies").alias("times"), "position", "again")
    if not uneven.isEmpty():
        nth = F.row_number().over(Window.partitionBy("key_id", "key_text", F.col("row.source")).orderBy("key_id"))
        numbered = taken(uneven).select("row", F.expr("all div copies").alias("times"), F.expr("all % copies").alias("more"), nth.alias("nth"), "position", "again")
        counted = counted.unionByName(numbered.select(
            "row", (F.col("times") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)).alias("times"), "position", "again"))
    dealt = counted.filter("times > 0").select("row", "position", "again", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"))
    if in_order:
        at = F.when(F.col("time") == 1, F.col("position")).otherwise(F.coalesce("again", "position"))
        dealt = dealt.select("row", at.alias("at")).repartitionByRange("at", F.xxhash64("row.doc_id")).sortWithinPartitions("at")
    return dealt.select("row.*")


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to weights 3, 1, 2 and 150 % of all words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "position")
