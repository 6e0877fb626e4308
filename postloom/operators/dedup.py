"""De-duplication: keys, first-per-key, and admission with a time to live.

Admission is a chain per key: an event opens a window when it is the first of its key or comes
at or after the end of the last window; up to ``limit`` events are admitted per window and a
rejected event never extends it. ``limit=1`` with seven days is the posting de-duplication,
``limit=3`` with one hour is the probe rate limit.

A row without an instant has no place in a chain: it is never admitted, and ``undated`` returns such
rows. A NULL key is a key like any other. Both hold for every plan and for the streams.

A chain is sequential within a key. The plan depends on the size of a key, the result does not:

* keys with few rows (``FOLD_ROWS``): one shuffle of (key, instant, id) and a fold over a short array;
* keys up to ``max_rows_per_key``: a linear scan of the sorted instants of one key in one task;
* hot keys (counted first, map-side): a row at least the time to live after its predecessor always
  opens a window, so the key is cut at such gaps, found from the first and last instant per stretch of
  the length of the time to live. Short pieces are scanned like keys. Long pieces go through time slices,
  one round per slice of the longest piece, with the window state carried in a table; where even one
  slice of the length of the time to live is too large, the round uses top-``limit`` windows that
  Spark prunes map-side.

No task ever holds more than ``max_rows_per_key`` rows of a key, and no row is dropped. The input is
written once under ``spark.checkpoint.dir`` and read from there; the owner of that folder clears it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom import schemas
from postloom.functions.text import col, norm
from postloom.session import shared_dir, shuffles_freed

MAX_ROWS_PER_KEY = 200_000
MAX_BROADCAST_KEYS = 50_000
FOLD_ROWS = 500
_LEVELS = 16
STATE_SCHEMA = "_k string, _start long, _n int"


# -- keys ---------------------------------------------------------------------------------


def producer_key(company: Column | str = "company", role: Column | str = "role") -> Column:
    return F.concat(F.lit("dedup:"), F.md5(F.concat_ws("::", norm(company), norm(role))))


def consumer_key(company: Column | str = "company", role: Column | str = "role") -> Column:
    return F.concat(F.lit("dedup:agg:"), F.md5(F.concat_ws("|", norm(company), norm(role))))


# -- first per key ------------------------------------------------------------------------


def dedup_first(df: DataFrame, key: Column | str, order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order. ``row_number() = 1`` is pruned before the shuffle."""
    window = Window.partitionBy(col(key)).orderBy(*[col(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def unique_url(incoming: DataFrame, target: DataFrame | None, order: Sequence[Column | str]) -> DataFrame:
    """Rows whose URL is new, both within the batch and against a table; NULL URLs all pass."""
    has_url = incoming.where(F.col("url").isNotNull())
    fresh = dedup_first(has_url, "url", order)
    if target is not None:
        known = target.where(F.col("url").isNotNull()).select("url").distinct()
        fresh = fresh.join(known, "url", "left_anti").select(*incoming.columns)
    return fresh.unionByName(incoming.where(F.col("url").isNull()))


# -- admission with a time to live --------------------------------------------------------


def state_key(key: Column) -> Column:
    """The key as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))


def undated(df: DataFrame, ts: Column | str) -> DataFrame:
    """Rows without an instant; admission leaves them out."""
    return df.where(col(ts).isNull())


def _instants(slim: DataFrame, limit: int) -> DataFrame:
    """Only the ``limit`` smallest ids of one instant of a key: no other can win.

    Pruned before the shuffle; worth it for hot keys, where many events share an instant.
    """
    if limit == 1:
        return slim.groupBy("_k", "_t").agg(F.min("_id").alias("_id"))
    window = Window.partitionBy("_k", "_t").orderBy("_id")
    return slim.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= limit).drop("_rn")


def _fold(slim: DataFrame, ttl: int, limit: int, state: DataFrame | None) -> DataFrame:
    """Per key the admitted ids and the last window, by a fold over the sorted instants."""
    per_key = slim.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_t", "_id"))).alias("_xs"))
    start, used = F.lit(None).cast("long"), F.lit(0)
    if state is not None:
        per_key = per_key.join(state.select("_k", "_start", "_n"), "_k", "left")
        start, used = F.col("_start"), F.coalesce(F.col("_n"), F.lit(0))
    id_type = slim.schema["_id"].dataType
    zero = F.struct(
        start.alias("start"), used.cast("int").alias("n"),
        F.array().cast(f"array<{id_type.simpleString()}>").alias("kept"),
    )

    def step(acc: Column, x: Column) -> Column:
        opens = acc["start"].isNull() | (x["_t"] >= acc["start"] + F.lit(ttl))
        fits = acc["n"] < F.lit(limit)
        return F.struct(
            F.when(opens, x["_t"]).otherwise(acc["start"]).alias("start"),
            F.when(opens, F.lit(1)).when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(opens | fits, F.concat(acc["kept"], F.array(x["_id"])))
            .otherwise(acc["kept"]).alias("kept"),
        )

    folded = per_key.select("_k", F.aggregate("_xs", zero, step).alias("_f"))
    return folded.select(
        "_k", F.col("_f.start").alias("_start"), F.col("_f.n").alias("_n"), F.col("_f.kept").alias("_ids")
    )


def admit_sorted(times: np.ndarray, ttl: int, limit: int, start: int | None, used: int) -> tuple[list[int], int | None, int]:
    """Positions admitted among sorted instants, and the window state after them."""
    kept: list[int] = []
    at = 0
    while at < len(times):
        if start is None or times[at] >= start + ttl:
            start, used = int(times[at]), 0
        end = int(np.searchsorted(times, start + ttl, side="left"))
        take = min(limit - used, end - at)
        if take > 0:
            kept.extend(range(at, at + take))
            used += take
        at = max(end, at)
    return kept, start, used


def _scan(slim: DataFrame, ttl: int, limit: int, state: DataFrame | None) -> DataFrame:
    """Admitted ids by a linear scan of each key; the caller bounds the rows of a key."""
    if state is None:
        rows = slim.select("_k", "_t", "_id", F.lit(None).cast("long").alias("_start"), F.lit(0).alias("_n"))
    else:
        rows = slim.join(state.select("_k", "_start", "_n"), "_k", "left").select("_k", "_t", "_id", "_start", "_n")

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("_t", "ascending"), ("_id", "ascending")])
        start, used = order.column("_start")[0].as_py(), order.column("_n")[0].as_py()
        kept, _, _ = admit_sorted(order.column("_t").to_numpy(), ttl, limit, start, used or 0)
        return order.select(["_id"]).take(pa.array(kept, pa.int64()))

    return rows.groupBy("_k").applyInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}")


def _dense_round(slim: DataFrame, ttl: int, limit: int, state: DataFrame) -> DataFrame:
    """One slice no longer than ``ttl``: at most one window opens in it per key.

    Rows before the end of the running window compete for its free places; later rows compete
    for the places of the next one. Both are top-n windows, so hot keys shrink before the shuffle.
    """
    rows = slim.join(state, "_k", "left")
    opens = F.col("_start").isNull() | (F.col("_t") >= F.col("_start") + F.lit(ttl))
    window = Window.partitionBy("_k", "_opens").orderBy("_t", "_id")
    ranked = (
        rows.withColumn("_opens", opens)
        .withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") <= limit)
    )
    kept = ranked.where(F.col("_opens") | (F.col("_rn") <= F.lit(limit) - F.col("_n")))
    return kept.groupBy("_k").agg(
        F.coalesce(F.min(F.when(F.col("_opens"), F.col("_t"))), F.first("_start")).alias("_start"),
        F.when(F.max("_opens"), F.count_if("_opens"))
        .otherwise(F.first("_n") + F.count_if(~F.col("_opens"))).cast("int").alias("_n"),
        F.collect_list("_id").alias("_ids"),
    )


def _slice_width(rows: DataFrame, ttl: int, bound: int) -> int | None:
    """Longest slice (a power of two of ``ttl``) in which no key exceeds the bound."""
    per_ttl = rows.groupBy("_k", "_b").count()
    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS)))
    sizes = (
        per_ttl.withColumn("_j", levels)
        .groupBy("_k", "_j", F.expr("shiftright(_b, _j)").alias("_s"))
        .agg(F.sum("count").alias("_c"))
        .groupBy("_j").agg(F.max("_c").alias("_c"))
    )
    fitting = [r["_j"] for r in sizes.collect() if r["_c"] <= bound]  # at most _LEVELS + 1 rows
    return ttl << max(fitting) if fitting else None


def _pieces(rows: DataFrame, ttl: int, state: DataFrame | None) -> DataFrame:
    """(key, stretch) with its piece: independent parts of a key between gaps of at least ``ttl``.

    Stretches have the length of ``ttl``, so a gap lies between two of them. Rows before the end of a
    carried window stay in the first piece. One row per key and stretch reaches the windows.
    """
    spans = rows.groupBy("_key", "_stretch").agg(
        F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.count(F.lit(1)).alias("_rows"))
    start = F.lit(None).cast("long")
    if state is not None:
        spans = spans.join(state.select(F.col("_k").alias("_key"), "_start"), "_key", "left")
        start = F.col("_start")
    order = Window.partitionBy("_key").orderBy("_stretch")
    opens = (F.col("_low") - F.lag("_high").over(order) >= ttl) & (start.isNull() | (F.col("_low") >= start + F.lit(ttl)))
    cut = spans.withColumn("_cut", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("_piece", F.sum("_cut").over(order))
    whole = Window.partitionBy("_key", "_piece")
    return cut.select("_key", "_stretch", "_piece", F.min("_stretch").over(whole).alias("_first"), F.sum("_rows").over(whole).alias("_rows"))


def _hot_admitted(slim: DataFrame, ttl: int, limit: int, state: DataFrame | None, bound: int) -> DataFrame:
    """Admitted ids of hot keys: short pieces by scans, long ones by rounds."""
    base = shared_dir(slim.sparkSession, "ttl-pieces")
    stretched = _stored(slim.select(F.col("_k").alias("_key"), "_t", "_id", F.floor(F.col("_t") / F.lit(ttl)).alias("_stretch")), f"{base}/rows")
    pieces = _stored(_pieces(stretched, ttl, state), f"{base}/pieces")
    name = F.concat_ws("#", F.col("_piece").cast("string"), "_key").alias("_k")
    rows = stretched.join(pieces, ["_key", "_stretch"]).select(
        name, "_t", "_id", (F.col("_stretch") - F.col("_first")).alias("_b"), F.col("_rows").alias("_size"))
    own = None
    if state is not None:
        own = _stored(pieces.where("_piece = 0").select("_key", "_piece").distinct().join(
            state.withColumnRenamed("_k", "_key"), "_key").select(name, "_start", "_n"), f"{base}/state")
    short = _scan(rows.where(F.col("_size") <= bound).select("_k", "_t", "_id"), ttl, limit, own)
    if pieces.where(F.col("_rows") > bound).isEmpty():
        return short
    return short.unionByName(_hot_chain(rows.where(F.col("_size") > bound).drop("_size"), ttl, limit, own, bound))


def _hot_chain(rows: DataFrame, ttl: int, limit: int, state: DataFrame | None, bound: int) -> DataFrame:
    """Admitted ids of long pieces: one round per time slice, state in a table between rounds.

    ``rows`` has (_k, _t, _id) and the stretch since the piece began (_b).
    """
    spark = rows.sparkSession
    base = shared_dir(spark, "ttl-chain")
    id_type = rows.schema["_id"].dataType.simpleString()
    rows = _stored(rows, f"{base}/rows")
    width = _slice_width(rows, ttl, bound)
    span = (width or ttl) // ttl
    sliced = rows.withColumn("_s", F.floor(F.col("_b") / F.lit(span)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced.repartition("_s", F.pmod(F.xxhash64("_k", "_t"), F.lit(parts))).write.partitionBy("_s").parquet(f"{base}/slices")
    slices = spark.read.parquet(f"{base}/slices")
    last = sliced.agg(F.max("_s").alias("_s")).first()["_s"]
    current = state if state is not None else spark.createDataFrame([], STATE_SCHEMA)
    step_schema = f"_k string, _start long, _n int, _ids array<{id_type}>"
    for number in range(last + 1):  # a piece has no gap, so every slice up to its end has rows
        part = slices.where(F.col("_s") == number).select("_k", "_t", "_id")
        step = _fold(part, ttl, limit, current) if width else _dense_round(part, ttl, limit, current)
        after = current.alias("c").join(step.alias("s"), "_k", "full_outer").select(
            "_k",
            F.coalesce("s._start", "c._start").alias("_start"),
            F.when(F.col("s._start").isNotNull(), F.col("s._n")).otherwise(F.col("c._n")).alias("_n"),
            F.col("s._ids").alias("_ids"),
        )
        after.write.parquet(f"{base}/rounds/{number}")
        current = spark.read.schema(step_schema).parquet(f"{base}/rounds/{number}").drop("_ids")
    rounds = spark.read.schema(step_schema).parquet(*[f"{base}/rounds/{n}" for n in range(last + 1)])
    return rounds.select(F.explode("_ids").alias("_id"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)  # keys and ids are hex: text of twice its size
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keys_of(keys: DataFrame) -> DataFrame:
    """Keys for a join: broadcast once counted as few."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys


def _admitted(slim: DataFrame, ttl: int, limit: int, state: DataFrame | None, bound: int, base: str) -> DataFrame:
    """Admitted ids (column ``_id``) of stored rows (_k, _t, _id), by size of key."""
    if state is not None:
        state = _stored(state.select(state_key(F.col("_k")).alias("_k"), "_start", "_n"), f"{base}/state")
    large = _stored(slim.groupBy("_k").count().where(F.col("count") > min(FOLD_ROWS, bound)), f"{base}/large")
    if large.isEmpty():
        return _fold(slim, ttl, limit, state).select(F.explode("_ids").alias("_id"))
    small = _fold(slim.join(_keys_of(large.select("_k")), "_k", "left_anti"), ttl, limit, state).select(F.explode("_ids").alias("_id"))
    middle = _keys_of(large.where(F.col("count") <= bound).select("_k"))
    ids = small.unionByName(_scan(slim.join(middle, "_k", "left_semi"), ttl, limit, state))
    hot = large.where(F.col("count") > bound).select("_k")
    if hot.isEmpty():
        return ids
    shrunk = _instants(slim.join(_keys_of(hot), "_k", "left_semi"), limit)
    return ids.unionByName(_hot_admitted(shrunk, ttl, limit, state, bound))


def admitted_ids(
    df: DataFrame, key: Column | str, ts: Column | str, event_id: str, ttl: timedelta, limit: int = 1,
    state: DataFrame | None = None, max_rows_per_key: int = MAX_ROWS_PER_KEY, base: str | None = None,
) -> DataFrame:
    """Ids (column ``event_id``) of the rows that ``admit`` keeps; its tables lie under ``base``."""
    base = base or shared_dir(df.sparkSession, "admission")
    dated = df.where(col(ts).isNotNull())
    slim = _stored(dated.select(state_key(col(key)).alias("_k"), F.unix_micros(col(ts).cast("timestamp")).alias("_t"),
                                F.col(event_id).alias("_id")), f"{base}/rows")
    return _admitted(slim, int(ttl.total_seconds() * 1_000_000), limit, state, max_rows_per_key, base).withColumnRenamed("_id", event_id)


def admit(
    df: DataFrame, key: Column | str, ts: Column | str, event_id: str, ttl: timedelta, limit: int = 1,
    state: DataFrame | None = None, max_rows_per_key: int = MAX_ROWS_PER_KEY, store_ids: bool = False,
) -> DataFrame:
    """Rows of ``df`` that are admitted; ``event_id`` must be unique per row.

    ``state`` holds (_k, _start, _n) of earlier runs, with the key as text in ``_k``. Only key, instant and id of each row
    are written; the other columns are read when the result is, so ``df`` must give the same ids both times (a
    micro-batch is persisted by the caller). ``store_ids`` writes the admitted ids too: for a result that is read more than once.
    """
    base = shared_dir(df.sparkSession, "admission")
    ids = admitted_ids(df, key, ts, event_id, ttl, limit, state, max_rows_per_key, base)
    if store_ids:
        ids = _stored(ids, f"{base}/ids")
    return df.where(col(ts).isNotNull()).join(ids, event_id, "left_semi").select(*df.columns)


def windows_after(
    admitted: DataFrame, key: Column | str, ts: Column | str, ttl: timedelta, limit: int, state: DataFrame | None = None,
) -> DataFrame:
    """(_k, _start, _n) of every key of ``admitted``: its last window and how many rows that admitted.

    Admitted rows replay to the same windows. A key has at most ``limit`` of them per window, so its
    instants form a short array even where it had many rows.
    """
    ttl_us = int(ttl.total_seconds() * 1_000_000)
    per_key = admitted.groupBy(col(key).cast("string").alias("_k")).agg(
        F.sort_array(F.collect_list(F.unix_micros(col(ts).cast("timestamp")))).alias("_xs"))
    start, used = F.lit(None).cast("long"), F.lit(0)
    if state is not None:
        known = state.select(F.col("_k").alias("_known"), "_start", "_n")
        per_key = per_key.join(known, F.col("_k").eqNullSafe(F.col("_known")), "left")
        start, used = F.col("_start"), F.coalesce(F.col("_n"), F.lit(0))

    def step(acc: Column, t: Column) -> Column:
        opens = acc["start"].isNull() | (t >= acc["start"] + F.lit(ttl_us))
        return F.struct(F.when(opens, t).otherwise(acc["start"]).alias("start"),
                        F.when(opens, F.lit(1)).otherwise(F.least(acc["n"] + 1, F.lit(limit))).alias("n"))

    last = F.aggregate("_xs", F.struct(start.alias("start"), used.cast("int").alias("n")), step)
    return per_key.select("_k", last.alias("_f")).select("_k", F.col("_f.start").alias("_start"), F.col("_f.n").alias("_n"))


def dedup_ttl(
    df: DataFrame, key: Column | str, ts: Column | str = "seen_at", event_id: str = "event_id",
    ttl: timedelta = timedelta(seconds=schemas.DEDUP_TTL_SECONDS), **options,
) -> DataFrame:
    """First event per key, then again once the last accepted one is ``ttl`` old."""
    return admit(df, key, ts, event_id, ttl, 1, **options)


def admit_rate_limit(
    df: DataFrame, key: Column | str, ts: Column | str, event_id: str,
    per_window: int = 3, window: timedelta = timedelta(hours=1), **options,
) -> DataFrame:
    """At most ``per_window`` events per key in each window that starts with its first event."""
    return admit(df, key, ts, event_id, window, per_window, **options)


def two_stage_dedup(df: DataFrame, target_stack: Sequence[str], **options) -> DataFrame:
    """Producer de-duplication, stack filter, consumer de-duplication.

    The producer marks a key before the filter, so a posting that the filter drops still
    suppresses its key.
    """
    from postloom.operators.filters import stack_filter

    # read twice: for the keys of the second stage and for its rows
    produced = dedup_ttl(df, producer_key(), store_ids=True, **options)
    wanted = stack_filter(produced, target_stack)
    return dedup_ttl(wanted, consumer_key(), **options)
