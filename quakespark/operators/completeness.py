"""Magnitude of completeness by simulated Kolmogorov-Smirnov tests, by class or time window, and its stamp on all events."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, DRAWS, PASS = 7, 5000, 0.1
RESULT = "key string, bin long, n long, distance double, p double"


def magnitude_bins(events: DataFrame, key: Column, width: float = 0.1) -> DataFrame:
    """(key, bin, n): events by key (a string) and the nearest multiple of ``width``, halves to even; unknown magnitudes and keys are left out."""
    held = events.select(key.cast("string").alias("key"), F.bround(F.col("mag") / width, 0).cast("long").alias("bin")).where("key is not null and bin is not null")
    return held.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("n"))


def candidates(bins: DataFrame) -> DataFrame:
    """(key, bin, counts): for each bin of a key the counts of all bins from it on, empty ones included.

    A key has as many rows as it has bins, which magnitudes bound, so a key's bins fit in one array.
    """
    held = bins.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("of"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    at = held.select("key", "of", "high", F.explode(F.sequence("low", "high")).alias("bin"))
    return at.select("key", "bin", F.transform(F.sequence("bin", "high"), lambda k: F.coalesce(F.try_element_at("of", k), F.lit(0).cast("long"))).alias("counts"))


def survivals(size: int, b: float, width: float) -> np.ndarray:
    """P(magnitude at or beyond the end of bin k) for bins of a Gutenberg-Richter law, from the candidate on."""
    return 10.0 ** (-b * width * np.arange(1, size + 1))


def simulated_p(key: str, first: int, counts: np.ndarray, b: float, width: float, draws: int, seed: int) -> tuple[float, float]:
    """The largest distance of the counts' distribution from the law's, and the share of samples of the law of the same size that are as far off.

    A sample is drawn as counts of the bins and of all beyond them, so its cost doesn't grow with its size.
    """
    tail = survivals(len(counts), b, width)
    n = int(counts.sum())
    distance = np.abs(np.cumsum(counts) / n - (1 - tail)).max()
    parts = np.append(-np.diff(np.r_[1.0, tail]), tail[-1])
    rng = np.random.default_rng([seed, zlib.crc32(key.encode()), first & 0xFFFFFFFF])
    worst = np.empty(draws)
    for at in range(0, draws, 1000):
        sample = rng.multinomial(n, parts, size=min(1000, draws - at))[:, :-1]
        worst[at : at + 1000] = np.abs(np.cumsum(sample, 1) / n - (1 - tail)).max(1)
    return float(distance), float((worst >= distance - 1e-12).mean())


def ks_table(bins: DataFrame, b: float = 1.0, width: float = 0.1, least: int = 50, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(key, bin, n, distance, p) of every candidate with ``least`` events or more. Candidates are rows that any task can test; draws
    depend on seed, key and bin only, so tasks that run anew give the same table."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, first, counts in zip(*(batch.column(c).to_pylist() for c in ("key", "bin", "counts")), strict=True):
                values = np.array(counts, np.int64)
                rows.append((key, first, int(values.sum()), *simulated_p(key, first, values, b, width, draws, seed)))
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "bin", "n", "distance", "p"])

    large = candidates(bins).where(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y) >= max(least, 1))
    return large.repartition("key", "bin").mapInArrow(tested, RESULT)


def mc_by_ks(bins: DataFrame, width: float = 0.1, passing: float = PASS, **options) -> DataFrame:
    """(key, n_events, mc, p): the least candidate that passes; null where none does."""
    c = F.col
    passed = ks_table(bins, width=width, **options).where(c("p") >= passing).groupBy("key").agg(F.min_by(F.struct("bin", "p"), "bin").alias("best"))
    totals = bins.groupBy("key").agg(F.sum("n").alias("n_events"))
    return totals.join(passed, "key", "left").select("key", "n_events", F.round(c("best.bin") * width, 6).alias("mc"), c("best.p").alias("p"))


def mc_windows(events: DataFrame, windows: list[tuple[float, float]], classes: list[str], **options) -> DataFrame:
    """(window, start, end, n_events, mc, raw_mc, years): completeness by time windows [start, end) in years, from events of the given classes.

    Mc never rises with time: a window's is at most that of any earlier one. Events may lie in two windows that overlap.
    """
    spark = events.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(windows)], "window int, start double, end double")
    holds = F.filter(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(windows))), lambda w: (F.col("yr") >= w["a"]) & (F.col("yr") < w["b"]))
    dealt = events.where(F.col("cls").isin(classes)).select("mag", F.explode(holds).alias("w")).select("mag", F.col("w.i").alias("window"))
    found = mc_by_ks(magnitude_bins(dealt, F.col("window"), options.get("width", 0.1)), **options).withColumn("window", F.col("key").cast("int")).drop("key")
    lowest = F.min("mc").over(Window.partitionBy(F.lit(0)).orderBy("window").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each window
    held = table.join(found, "window", "left").withColumn("raw_mc", F.col("mc"))
    return held.select(
        "window", "start", "end", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), F.when(F.col("raw_mc").isNotNull(), lowest).alias("mc"), "raw_mc", (F.col("end") - F.col("start")).alias("years")
    )


def stamped(events: DataFrame, table: DataFrame, windows: list[tuple[float, float]]) -> DataFrame:
    """All events with window (the last that holds them, or -1), mc and years of it; ``table`` is that of mc_windows, a row for each window."""
    from quakespark.operators.catalog import last_window

    held = events.withColumn("window", last_window(F.col("yr"), windows))
    return held.join(F.broadcast(table.select("window", "mc", "years")), "window", "left")
