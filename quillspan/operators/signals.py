"""Signals: optical density, haemoglobin, vectors, spectra."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.clean import COEFFICIENTS, pathlength_factor


def optical_density(samples: DataFrame, keys: Sequence[str], order: str, value: str, first: int) -> DataFrame:
    """density = -ln(max(I, 1e-9) / baseline), the baseline being the mean of the first samples, or the median where that is not positive."""
    v = F.greatest(F.col(value), F.lit(1e-9))
    t = samples.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    base = t.groupBy(*keys).agg(F.avg(F.when(F.col("_k") <= first, v)).alias("_b"), F.median(v).alias("_m"))
    return t.join(base, list(keys)).withColumn("density", -F.log(v / F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.col("_m")))).drop("_k", "_b", "_m")


def beer_lambert(densities: DataFrame, keys: Sequence[str], wavelengths: tuple[int, int], distance_mm: Column, age: Column) -> DataFrame:
    """hbo and hbr in micromol/l from the densities at two wavelengths (column wavelength).

    Each density is divided by its own path, the distance in cm times the path length factor of the wavelength and age,
    and the inverse of the coefficient matrix is applied.
    """
    w1, w2 = wavelengths
    (a, b), (c, e) = COEFFICIENTS[w1], COEFFICIENTS[w2]

    def normalised(w: int) -> Column:
        path = F.greatest(distance_mm / 10 * pathlength_factor(F.lit(float(w)), age), F.lit(1e-9))
        return F.max(F.when(F.col("wavelength") == w, F.col("density") / path))

    wide = densities.groupBy(*keys).agg(normalised(w1).alias("_1"), normalised(w2).alias("_2"))
    det = a * e - b * c
    return wide.withColumns({"hbo": (F.col("_1") * e - F.col("_2") * b) / det * 1e6, "hbr": (F.col("_2") * a - F.col("_1") * c) / det * 1e6}).drop("_1", "_2")


def explode_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, pos, value of each element of an array column."""
    return df.select(key, F.posexplode(vector).alias("pos", "value"))


def collect_vectors(long: DataFrame, key: str) -> DataFrame:
    """The arrays again, in order of pos."""
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vector"))


#: Frequency bands in Hz.
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0)}

#: Segments that go through the transform at a time.
SEGMENTS = 4096


def _density_batches(keys: Sequence[str], rate: float, length: int):
    """Welch's density of each series, from rows sorted by keys and order: segments of one length go through the transform together, whichever series they are of."""
    import numpy as np
    import pyarrow as pa

    def spectra(x: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        parts = x[starts[:, None] + np.arange(n)]
        return np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * np.hanning(n + 1)[:n], axis=1)) ** 2

    def out(head: pa.RecordBatch, total: np.ndarray, count: np.ndarray, n: int) -> pa.RecordBatch:
        power = total / count[:, None] / (rate * (np.hanning(n + 1)[:n] ** 2).sum())
        power[:, 1 : (n + 1) // 2] *= 2
        width = power.shape[1]
        own = head.take(pa.array(np.repeat(np.arange(len(power)), width)))
        return pa.RecordBatch.from_arrays([*own.columns, pa.array(np.tile(np.fft.rfftfreq(n, 1 / rate), len(power))), pa.array(power.ravel())], [*keys, "frequency", "power"])

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, width = max(1, length // 2), length // 2 + 1
        # of the series that is still open: its rows behind its last segment, and the sum and number of its segments
        rest: pa.RecordBatch | None = None
        held, so_far = np.zeros(width), 0
        for batch in _and_end(batches):
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            codes = [rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
            first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in codes], axis=0)))
            sizes = np.diff(np.append(first, rows.num_rows))
            x = rows.column("value").combine_chunks().to_numpy(zero_copy_only=False).astype(float)
            head = rows.select(keys).take(pa.array(first)).combine_chunks().to_batches()[0]
            segments = np.where(sizes >= length, (sizes - length) // step + 1, 0)
            total = np.zeros((len(first), width))
            of = np.repeat(np.arange(len(first)), segments)
            starts = first[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(segments) - segments, segments))
            for at in range(0, len(of), SEGMENTS):
                np.add.at(total, of[at : at + SEGMENTS], spectra(x, starts[at : at + SEGMENTS], length))
            total[0] += held
            count = segments.copy()
            count[0] += so_far
            last = len(first) - 1
            done = np.ones(len(first), bool)
            held, so_far, rest = np.zeros(width), 0, None
            if batch is not None:
                done[last] = False
                held, so_far = total[last].copy(), int(count[last])
                rest = rows.slice(int(first[last] + step * segments[last])).to_batches()[0]
            full = np.flatnonzero(done & (count > 0))
            if len(full):
                yield out(head.take(pa.array(full)), total[full], count[full], length)
            for n in np.unique(sizes[done & (count == 0)]).tolist():
                short = np.flatnonzero(done & (count == 0) & (sizes == n))
                yield out(head.take(pa.array(short)), spectra(x, first[short], n), np.ones(len(short)), n)

    return densities


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def welch(df: DataFrame, keys: Sequence[str], order: str, value: str, rate: float, length: int) -> DataFrame:
    """keys, frequency, power: Welch's density from half-overlapping Hann segments with the mean taken out.

    One group is one channel of one recording.  Its rows pass through a task in their order; of a long series the task holds no more than a batch.
    """
    keys = list(keys)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*keys, F.col(order).alias("_order"), F.col(value).cast("double").alias("value"))
    met = rows.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last("_order")).select(*keys, "value")
    return met.mapInArrow(_density_batches(keys, rate, length), f"{schema}, frequency double, power double")


def band_powers(density: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per band: log power and share of the total; spectral entropy, and the frequency of the alpha peak."""
    total = F.sum("power")
    bands = {n: F.sum(F.when((F.col("frequency") >= a) & (F.col("frequency") < b), F.col("power")).otherwise(0.0)) for n, (a, b) in BANDS.items()}
    with_total = density.join(density.groupBy(*keys).agg(F.greatest(total, F.lit(1e-300)).alias("_t")), list(keys))
    share = F.col("power") / F.col("_t")
    a, b = BANDS["alpha"]
    alpha = F.col("frequency").between(a, b)
    return with_total.groupBy(*keys).agg(
        *[F.log(F.greatest(p, F.lit(1e-30))).alias(f"log_{n}") for n, p in bands.items()], *[(p / total).alias(f"relative_{n}") for n, p in bands.items()],
        (-F.sum(F.when(share > 0, share * F.log(share)).otherwise(0.0))).alias("entropy"), F.min_by(F.when(alpha, F.col("frequency")), F.when(alpha, F.struct(-F.col("power"), F.col("frequency")))).alias("alpha_peak"),
    )
