"""Audio scoring as column expressions over measured descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Key profiles of the major and minor modes, from the tonic up.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def fold_bpm(bpm: Column) -> Column:
    """A tempo halved or doubled into 60..180."""
    up, down = F.ceil(F.log2(60 / bpm)), F.ceil(F.log2(bpm / 180))
    return F.when(bpm <= 0, None).when(bpm < 60, bpm * F.pow(F.lit(2.0), up)).when(bpm > 180, bpm / F.pow(F.lit(2.0), down)).otherwise(bpm)


def clip(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def camelot(pitch: Column, minor: Column) -> Column:
    """Camelot code of a pitch class and mode."""
    at = lambda tonic: (((pitch - tonic) * 7 + 7) % 12 + 12) % 12 + 1
    return F.when(minor, F.concat(((at(F.lit(9)) + 0).cast("int")).cast("string"), F.lit("A"))).otherwise(F.concat(at(F.lit(0)).cast("int").cast("string"), F.lit("B")))


def key_of(chroma: str) -> Column:
    """(pitch, minor, r): the rotated profile that correlates best with a chroma vector of 12."""

    def r(profile: list[float], k: int) -> Column:
        p = [profile[(i - k) % 12] for i in range(12)]
        m = sum(p) / 12
        d = [x - m for x in p]
        sd = sum(x * x for x in d) ** 0.5
        mean = sum((F.col(chroma)[i] for i in range(12)), F.lit(0.0)) / 12
        dot = sum(((F.col(chroma)[i] - mean) * d[i] for i in range(12)), F.lit(0.0))
        norm = F.sqrt(sum(((F.col(chroma)[i] - mean) * (F.col(chroma)[i] - mean) for i in range(12)), F.lit(0.0))) * sd
        return F.coalesce(dot / F.nullif(norm, F.lit(0.0)), F.lit(0.0))

    all_ = [F.struct(r(p, k).alias("r"), F.lit(-k).alias("order"), F.lit(k).alias("pitch"), F.lit(minor).alias("minor")) for p, minor in ((MAJOR, False), (MINOR, True)) for k in range(12)]
    return F.array_max(F.array(*all_))


def z_score(c: str, *by: str) -> Column:
    """Distance from the mean in population deviations; 0 without variance."""
    w = Window.partitionBy(*by)
    return F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0))


def scaled(df: DataFrame, c: str, out: str, mode: str = "z") -> DataFrame:
    """``df`` with ``c`` as z-score (0 without variance) or min-max share (0.5 without range), from one aggregated row."""
    s = df.agg(F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"), F.min(c).alias("__a"), F.max(c).alias("__b"))
    z = F.coalesce((F.col(c) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), F.lit(0.0))
    share = F.coalesce((F.col(c) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)), F.lit(0.5))
    return df.crossJoin(F.broadcast(s)).withColumn(out, F.when(F.col(c).isNotNull(), z if mode == "z" else share)).drop("__m", "__s", "__a", "__b")  # one row


def merge_by_confidence(rows: DataFrame, key: str, feature: str = "feature", value: str = "value", confidence: str = "confidence") -> DataFrame:
    """Of several measurements of a feature the most confident one; ties keep the least value."""
    return rows.groupBy(key, feature).agg(F.max_by(value, F.struct(confidence, -F.col(value))).alias(value), F.max(confidence).alias(confidence))
