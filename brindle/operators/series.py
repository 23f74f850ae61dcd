"""Ordered series: smoothing, ranges, resampling."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from brindle.session import stored


def recurrence(df: DataFrame, key: str, order: list[str], values: list[str], a: float, b: float) -> DataFrame:
    """(key, order..., n, values...): y = a * previous y + b * x for each of values over each key in order, the first y being x; n counts from 1.

    Rows are range-partitioned by key and order, so a key may lie in any number of
    partitions. Each partition runs once over its rows with an unknown y before the first, as
    y = m * that + c; what comes in is then told from the last rows of the partitions, one row each.
    So neither a key's length nor a's closeness to 1 matters. Rows without a value are left out; a null key is a key.
    """
    names = [key, *order]
    sort = [F.col(c).asc_nulls_first() for c in names]
    rows = df.select(*names, *(F.col(v).cast("double").alias(f"_x{i}") for i, v in enumerate(values)))
    for i in range(len(values)):
        rows = rows.where(F.col(f"_x{i}").isNotNull())
    rows = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    made = [("_part", LongType()), ("_at", LongType()), ("_open", BooleanType()), ("n", LongType()), ("_m", DoubleType()), ("_c", ArrayType(DoubleType()))]
    schema = StructType([*rows.schema.fields, *(StructField(*f) for f in made)])

    def run(batches):
        part, at, unset = TaskContext.get().partitionId(), 0, object()
        last, is_open, n, m, c = unset, True, 0, 1.0, [0.0] * len(values)
        for batch in batches:
            xs = list(zip(*(batch.column(len(names) + i).to_pylist() for i in range(len(values))), strict=True))
            out: tuple[list, ...] = ([], [], [], [], [])
            for k, x in zip(batch.column(0).to_pylist(), xs, strict=True):
                if k != last:
                    # the first key of a partition may go on from the one before
                    is_open, n, m = last is unset, 0, 1.0
                    c = [0.0] * len(values) if is_open else list(x)
                    last, new = k, not is_open
                else:
                    new = False
                if not new:
                    c = [a * y + b * v for y, v in zip(c, x, strict=True)]
                    m *= a
                n += 1
                at += 1
                for o, v in zip(out, (at, is_open, n, m if is_open else 0.0, c), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(xs), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.list_(pa.float64()))], names=schema.names)

    done = stored(rows.mapInArrow(run, schema), "series")
    xs = F.array(*(F.col(f"_x{i}") for i in range(len(values))))
    # a row a partition: its first key and values, its last key and what comes out of it
    ends = done.groupBy("_part").agg(F.min_by(F.struct(F.col(key).alias("k"), xs.alias("x")), "_at").alias("head"), F.max_by(F.struct(F.col(key).alias("k"), "_open", "n", "_m", "_c"), "_at").alias("tail"))
    kind = rows.schema[key].dataType.simpleString()
    state = f"struct<k:{kind},some:boolean,y:array<double>,n:bigint,out:array<struct<part:bigint,y:array<double>,n:bigint>>>"
    start = F.expr(f"cast(named_struct('k', null, 'some', false, 'y', array(), 'n', 0L, 'out', array()) as {state})")

    def step(s, e):
        goes_on = s["some"] & s["k"].eqNullSafe(e["head"]["k"])
        y = F.when(goes_on, s["y"]).otherwise(e["head"]["x"])
        n = F.when(goes_on, s["n"]).otherwise(F.lit(0).cast("long"))
        t = e["tail"]
        out = F.when(t["_open"], F.zip_with(t["_c"], y, lambda c, v: c + t["_m"] * v)).otherwise(t["_c"])
        count = F.when(t["_open"], n + t["n"]).otherwise(t["n"])
        return F.struct(t["k"].alias("k"), F.lit(True).alias("some"), out.alias("y"), count.alias("n"), F.concat(s["out"], F.array(F.struct(e["_part"].alias("part"), y.alias("y"), n.alias("n")))).alias("out")).cast(state)

    whole = ends.agg(F.array_sort(F.collect_list(F.struct("_part", "head", "tail"))).alias("es"))
    into = whole.select(F.explode(F.aggregate("es", start, step)["out"]).alias("i")).select(F.col("i.part").alias("_part"), F.col("i.y").alias("_y"), F.col("i.n").alias("_n"))
    both = done.join(F.broadcast(into), "_part")
    value = lambda i: F.when(F.col("_open"), F.col("_c")[i] + F.col("_m") * F.col("_y")[i]).otherwise(F.col("_c")[i])
    count = F.when(F.col("_open"), F.col("n") + F.col("_n")).otherwise(F.col("n"))
    return both.select(*names, count.alias("n"), *(value(i).alias(v) for i, v in enumerate(values)))


def temporal_blend(df: DataFrame, key: str, order: list[str], value: str, a: float = 0.45) -> DataFrame:
    """(key, n, blended): y = a * previous y + (1 - a) * x over each key in order, the first y being x."""
    rest = float(1 - Decimal(str(a)))  # 1 - 0.9 as floats is not 0.1
    return recurrence(df, key, order, [value], a, rest).select(key, "n", F.col(value).alias("blended"))


def range_normalize(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    y = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - lo) / F.greatest(hi - lo, F.lit(1e-6))))
    return 1 - y if invert else y


def resample_linear(df: DataFrame, key: str, at: str, value: str, in_rate: int, out_rate: int) -> DataFrame:
    """(key, i, value): n' = ceil(n * out / in) values at i * in / out, between neighbours, the last one held. Positions run from 0."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    want = sizes.select(key, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") * out_rate / in_rate) - 1, F.lit(0)))).alias("i"))
    want = want.withColumn("x", F.col("i") * in_rate / F.lit(float(out_rate))).withColumn(at, F.floor("x").cast("int"))
    after = F.lead(value).over(W.partitionBy(key).orderBy(at))
    src = df.select(key, F.col(at).cast("int").alias(at), F.col(value).alias("v"), F.coalesce(after, F.col(value)).alias("next"))
    return want.join(src, [key, at]).select(key, "i", (F.col("v") + (F.col("next") - F.col("v")) * (F.col("x") - F.col(at))).alias("value"))


def peak_normalize(df: DataFrame, key: str, value: str, share: float = 0.9, full: int = 32767) -> DataFrame:
    """df with scaled: values so that the key's peak is share * full, cut to integers; as they are if the peak is 0 or full."""
    peaks = df.groupBy(key).agg(F.max(F.abs(value)).alias("_peak"))
    v = F.col(value)
    scaled = F.when((F.col("_peak") == 0) | (F.col("_peak") >= full), v.cast("long")).otherwise((v * (share * full) / F.col("_peak")).cast("long"))
    return df.join(peaks, key).withColumn("scaled", scaled).drop("_peak")


def ema_range(df: DataFrame, key: str, step: str, lo: str, hi: str, b: float = 0.9) -> DataFrame:
    """(key, n, lo_s, hi_s): both ends of a range per step n, smoothed: b of the last one and the rest of the new one."""
    rest = float(1 - Decimal(str(b)))
    smooth = recurrence(df, key, [step], [lo, hi], b, rest)
    return smooth.select(key, F.col(step).alias("n"), F.col(lo).alias("lo_s"), F.col(hi).alias("hi_s"))
