"""Ordered computations that do not put one whole key into one task.

A window over ``(video, brand, track)`` sorts every row of a key in one task, so
one long or busy key bounds the job. The operators here add a *chunk* of the
ordering axis to the partitioning, do the row-level work per ``(key, chunk)``
and carry only per-chunk summaries across chunks. A summary holds a constant
number of rows per chunk, so the part that does run per key stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

CHUNK_SECONDS = 900.0
#: Rows of a slice, rows of a slice that its borders are drawn from, slices of a key.
SLICE_ROWS, SLICE_SAMPLE, MOST_SLICES = 65_536, 64, 1024

#: Chunk maps of a block, and blocks of a block of blocks.
FAN = 256

_CHUNK = "__chunk"
_RUN = "__run"


def _chunk_of(order: str, width: float) -> Column:
    return F.floor(F.col(order) / F.lit(float(width))).cast("bigint")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by the hash of ``by`` to as many tasks as the session shuffles to.

    An exchange by size alone is merged into few partitions: points are a few bytes there
    and many times that in a sort. With a given number a task's share stays a fixed part.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: Column | float,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    chunk: float = CHUNK_SECONDS,
    points: bool = True,
    tolerance: float = 0.0,
) -> DataFrame:
    """Gaps-and-islands: merge rows whose distance to the run so far is <= ``gap``.

    Input has one row per ``(keys, start)``. Output has one row per run with
    ``start``, ``end``, the summed and maximised columns. ``points=False`` allows
    intervals that reach over a chunk border.
    """
    keys = list(keys)
    limit = (F.lit(float(gap)) if not isinstance(gap, Column) else gap) + F.lit(float(tolerance))
    combine = (
        [F.min(start).alias(start), F.max(end).alias(end)]
        + [F.sum(c).alias(c) for c in sums]
        + [F.max(c).alias(c) for c in maxes]
    )
    columns = [*keys, start, end, *sums, *maxes]

    def number_runs(rows: DataFrame, part: list[str]) -> DataFrame:
        ordered = Window.partitionBy(*part).orderBy(start)
        reach = F.max(end).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.when(reach.isNull() | (F.col(start) - reach > limit), 1).otherwise(0)
        return rows.select("*", opens.alias("__open"), F.lead(F.lit(1)).over(ordered).isNull().alias("__last")).withColumn(
            _RUN, F.sum("__open").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        )

    local_keys = keys + [_CHUNK]
    local = number_runs(dealt(df.withColumn(_CHUNK, _chunk_of(start, chunk)), *local_keys), local_keys)
    partial = local.groupBy(*local_keys, _RUN).agg(*combine, F.max("__last").alias("__last"))

    # Only the first and last run of a chunk can continue into another chunk,
    # except that a long interval may also cover runs in the middle of a later one.
    border = (F.col(_RUN) == 1) | F.col("__last")
    if not points:
        over_key = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        reach = (
            partial.groupBy(*local_keys)
            .agg(F.max(end).alias("__chunk_end"))
            .withColumn("__reach", F.max("__chunk_end").over(over_key))
            .drop("__chunk_end")
        )
        partial = partial.join(reach, local_keys)
        border = border | F.coalesce(F.col(start) - F.col("__reach") <= limit, F.lit(False))
    # Runs inside a chunk are final; both branches read the same exchange, and
    # only the border runs go through another one.
    inner = partial.filter(~border).select(*columns)
    stitched = number_runs(dealt(partial.filter(border).select(*columns), *keys), keys).groupBy(*keys, _RUN).agg(*combine)
    return inner.unionByName(stitched.drop(_RUN))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    chunk: Column | float = CHUNK_SECONDS,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running totals ``sums={output: input}`` up to and including each row.

    Without ``ties`` the rows of one ``order`` value share the total that
    includes all of them.
    """
    keys = list(keys)
    part = keys + [_CHUNK]
    rows = dealt(df.withColumn(_CHUNK, chunk if isinstance(chunk, Column) else _chunk_of(order, chunk)), *part)
    ordered = Window.partitionBy(*part).orderBy(order, *ties)
    inside = (
        ordered.rowsBetween(Window.unboundedPreceding, 0)
        if ties
        else ordered.rangeBetween(Window.unboundedPreceding, 0)
    )
    local = rows.select("*", *[F.sum(src).over(inside).alias(f"__in_{out}") for out, src in sums.items()])
    totals = rows.groupBy(*part).agg(*[F.sum(src).alias(f"__tot_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, *[F.sum(f"__tot_{out}").over(before).alias(f"__pre_{out}") for out in sums])
    joined = local.join(carry, part)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"__in_{out}") + F.coalesce(F.col(f"__pre_{out}"), F.lit(0))).alias(out)
            for out in sums
        ],
    )


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    chunk: float = CHUNK_SECONDS,
) -> DataFrame:
    """Replace nulls by the latest earlier non-null value of the same key."""
    keys = list(keys)
    part = keys + [_CHUNK]
    rows = df.withColumn(_CHUNK, _chunk_of(order[0], chunk))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(
        *[c for c in rows.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns],
    )
    ordering = F.struct(*order)
    last_seen = rows.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), ordering)).alias(f"__last_{c}") for c in columns]
    )
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_seen.select(
        *part,
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__pre_{c}") for c in columns],
    )
    return local.join(carry, part).select(
        *[
            F.coalesce(F.col(c), F.col(f"__pre_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str], chunk: float = CHUNK_SECONDS
) -> DataFrame:
    """``lag`` by one row, ``columns={output: input}``, over rows unique per ``(keys, order)``."""
    keys = list(keys)
    part = keys + [_CHUNK]
    rows = df.withColumn(_CHUNK, _chunk_of(order, chunk))
    inside = Window.partitionBy(*part).orderBy(order)
    payload = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    local = rows.withColumn("__here", F.lag(payload).over(inside))
    last = rows.groupBy(*part).agg(F.max_by(payload, F.col(order)).alias("__last"))
    carry = last.select(*part, F.lag("__last").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("__before"))
    value = F.coalesce(F.col("__here"), F.col("__before"))
    return local.join(carry, part).select(*df.columns, *[value[out].alias(out) for out in columns])


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows with a number ``slice`` that grows with ``order``: about ``slice_rows`` rows of a key share one.

    Borders are quantiles of a sample of the rows, drawn by the hash of ``order``: about
    ``SLICE_SAMPLE`` rows a slice, so that a slice stays near the mean whatever the
    values are. The hash makes the borders a function of the data, the same in every
    branch of a plan and in every retry. Keys with fewer rows have slice 0 and no
    borders; a key has ``MOST_SLICES`` slices at most, which bounds its borders and its
    sample. Rows that agree in all of ``order`` share a slice.
    """
    keys = list(keys)
    here = F.struct(*order) if len(order) > 1 else F.col(order[0])
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__slices", F.least(F.lit(MOST_SLICES), F.ceil(F.col("__n") / slice_rows)).cast("int")
    ).filter("__slices > 1")
    # without keys both sides below come from aggregates of one row
    meet = (lambda a, b, how: a.join(b, keys, how)) if keys else (lambda a, b, how: a.crossJoin(b))
    drawn = F.pmod(F.xxhash64(*order), F.col("__n")) < F.col("__slices") * SLICE_SAMPLE
    sample = meet(df.select(*keys, *order), sizes, "inner").filter(drawn).groupBy(*keys).agg(
        F.array_sort(F.collect_list(here)).alias("__s"), F.max("__slices").alias("__k")
    )
    at = lambda i: F.get("__s", (i * F.size("__s") / F.col("__k")).cast("int"))
    borders = sample.select(*keys, F.when(F.col("__k") > 1, F.transform(F.sequence(F.lit(1), F.col("__k") - 1), at)).alias("__borders"))
    borders = borders.select("*", F.filter("__borders", lambda x, i: i % 32 == 31).alias("__coarse"))
    below = lambda marks: F.size(F.filter(marks, lambda b: b <= here))
    rows = meet(df, borders, "left").withColumn("__block", F.when(F.col("__borders").isNotNull(), below(F.col("__coarse")) * 32))
    found = F.col("__block") + below(F.slice("__borders", F.col("__block") + 1, F.lit(32)))
    return rows.select(*df.columns, F.coalesce(found, F.lit(0)).cast("bigint").alias("slice"))


def ranked(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], output: str, chunk: Column | None = None) -> DataFrame:
    """``row_number`` over ``(keys)`` ascending by ``order`` and ``ties``.

    ``chunk``, if given, must grow with ``order``; else the rows are sliced by quantiles
    of order and ties together, so that neither many rows nor many equal values of a key
    meet in one task. Without keys all rows are numbered.
    """
    keys, columns = list(keys), df.columns
    rows = df.withColumn(_CHUNK, chunk) if chunk is not None else sliced(df, keys, [order, *ties]).withColumnRenamed("slice", _CHUNK)
    part = keys + [_CHUNK]
    local = rows.withColumn(output, F.row_number().over(Window.partitionBy(*part).orderBy(order, *ties)))
    # one row per chunk meets here, MOST_SLICES a key at most when sliced
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__pre"))
    )
    return local.join(carry, part).select(*columns, (F.col(output) + F.col("__pre")).cast("bigint").alias(output))


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Distinct values per key with counts, the key's ``total``, and a slice number that grows with the value."""
    keys = list(keys)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*aggs)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, keys) if keys else counts.crossJoin(totals)
    return sliced(joined, keys, [value], slice_rows)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles from distributed counts.

    The exact aggregate of the engine keeps one hash map of distinct values per
    group; here the distinct values stay rows and only the needed ranks are read.
    """
    keys = list(keys)
    counts = value_counts(df, keys, value)
    part_keys = keys or ["__all"]
    if not keys:
        counts = counts.withColumn("__all", F.lit(0))
    cum = prefix_sums(counts, part_keys, value, {"cum": "n"}, chunk=F.col("slice"))
    aggs = []
    for name, p in points.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}"),
        ]
    picked = cum.groupBy(*part_keys).agg(F.max("total").alias("total"), *aggs)
    out = []
    for name, p in points.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * frac).alias(name))
    return picked.select(*keys, *out)


def chain_starts(
    maps: DataFrame,
    keys: Sequence[str],
    chunk: str,
    start: Column,
    compose: Callable[[Column, Column], Column],
    apply: Callable[[Column, Column], Column],
) -> DataFrame:
    """State in which each chunk of a key begins, from what every chunk does to a state.

    ``maps`` has one row per key and chunk number and its map ``m``; ``compose(a, b)`` is
    the map of ``a`` followed by ``b``, ``apply(m, state)`` a state through a map. Maps are
    composed to blocks of ``FAN`` chunks and to blocks of ``FAN`` blocks, which alone are
    chained per key; the states then go back down block by block. Arrays hold ``FAN`` maps at
    most, or one map per ``FAN * FAN`` chunks of a key.
    """
    keys = list(keys)

    def blocks(df: DataFrame, by: list[str], lower: str) -> DataFrame:
        part = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(lower).alias("no"), "m"))).alias("part"))
        rest = F.slice("part", F.lit(2), F.size("part"))
        return part.withColumn("m", F.aggregate(rest, F.get("part", F.lit(0))["m"], lambda acc, x: compose(acc, x["m"])))

    def spread(df: DataFrame, by: list[str], lower: str) -> DataFrame:
        begin = F.struct(F.col("start").alias("state"), F.array().cast(ArrayType(df.schema["start"].dataType)).alias("starts"))
        walked = F.aggregate(
            "part", begin, lambda acc, x: F.struct(apply(x["m"], acc["state"]).alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))
        )
        pairs = F.arrays_zip(F.col("part.no").alias("no"), walked["starts"].alias("start"))
        return df.select(*by, F.explode(pairs).alias("z")).select(*by, F.col("z.no").alias(lower), F.col("z.start").alias("start"))

    no = lambda name, lower: F.floor(F.col(lower) / FAN).cast("bigint").alias(name)
    ones = blocks(maps.select(*keys, no("__one", chunk), chunk, "m"), [*keys, "__one"], chunk)
    twos = blocks(ones.select(*keys, no("__two", "__one"), "__one", "m"), [*keys, "__two"], "__one")
    top = blocks(twos, keys, "__two").withColumn("start", start)
    down = spread(top, keys, "__two").join(twos.drop("m"), [*keys, "__two"])
    down = spread(down, keys, "__one").join(ones.drop("m"), [*keys, "__one"])
    return spread(down, keys, chunk)
