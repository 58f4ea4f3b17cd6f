"""Exact global ranks, tiles and running counts without a one-task sort.

A bare ``ntile`` or ``row_number`` over the whole table moves every row to one
task. Here the order is cut into buckets at literal quantile edges. Rows are
ranked inside a bucket, and the number of rows in earlier buckets (one small row
per bucket) is added. Literal edges make the bucket of a row a function of the
row alone, so a lost executor recomputes the same answer.

Two things keep buckets small when one score holds a large part of all rows:
running counts are taken over (score, count) pairs after a map-side combine, so a
tied score is a single row; and where single rows must be told apart, a tied score
is cut further at quantiles of the unique tie-break.

The (score, count) pairs are written to the shared folder: sketch, bucket totals and
running counts then read that narrow table, and the input is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from riskweave.session import materialise

# A frame known to have at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 200_000
# Sampled rows per bucket when bucket edges are sketched.
SKETCH_ROWS_PER_BUCKET = 500

TileOf = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Layout:
    """Bucket edges of a score and of its tie-break, and the number of groups."""

    edges: tuple[float, ...]
    repeats: tuple[int, ...]  # how many quantiles fell on the edge: its weight
    tie_edges: tuple[float, ...]
    groups: int
    # For scores that doubles cannot tell apart: the one frequent score of each edge, if any.
    exact: tuple | None = None

    @property
    def max_cells(self) -> int:
        return 3 * (len(self.edges) + 1) + sum(self.repeats)


def tie_key(df: DataFrame, tie: str) -> Column:
    """A tie-break that can be bucketed: a number as it is, a text behind its hash.

    Texts with a common prefix would crowd into one bucket; hashes spread, and the text
    itself still parts two equal hashes.
    """
    if isinstance(df.schema[tie].dataType, T.StringType):
        return F.struct(F.xxhash64(tie).alias("h"), F.col(tie).alias("id"))
    return F.col(tie)


def _number(df: DataFrame, column: str) -> Column:
    """The number by which a column is bucketed."""
    kind = df.schema[column].dataType
    return F.col(f"{column}.h" if isinstance(kind, T.StructType) else column).cast("double")


def _outgrows_doubles(kind: T.DataType) -> bool:
    """Whether two different values of the type can be one double."""
    return isinstance(kind, (T.LongType, T.DecimalType))


def _frequent_scores(df: DataFrame, score: str, edges: Sequence[float], buckets: int, rows: int) -> tuple:
    """The most frequent score behind each edge, in the score's own type; None where there is no frequent one.

    Like the sketch, it places rows and enters no result.
    """
    wanted = SKETCH_ROWS_PER_BUCKET * buckets
    source = df.select(F.col(score).alias("s"))
    if rows > wanted:
        source = source.sample(wanted / rows, seed=7)
    # A score that fills an edge holds a bucket's share of the sample; at most 2 * buckets scores do.
    counted = source.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, min(rows, wanted) // (2 * buckets)))
    best: dict[float, tuple] = {}
    for r in counted.collect():
        at = float(r.s)
        if at not in best or (r.n, r.s) > best[at]:
            best[at] = (r.n, r.s)
    return tuple(best[e][1] if e in best else None for e in edges)


def default_buckets(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, and never a mere handful."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _distinct_edges(quantiles: Sequence[float] | None) -> tuple[tuple[float, ...], tuple[int, ...]]:
    seen: dict[float, int] = {}
    for q in quantiles or ():
        seen[float(q)] = seen.get(float(q), 0) + 1
    edges = tuple(sorted(seen))
    return edges, tuple(seen[e] for e in edges)


def sketch_quantiles(df: DataFrame, columns: Sequence[str], buckets: int, rows: int) -> dict[str, list[float] | None]:
    """Approximate quantiles that cut each column into ``buckets``.

    They only place rows into buckets and never enter a result, so a sample of some
    hundred rows per bucket will do; sketches of all tasks then meet in one task
    without outgrowing it.
    """
    wanted = SKETCH_ROWS_PER_BUCKET * buckets
    source = df.select(*[_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    if rows > wanted:
        source = source.sample(wanted / rows, seed=7)
    probabilities = [i / buckets for i in range(1, buckets)]
    accuracy = max(1000, 20 * buckets)
    found = source.agg(
        *[F.percentile_approx(c, probabilities, accuracy) for c in source.columns]
    ).first()
    return {c: found[i] for i, c in enumerate(columns)}


def plan_layout(
    df: DataFrame,
    score: str,
    tie: str | None = None,
    by: Sequence[str] = (),
    buckets: int | None = None,
    rows: int | None = None,
) -> Layout:
    """Two small jobs: rows and groups, then quantile sketches of score and tie-break."""
    buckets = buckets or default_buckets(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    if by:
        aggs.append(F.approx_count_distinct(F.struct(*by)).alias("g"))
    found = df.agg(*aggs).first() if by or rows is None else {"n": rows}
    quantiles = sketch_quantiles(df, [score] if tie is None else [score, tie], buckets, found["n"])
    edges, repeats = _distinct_edges(quantiles[score])
    tie_edges, _ = _distinct_edges(quantiles[tie]) if tie is not None else ((), ())
    exact = None
    if tie is not None and _outgrows_doubles(df.schema[score].dataType):
        exact = _frequent_scores(df, score, edges, buckets, found["n"])
    # The sketch is off by a few per cent; double it before it bounds a broadcast.
    return Layout(edges, repeats, tie_edges, 2 * found["g"] + 8 if by else 1, exact)


def bucketed(df: DataFrame, column: str, edges: Sequence[float], out: str) -> DataFrame:
    """Add the number of edges at or below the value; a null or NaN value is an error.

    An error, because a row without a place in the order would otherwise vanish.
    """
    if not edges:
        return df.withColumn(out, F.lit(0))
    raw, wide = f"{out}_raw", f"{out}_in"
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=wide, outputCol=raw, handleInvalid="error")
    placed = F.when(F.col(raw).isNull(), F.raise_error(F.lit(f"null in {column}"))).otherwise(F.col(raw))
    binned = cut.transform(df.withColumn(wide, _number(df, column)))
    return binned.select(*df.columns, placed.cast("int").alias(out))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the row bound allows it; otherwise leave it to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _key(by: Sequence[str]) -> Column:
    """Group key as one struct, so that a null group value still equals itself."""
    return F.struct(*by) if by else F.lit(0)


def open_key(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Replace the key struct by the group columns."""
    rest = [c for c in df.columns if c != "__g"]
    return df.select(*[F.col(f"__g.{c}").alias(c) for c in by], *rest)


def with_offsets(counts: DataFrame, order: Column, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Totals per group and sums over earlier buckets, from one small row per bucket."""
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    added = {f"{v}_before": F.coalesce(F.sum(v).over(earlier), F.lit(0).cast("bigint")) for v in values}
    added |= {f"{v}_total": F.sum(v).over(group) for v in values}
    return counts.withColumns(added).drop(*values)


def score_runs(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct (group, score), as a written table.

    The score keeps its type: a long id must not lose digits. A score that has no place
    in the order (null or NaN) is an error.
    """
    c = F.col(score)
    unplaced = c.isNull()
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        unplaced = unplaced | F.isnan(c)
    placed = F.when(unplaced, F.raise_error(F.lit(f"null in {score}"))).otherwise(c)
    runs = df.groupBy(_key(by).alias("__g"), placed.alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return materialise(runs, "runs")


def score_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Running counts over descending distinct scores, per group.

    Columns: the group columns, ``score, n, pos`` (rows and positives at this score),
    ``cum_n, cum_pos`` (at or above it), ``n_total, pos_total``.
    """
    return open_key(keyed_curve(df, score, label, by).rows, by)


@dataclass(frozen=True)
class KeyedCurve:
    """A curve under its group key, with bounds on its groups and its rows."""

    rows: DataFrame
    groups: int
    most_rows: int

    def straddlers(self, tiles: int) -> int:
        """How many scores can straddle a tile boundary, at most."""
        return min(self.groups * max(tiles - 1, 1), self.most_rows)


def keyed_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> KeyedCurve:
    runs = score_runs(df, score, label, by)
    rows = runs.count()  # from the footers of the table just written
    layout = plan_layout(runs, "score", by=["__g"] if by else [], rows=rows)
    return KeyedCurve(_bucketed_curve(runs, layout), layout.groups, rows)


def _bucketed_curve(runs: DataFrame, layout: Layout) -> DataFrame:
    runs = bucketed(runs, "score", layout.edges, "__b")
    per_bucket = runs.groupBy("__g", "__b").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    offsets = with_offsets(per_bucket, F.desc("__b"), ["__g"], ["n", "pos"])
    inside = Window.partitionBy("__g", "__b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = runs.withColumns({"cum_n": F.sum("n").over(inside), "cum_pos": F.sum("pos").over(inside)})
    joined = ranked.join(small(offsets, layout.groups * (len(layout.edges) + 1)), ["__g", "__b"])
    return joined.select(
        "__g",
        "score",
        "n",
        "pos",
        (F.col("cum_n") + F.col("n_before")).alias("cum_n"),
        (F.col("cum_pos") + F.col("pos_before")).alias("cum_pos"),
        "n_total",
        "pos_total",
    )


def global_row_number(
    df: DataFrame,
    score: str,
    tie: str,
    by: Sequence[str] = (),
    descending: bool = True,
    out: str = "rn",
    total: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """``row_number`` over (score, then the unique tie-break ascending), per group.

    A text tie-break is ordered by its hash first. ``total`` also adds the group's row count under that name.
    """
    columns = df.columns
    rows = df.withColumns({"__g": _key(by), "__tie": tie_key(df, tie)})
    if layout is None:
        # Sketch, cell totals and the rows themselves read this table, and the source is read once.
        rows = materialise(rows, "ranked")
        layout = plan_layout(rows, score, "__tie", by)
    rows = bucketed(bucketed(rows, score, layout.edges, "__b"), "__tie", layout.tie_edges, "__t")
    rows = rows.withColumn("__cell", _cell(score, layout, descending, rows.schema[score].dataType))
    per_cell = rows.groupBy("__g", "__cell").agg(F.count(F.lit(1)).alias("n"))
    offsets = with_offsets(per_cell, F.col("__cell"), ["__g"], ["n"])
    first = F.desc(score) if descending else F.asc(score)
    inside = Window.partitionBy("__g", "__cell").orderBy(first, F.asc("__tie"))
    numbered = rows.withColumn("__rn", F.row_number().over(inside)).join(
        small(offsets, layout.groups * layout.max_cells), ["__g", "__cell"]
    )
    added = [(F.col("__rn") + F.col("n_before")).alias(out)]
    if total:
        added.append(F.col("n_total").alias(total))
    return numbered.select(*columns, *added)


def _cell(score: str, layout: Layout, descending: bool, kind: T.DataType | None = None) -> Column:
    """Sort position of a row's cell.

    A score bucket splits into the scores up to its edge value, the edge value itself and the open stretch
    above it. An edge that r quantiles fell on holds about r buckets of rows, and is cut into
    r pieces by the tie-break. Only rows of truly equal scores are cut so: where scores
    outgrow doubles, the edge value is one score in the scores' own type.
    """
    if not layout.edges:
        return F.lit(0).cast("bigint")
    position = F.col("__b") + 1
    value, number = F.col(score), F.col(score).cast("double")
    edge = F.element_at(F.array(*[F.lit(e) for e in (float("-inf"), *layout.edges)]), position)
    if layout.exact is None:
        on_edge, under = number == edge, F.lit(False)
    else:
        known = F.element_at(F.array(*[F.lit(e).cast(kind) for e in (None, *layout.exact)]), position)
        on_edge = F.coalesce(value == known, F.lit(False))
        under = (number == edge) & F.coalesce(value < known, F.lit(False))
    pieces = F.element_at(F.array(*[F.lit(r) for r in (1, *layout.repeats)]), position)
    ties = len(layout.tie_edges) + 1
    piece = F.when(on_edge & (pieces > 1), F.floor(F.col("__t") * pieces / ties)).otherwise(0)
    third = 3 * F.col("__b") + F.when(under, 0).when(on_edge, 1).otherwise(2)
    if descending:
        third = F.lit(3 * len(layout.edges) + 2) - third
    return third.cast("bigint") * (max(layout.repeats) + 1) + piece


def ntile_of(tiles: int) -> TileOf:
    """Tile of a 1-based rank among n rows: sizes differ by at most one, larger first."""

    def tile(rank: Column, n: Column) -> Column:
        size = F.floor(n / tiles)
        larger = n % tiles
        in_larger = larger * (size + 1)
        up = lambda a, b: F.floor((a + b - 1) / b)
        return (
            F.when(rank <= in_larger, up(rank, size + 1))
            .otherwise(larger + up(rank - in_larger, F.greatest(size, F.lit(1))))
            .cast("int")
        )

    return tile


def top_share_of(share_denominator: int = 10) -> TileOf:
    """1 for the top max(1, n // denominator) ranks, 2 for the rest."""

    def tile(rank: Column, n: Column) -> Column:
        return F.when(rank <= top_count(n, share_denominator), 1).otherwise(2)

    return tile


def top_count(n: Column, share_denominator: int = 10) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n / share_denominator))


def global_ntile(
    df: DataFrame, tiles: int, score: str, tie: str, by: Sequence[str] = (), descending: bool = True, out: str = "tile"
) -> DataFrame:
    """``ntile`` over the same order as :func:`global_row_number`."""
    numbered = global_row_number(df, score, tie, by, descending, "__rank", "__rows")
    return numbered.withColumn(out, ntile_of(tiles)(F.col("__rank"), F.col("__rows"))).drop("__rank", "__rows")


def tile_totals(
    df: DataFrame,
    score: str,
    label: str,
    tie: str,
    tile_of: TileOf,
    tiles: int,
    by: Sequence[str] = (),
    descending: bool = True,
    curve: KeyedCurve | None = None,
) -> DataFrame:
    """Rows, positives and score sum per tile of the global order.

    Whole runs of one score are counted from the curve. Only scores that straddle a
    tile boundary (fewer than ``tiles`` per group) go back to single rows. Several reports on
    one written table can share its ``curve``.
    """
    if curve is None:
        df = once(df, score, label, tie, by)
        curve = keyed_curve(df, score, label, by)
    before = F.col("cum_n") - F.col("n") if descending else F.col("n_total") - F.col("cum_n")
    placed = curve.rows.withColumn("before", before).withColumns(
        {
            "tile": tile_of(F.col("before") + 1, F.col("n_total")),
            "last_tile": tile_of(F.col("before") + F.col("n"), F.col("n_total")),
        }
    )
    inside = F.col("tile") == F.col("last_tile")
    zero = F.lit(0).cast("bigint")
    # At most one run leaves each tile; it is carried along so that the curve is read once.
    # Plain columns keep the aggregation hashed; a struct would have it sort.
    per_tile = placed.groupBy("__g", "tile").agg(
        F.sum(F.when(inside, F.col("n")).otherwise(zero)).alias("n"),
        F.sum(F.when(inside, F.col("pos")).otherwise(zero)).alias("pos"),
        F.sum(F.when(inside, F.col("n") * F.col("score")).otherwise(0.0)).alias("score_sum"),
        F.max(F.when(~inside, F.col("score"))).alias("score"),
        F.max(F.when(~inside, F.col("before"))).alias("before"),
        F.max("n_total").alias("n_total"),
    )
    per_tile = materialise(per_tile, "tiles")
    whole = per_tile.drop("score", "before", "n_total")
    cut = per_tile.filter(F.col("score").isNotNull()).select("__g", "score", "before", "n_total")
    split = ranked_ties(df, score, label, tie, by, cut, curve.straddlers(tiles)).select(
        "__g",
        tile_of(F.col("before") + F.col("rank"), F.col("n_total")).alias("tile"),
        F.lit(1).cast("bigint").alias("n"),
        "pos",
        F.col("score").alias("score_sum"),
    )
    totals = (
        whole.unionByName(split)
        .groupBy("__g", "tile")
        .agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("score_sum").alias("score_sum"))
    )
    return open_key(totals, by)


def once(df: DataFrame, score: str, label: str, tie: str, by: Sequence[str]) -> DataFrame:
    """Only what a curve and its tied rows need, as a table: both read it, and the source is read once."""
    return materialise(df.select(*dict.fromkeys([*by, score, label, tie])), "scored")


def ranked_ties(
    df: DataFrame, score: str, label: str, tie: str, by: Sequence[str], cut: DataFrame, cut_rows: int
) -> DataFrame:
    """The single rows of the (group, score) pairs in ``cut`` (a written table), ranked by tie-break.

    One score may hold a third of all rows. Ranking its rows by tie-break is the curve
    problem again, one level down: the tie-break is the score and (group, score) the
    group, so it is bucketed the same way.
    """
    rows = df.select(
        _key(by).alias("__g"), F.col(score).alias("score"), F.col(label).alias("__y"), tie_key(df, tie).alias("__tie")
    )
    chosen = rows.join(small(cut.select("__g", "score"), cut_rows), ["__g", "score"])
    inner = keyed_curve(chosen, "__tie", "__y", ["__g", "score"])
    ranked = inner.rows.select(
        F.col("__g.__g").alias("__g"),
        F.col("__g.score").alias("score"),
        "pos",
        (F.col("n_total") - F.col("cum_n") + 1).alias("rank"),
    )
    return ranked.join(small(cut, cut_rows), ["__g", "score"])


def at_most_nth(df: DataFrame, tie: str, n: int) -> Column:
    """Condition of the rows up to the n-th smallest (1-based) tie-break of the frame."""
    keys = df.select(tie_key(df, tie).alias("__tie"), F.lit(1).alias("__one"))
    curve = keyed_curve(keys, "__tie", "__one").rows
    at = curve.filter(F.col("n_total") - F.col("cum_n") + 1 == n).first()["score"]
    if isinstance(at, Row):
        at = F.struct(F.lit(at["h"]).alias("h"), F.lit(at["id"]).alias("id"))
    return tie_key(df, tie) <= at


def order_statistics(curve: DataFrame, by: Sequence[str], fractions: dict[str, tuple[int, int]]) -> DataFrame:
    """Linearly interpolated quantiles per group, read off the curve by exact rank.

    ``fractions`` maps an output name to (numerator, denominator); the position
    (n - 1) * numerator / denominator is found in whole numbers.
    """
    below = F.col("n_total") - F.col("cum_n")
    exprs = []
    for name, (num, den) in fractions.items():
        scaled = (F.col("n_total") - 1) * num
        low, rest = F.floor(scaled / den), scaled % den
        high = low + F.when(rest > 0, 1).otherwise(0)
        at = lambda r: F.max(F.when((below <= r) & (r < below + F.col("n")), F.col("score")))
        weight = F.max(rest) / F.lit(float(den))
        exprs.append((at(low) + (at(high) - at(low)) * weight).alias(name))
    return curve.groupBy(*by).agg(*exprs)
