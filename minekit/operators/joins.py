"""Joins: validated lookups, overrides, carry-forward, fuzzy, radius and nearest-neighbour."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from minekit.functions.geo import EARTH_KM, haversine_km, unit_vector
from minekit.functions.text import typo_match
from minekit.scale import attach, blocks_for, enrich, settle

PIVOTS = 1024  # vectors on the driver that split the references
_FINEST = 24  # halvings of the globe's height for the smallest radii


def lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str], validate: str | None = "m:1") -> DataFrame:
    """Left equi-join; with ``m:1`` a repeated dimension key fails the job instead of adding rows."""
    if validate != "m:1":
        return df.join(dim, list(on), "left")
    first = dim.groupBy(*on).agg(F.min(F.struct(*[c for c in dim.columns if c not in on])).alias("__dim"))
    rest = [c for c in dim.columns if c not in on]
    joined = enrich(df, first, on).select(*df.columns, *[F.col("__dim")[c].alias(c) for c in rest])
    repeated = dim.groupBy(*on).count().where("count > 1").agg(F.count("*")).scalar()
    message = F.lit(f"lookup key {', '.join(on)} is not unique")
    return joined.where(F.when(repeated > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def override_join(df: DataFrame, fix: DataFrame, on: Sequence[str], c: str) -> DataFrame:
    """Replace ``c`` where ``fix`` (keys + same column) has a value for the key."""
    named = fix.select(*on, F.col(c).alias("__fix"))
    return enrich(df, named, on).withColumn(c, F.coalesce("__fix", c)).drop("__fix")


apply_corrections = override_join


def carry_forward_join(
    df: DataFrame, dim: DataFrame, on: Sequence[str], year: str, span: int = 1
) -> DataFrame:
    """Left join where a dimension row also holds for the next ``span`` years.

    When two rows cover a year the newest one wins.
    """
    keys = [*on, year]
    rest = [c for c in dim.columns if c not in keys]
    covered = (
        dim.withColumn("__from", F.col(year))
        .withColumn(year, F.explode(F.sequence(F.col("__from"), F.col("__from") + span)))
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col("__from")).alias("__row"))
        .select(*keys, "__row.*")
    )
    return enrich(df, covered, keys)


def fill_from_previous(
    df: DataFrame, keys: Sequence[str], year: str, step: int, c: str, bad: Column
) -> DataFrame:
    """Replace bad values by the value ``step`` years before, repaired values feeding later ones.

    A missing earlier year ends the chain. One row per (key, year); a key's years are few.
    """
    w = Window.partitionBy(*keys, F.pmod(F.col(year), F.lit(step))).orderBy(year)
    starts = F.coalesce(F.col(year) - F.lag(year).over(w) != step, F.lit(True))
    marked = df.withColumn("__start", starts.cast("int"))
    marked = marked.withColumn("__island", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chain = (
        Window.partitionBy(*keys, F.pmod(F.col(year), F.lit(step)), "__island")
        .orderBy(year)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    good = F.when(~F.coalesce(bad, F.lit(True)), F.col(c))
    return marked.withColumn(c, F.coalesce(F.last(good, ignorenulls=True).over(chain), F.col(c))).drop(
        "__start", "__island"
    )


def zip_by_id(a: DataFrame, b: DataFrame, row_id: str, how: str = "inner") -> DataFrame:
    """Column concat of two tables with the same row ids."""
    return a.join(b, row_id, how)


def semi_match(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose ``cols`` equal some row of ``b``, nulls equal to nulls."""
    other = b.select(*[F.col(c).alias(f"__{c}") for c in cols]).distinct()
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(other, same, "left_semi")


def _typos(longest: Column, ratio: int) -> Column:
    return F.floor(longest / ratio).cast("int")


def _grams(names: DataFrame, clean: str, ratio: int) -> DataFrame:
    """``names`` once for every length ``__long`` that the longer name of a matching pair can have, with its pieces ``__grams`` (gram, pos).

    A typo (a swap of neighbours at worst) changes q + 1 of the pieces of q letters, so of any (q + 1) * typos + 1 pieces of a name
    (``__least``) one stands, moved by at most the number of typos, in every name within the limit. q is as large as leaves about
    half of the pieces unasked; it depends on the longer name alone, so both names are cut alike. A pair that allows no typo is equal.
    """
    own = F.length(clean)
    reach = F.floor(own / (ratio - 1)).cast("int")
    sized = names.withColumn("__long", F.explode(F.sequence(own, own + reach)))
    typos = _typos(F.col("__long"), ratio)
    sized = sized.withColumn("__typos", typos).where(F.col("__long") - own <= F.col("__typos"))
    if ratio < 4:  # short names have too few pieces: they all meet
        one = F.array(F.struct(F.lit("").alias("gram"), F.lit(0).alias("pos")))
        return sized.withColumn("__grams", one).withColumn("__least", F.lit(1))
    t = F.col("__typos")
    room = F.floor((0.55 * (F.col("__long") - t + 3) - t - 1) / (t + 0.55))
    sized = sized.withColumn("__q", F.greatest(F.lit(2), F.least(F.lit(6), room)).cast("int"))
    framed = F.concat(F.lit("\x02"), F.col(clean), F.lit("\x03"))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), own + 3 - F.col("__q")))
    pieces = F.transform(places, lambda i: F.struct(framed.substr(i, F.col("__q")).alias("gram"), i.alias("pos")))
    whole = F.array(F.struct(F.concat(F.lit("\x04"), F.col(clean)).alias("gram"), F.lit(0).alias("pos")))
    return sized.withColumn("__grams", F.when(t == 0, whole).otherwise(pieces)).withColumn("__least", (F.col("__q") + 1) * t + 1)


def fuzzy_lookup(
    df: DataFrame,
    dim: DataFrame,
    *,
    name: str,
    dim_name: str,
    block: Sequence[str] = (),
    ratio: int,
    out: str = "match",
    asked_as: Callable[[Column], Column] = F.array,
    dim_as: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """Dimension name for each row: exact match first, else the first name (alphabetically) within typos.

    Adds ``out`` and ``<out>_exact``. Only distinct (block, name) pairs are compared and exact hits leave before the typo
    search. Candidates meet at the rarest pieces of their names (see ``_grams``), so what most names share brings no two of
    them together; their lengths and the places of the piece must fit. ``asked_as`` gives the bare spellings (array) of an asked name,
    ``dim_as`` the bare dimension name. With a ``ratio`` below 4 all names of a block meet.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    block = list(block)
    asked = df.where(F.col(name).isNotNull()).select(*block, F.col(name).alias("__name")).distinct()
    names = dim.where(F.col(dim_name).isNotNull()).select(*block, F.col(dim_name).alias("__dim")).distinct()
    asked, names = settle(asked), settle(names)
    exact = asked.join(names.withColumn("__name", F.col("__dim")), [*block, "__name"])
    exact = exact.select(*block, "__name", F.col("__dim").alias(out), F.lit(True).alias(f"{out}_exact"))
    rest = asked.join(exact.select(*block, "__name"), [*block, "__name"], "left_anti")

    bare = settle(_grams(names.withColumn("__dim_clean", dim_as(F.col("__dim"))).where("__dim_clean is not null"), "__dim_clean", ratio))
    # a piece's rank is the same on both sides; pieces that no dimension name has come first and find nothing
    often = settle(bare.select(F.explode(F.array_distinct(F.transform("__grams", lambda g: g["gram"]))).alias("__gram")).groupBy("__gram").agg(F.count("*").alias("__n")))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        own = [c for c in df.columns if c not in ("__grams", "__q", "__typos")]
        known = attach(df.select(*own, "__typos", F.inline("__grams")).withColumnRenamed("gram", "__gram"), often.withColumn("__often", F.col("__n")), ["__gram"], "__n", written=True)
        order = F.struct(F.coalesce("__often", F.lit(0)).alias("often"), F.col("__gram").alias("gram"))
        listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("pos"))))
        sets = known.groupBy(*own, "__typos").agg(listed.alias("__l"))
        last = F.get("__l", F.least("__least", F.size("__l")) - 1)["o"]  # all places of the last piece are asked
        kept = sets.withColumn("__last", last).withColumn("__g", F.explode(F.filter("__l", lambda g: g["o"] <= F.col("__last"))))
        kept = kept.select(*[c for c in own if c != "__least"], *(["__typos"] if side == "a" else []), F.col("__g.o.gram").alias("__gram"), F.col("__g.pos").alias(f"__pos_{side}"))
        return kept

    spelled = rest.withColumn("__clean", F.explode(asked_as(F.col("__name")))).where("__clean is not null").distinct()
    both = keyed(_grams(spelled, "__clean", ratio), "a").join(keyed(bare, "b"), [*block, "__long", "__gram"])
    fits = (F.greatest(F.length("__clean"), F.length("__dim_clean")) == F.col("__long")) & (F.abs(F.col("__pos_a") - F.col("__pos_b")) <= F.col("__typos"))
    near = both.where(fits)
    # written once: the matches below feed several branches, the comparison runs in Python
    near = settle(near.select(*block, "__name", "__clean", "__dim", "__dim_clean").distinct())
    typo = (
        near.where(typo_match("__clean", "__dim_clean", ratio) == 1)
        .groupBy(*block, "__name")
        .agg(F.min("__dim").alias(out))
        .withColumn(f"{out}_exact", F.lit(False))
    )
    found = settle(exact.unionByName(typo).withColumnRenamed("__name", name))
    return enrich(df, found, [*block, name])


def radius_join(
    points: DataFrame,
    regions: DataFrame,
    *,
    block: Sequence[str],
    lat: str,
    lon: str,
    name: str,
    out: str = "region",
) -> DataFrame:
    """First region (by name) of the same block whose centroid lies within that region's radius.

    ``regions``: block columns, ``name``, ``centroid_lat``, ``centroid_lon``, ``radius_km``. Identical
    points are matched once. A circle is covered by a few cells of a grid whose cells are about as high as its radius, and meets only
    the points of these cells; points are put on the grids of the radii that occur (one per power of two). Rows without a place, or
    with one that is not on the globe, match nothing.
    """
    block = list(block)
    globe = F.col(lat).between(-90, 90) & F.col(lon).between(-1e6, 1e6)
    spots = points.where(globe).select(*block, lat, lon).distinct()
    round_them = regions.where(F.col("centroid_lat").between(-90, 90) & (F.col("radius_km") >= 0))
    round_them = round_them.select(*block, name, "centroid_lat", "centroid_lon", "radius_km")

    # the cover reaches a little further than the circle, so that rounding loses nothing
    reach = F.least(F.lit(180.0), F.degrees(F.col("radius_km") / EARTH_KM) * (1 + 1e-9) + 1e-9)
    level = F.least(F.lit(_FINEST), F.floor(F.log2(180.0 / reach))).cast("int")
    height = lambda lv: 180.0 / F.pow(F.lit(2.0), lv)
    covers = settle(round_them.withColumn("__reach", reach).withColumn("__level", level))
    levels = [r["__level"] for r in covers.select("__level").distinct().collect()]  # at most _FINEST + 1
    if not levels:
        levels = [0]

    def cells(lv: Column, row: Column) -> Column:
        """Number of cells around the globe in a row of cells: none is narrower than high at its polar edge."""
        edge = F.greatest(F.abs(row * height(lv) - 90), F.abs((row + 1) * height(lv) - 90))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / height(lv))).cast("long")

    east = lambda c: F.pmod(F.col(c) + 180.0, F.lit(360.0))
    row_of = lambda y, lv: F.floor((y + 90) / height(lv))
    last_row = lambda lv: F.pow(F.lit(2.0), lv).cast("long") - 1
    placed = spots.withColumn("__level", F.explode(F.array(*map(F.lit, levels))))
    placed = placed.withColumn("__row", F.least(row_of(F.col(lat), F.col("__level")), last_row(F.col("__level"))))
    around = cells(F.col("__level"), F.col("__row"))
    placed = placed.withColumn("__cell", F.pmod(F.floor(east(lon) / 360.0 * around), around))

    lv, r = F.col("__level"), F.col("__reach")
    first = F.greatest(F.lit(0), row_of(F.col("centroid_lat") - r, lv))
    final = F.least(last_row(lv), row_of(F.col("centroid_lat") + r, lv))
    covers = covers.withColumn("__row", F.explode(F.sequence(F.least(first, last_row(lv)), final)))
    # the meridians that touch the circle; all of them if it holds a pole
    pole = F.abs("centroid_lat") + r >= 90
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(r, F.lit(90.0)))) / F.cos(F.radians("centroid_lat")))))
    covers = covers.withColumn("__wide", F.when(pole, 180.0).otherwise(wide * (1 + 1e-9) + 1e-9)).withColumn("__n", cells(lv, F.col("__row")))
    edge = lambda sign: F.floor((east("centroid_lon") + sign * F.col("__wide")) / 360.0 * F.col("__n"))
    whole = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    some = F.when(edge(1) - edge(-1) + 1 >= F.col("__n"), whole).otherwise(F.transform(F.sequence(edge(-1), edge(1)), lambda j: F.pmod(j, F.col("__n"))))
    covers = covers.withColumn("__cell", F.explode(some)).drop("__reach", "__wide", "__n")

    near = haversine_km(lat, lon, "centroid_lat", "centroid_lon") <= F.col("radius_km")
    hits = placed.join(covers, [*block, "__level", "__row", "__cell"]).where(near).groupBy(*block, lat, lon).agg(F.min(name).alias(out))
    return enrich(points, hits, [*block, lat, lon])


def _neighbour_cells(dims: int) -> list[tuple[int, ...]]:
    cells: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        cells = [(*c, o) for c in cells for o in (-1, 0, 1)]
    return cells


_DEEPEST = 48  # halvings of the extent; below that coordinates of doubles are the same


def knn_grid(
    queries: DataFrame,
    refs: DataFrame,
    *,
    query_id: str,
    ref_id: str,
    coords: Sequence[str],
    k: int,
    block: Sequence[str] = (),
    per_cell: int = 4096,
    per_point: int = 2,
    strict: bool = False,
) -> DataFrame:
    """Exact k nearest neighbours in 1 to 3 dimensions: ``query_id, ref_id, dist, rank``.

    Cells halve in size from the extent of all points until no cell holds more than ``per_cell`` reference points, and a reference
    point shares its cell with ``per_point`` * k of them on average, however the points lie.
      1. For every query cell, the finest level whose 3^d neighbourhood holds k reference points is
         found from cell counts; the k nearest points in it bound the true distance by r.
      2. Everything within r lies in the 3^d neighbourhood at the level with cells just above r.
    Reference points that share a location are reduced to their k smallest ids, and queries are answered
    once per location, so piles of copies never multiply. Ties go to the smaller id. ``strict`` leaves out
    the query's own id.
    """
    block, coords, dims = list(block), list(coords), len(coords)
    keep = k + 1 if strict else k
    valid = F.lit(True)
    for c in coords:
        valid = valid & F.col(c).isNotNull()
    place = Window.partitionBy(*block, *coords).orderBy(ref_id)
    spots = (
        refs.where(valid)
        .select(*block, *coords, F.col(ref_id).alias("__ref"))
        .withColumn("__rn", F.row_number().over(place.orderBy("__ref")))
        .where(F.col("__rn") <= keep)
        .drop("__rn")
    )
    location = F.struct(*block, *coords).alias("__qid")
    asked = queries.where(valid).select(location, *block, *coords).distinct()

    def cell(level: Column, c: str) -> Column:
        return F.floor((F.col(c) - low[c]) * F.pow(F.lit(2.0), level) / top_cell).cast("long")

    axes = [f"__c{i}" for i in range(dims)]
    def at_levels(df: DataFrame) -> DataFrame:
        spread = df.select("*", every)
        return spread.withColumns({a: cell(F.col("__level"), c) for a, c in zip(axes, coords)})

    around = F.array(
        *[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in _neighbour_cells(dims)]
    )

    def neighbours(df: DataFrame) -> DataFrame:
        near = df.withColumn("__o", F.explode(around))
        return near.withColumns({a: F.col(a) + F.col(f"__o.o{i}") for i, a in enumerate(axes)}).drop("__o")

    spots = settle(spots)
    ends = [f(c) for c in coords for f in (F.min, F.max)]
    box = spots.select(*coords).unionByName(asked.select(*coords)).agg(F.count("*"), *ends).first()
    n, low = box[0], {c: float(box[2 * i + 1] or 0.0) for i, c in enumerate(coords)}
    # the first level is one cell with a margin, so every point is in the neighbourhood of every other
    top_cell = max(float(box[2 * i + 2] or 0.0) - low[c] for i, c in enumerate(coords)) or 1.0
    levels = max(1, math.ceil(math.log2(n / 64 + 1) / dims))
    while levels < _DEEPEST:
        finest = spots.groupBy(*block, *[cell(F.lit(levels), c) for c in coords]).count()
        held = finest.agg(F.max("count"), F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
        # points on a curve or surface, or in few places, fill few cells: what a point finds in its own cell counts, not the mean cell
        if (held[0] or 0) <= per_cell and (held[1] or 0) <= per_point * keep * (held[2] or 0):
            break
        crowd = max((held[0] or 0) / per_cell, (held[1] or 0) / max(1, per_point * keep * (held[2] or 0)))
        levels = min(_DEEPEST, levels + max(2, math.ceil(math.log2(crowd) / dims)))  # a level parts a cell in 2^dims at most
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__level")
    ref_cells = settle(at_levels(spots))
    cell_keys = [*block, "__level", *axes]
    counts = ref_cells.groupBy(*cell_keys).agg(F.count("*").alias("__n"))
    # counts spread to the neighbourhood: how many references does a query in this cell see
    seen = neighbours(counts).groupBy(*cell_keys).agg(F.sum("__n").alias("__seen"))
    level_of = (
        at_levels(asked)
        .join(seen.where(F.col("__seen") >= keep), cell_keys)
        .groupBy("__qid")
        .agg(F.max("__level").alias("__level"))
    )
    first = asked.join(level_of, "__qid", "left").withColumn("__level", F.coalesce("__level", F.lit(0)))

    right = ref_cells.select(*cell_keys, *[F.col(c).alias(f"__r_{c}") for c in coords], "__ref")
    dist = F.sqrt(sum((F.pow(F.col(c) - F.col(f"__r_{c}"), 2) for c in coords), F.lit(0.0)))
    best = Window.partitionBy("__qid").orderBy("dist", "__ref")

    def nearest(df: DataFrame) -> DataFrame:
        cut = df.withColumns({a: cell(F.col("__level"), c) for a, c in zip(axes, coords)})
        pairs = neighbours(cut).join(right, cell_keys).withColumn("dist", dist)
        ranked = pairs.withColumn("rank", F.row_number().over(best))
        return ranked.where(F.col("rank") <= keep)

    bound = nearest(first).groupBy("__qid").agg(F.max("dist").alias("__r"), F.count("*").alias("__got"))
    # cells of size >= r: level <= log2(top / r), one step of slack for rounding
    fit = F.when(
        F.col("__got") >= keep,
        F.least(F.lit(levels), F.floor(F.log2(top_cell / F.greatest("__r", F.lit(top_cell * 2.0**-60)))) - 1),
    )
    second = asked.join(bound, "__qid", "left").withColumn(
        "__level", F.greatest(F.lit(0), F.coalesce(fit, F.lit(0))).cast("int")
    )
    found = F.array_sort(F.collect_list(F.struct("dist", F.col("__ref").alias("ref")))).alias("__near")
    lists = nearest(second).groupBy("__qid").agg(found)  # at most ``keep`` entries each
    rows = enrich(queries.where(valid).select(F.col(query_id).alias("__id"), location), lists, ["__qid"])
    others = F.filter("__near", lambda x: x["ref"] != F.col("__id")) if strict else F.col("__near")
    ranked = rows.select(F.col("__id").alias(query_id), F.posexplode(F.slice(others, 1, k)).alias("__i", "__n"))
    return ranked.select(
        query_id, F.col("__n.ref").alias(f"nn_{ref_id}"), F.col("__n.dist").alias("dist"), (F.col("__i") + 1).alias("rank")
    )


def pair_metric(df: DataFrame, pairs: DataFrame, key: str, value: str, metric: Callable[[Column, Column], Column], out: str = "distance") -> DataFrame:
    """``metric`` of the values of each pair ``a, b`` of keys: any function of two columns, for points or whole series.

    Pairs with an unknown key have no row.
    """
    left = df.select(F.col(key).alias("a"), F.col(value).alias("__va"))
    right = df.select(F.col(key).alias("b"), F.col(value).alias("__vb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", metric(F.col("__va"), F.col("__vb")).alias(out))


def knn_geo(
    queries: DataFrame,
    refs: DataFrame,
    *,
    query_id: str,
    ref_id: str,
    lat: str,
    lon: str,
    k: int,
    block: Sequence[str] = (),
    strict: bool = False,
) -> DataFrame:
    """k nearest on the sphere, ``dist`` in km: points become unit vectors and go through the grid."""

    def on_sphere(df: DataFrame, key: str) -> DataFrame:
        x, y, z = unit_vector(lat, lon)
        return df.select(key, *block, x.alias("__x"), y.alias("__y"), z.alias("__z"))

    chord = knn_grid(
        on_sphere(queries, query_id),
        on_sphere(refs, ref_id),
        query_id=query_id,
        ref_id=ref_id,
        coords=["__x", "__y", "__z"],
        k=k,
        block=block,
        strict=strict,
    )
    return chord.withColumn("dist", 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.col("dist") / 2)))


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float)


def _to_pivots(rows: np.ndarray, pivots: np.ndarray, p: int) -> np.ndarray:
    """Distances of rows to pivots."""
    if p == 1:
        return np.stack([np.abs(row - pivots).sum(1) for row in rows])
    squares = (rows**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0))


def _exact_distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Distances of the rows of ``a`` to the same rows of ``b``."""
    gap = b - a
    return np.sqrt((gap**2).sum(1)) if p == 2 else np.abs(gap).sum(1)


class _Scores:
    """A score of every pair of rows and, per row of ``a``, an edge: pairs within a limit score the edge at most.

    Euclidean scores come from one matrix product. Manhattan scores are sums of whole numbers: entries are cut off at the usual range
    and rounded to steps, which makes no distance longer by more than a step per dimension.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, p: int):
        self.a, self.b, self.p, self.dims = a, b, p, b.shape[1]
        levels = min(65535 // max(1, self.dims), 32767)
        self.whole = p == 1 and levels >= 32
        if p == 2:
            self.squares = (b**2).sum(1)
            self.wide = np.column_stack([-2 * b, self.squares]).T.copy()
        elif self.whole:
            usual = np.nan_to_num(b[:: max(1, len(b) // 4096)])
            low, high = np.quantile(usual, [0.001, 0.999], axis=0)
            self.step = float((high - low).max()) / levels or 1.0
            cut = lambda x: np.rint((np.clip(np.nan_to_num(x), low, low + self.step * levels) - low) / self.step).astype(np.int16)
            self.qa, self.qb = cut(a), np.ascontiguousarray(cut(b).T)

    def of(self, rows: np.ndarray, refs: slice) -> np.ndarray:
        if self.p == 2:
            return np.column_stack([self.a[rows], np.ones(len(rows))]) @ self.wide[:, refs]
        if not self.whole:
            return _to_pivots(self.a[rows], self.b[refs], 1)
        own, other = self.qa[rows], self.qb[:, refs]
        total, gap = np.zeros((len(own), other.shape[1]), np.uint16), np.empty((len(own), other.shape[1]), np.int16)
        for i in range(self.dims):
            np.subtract(own[:, i, None], other[i], out=gap)
            np.abs(gap, out=gap)
            np.add(total, gap.view(np.uint16), out=total)
        return total

    def edge(self, rows: np.ndarray, refs: slice, limit: np.ndarray) -> np.ndarray:
        if self.p == 2:
            own = (self.a[rows] ** 2).sum(1)
            rounding = 1e-9 * (own + np.nan_to_num(self.squares[refs], posinf=0.0).max())
            return limit**2 * (1 + 1e-6) - own + rounding + 1e-12
        if not self.whole:
            return limit * (1 + 1e-6) + 1e-6
        steps = np.nan_to_num(limit / self.step * (1 + 1e-9), nan=65535.0, posinf=65535.0)
        return np.minimum(steps + self.dims + 1, 65535.0).astype(np.uint16)


def nearest_rows(
    a: np.ndarray, b: np.ndarray, own: np.ndarray, ids: np.ndarray, bound: np.ndarray, mask: np.ndarray, slots: np.ndarray, k: int, p: int, strict: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, id and distance of the up to ``k`` nearest rows of ``b`` no further than ``bound``.

    ``slots`` numbers the units of ``b`` (ascending); a row meets the units whose bit its ``mask`` has. ``own`` and ``ids`` are the
    ids of the rows. Scores leave few candidates, the exact form decides.
    """
    limit, scores, found = bound.astype(float).copy(), _Scores(a, b, p), []
    for slot in np.unique(slots):
        first, last = (int(x) for x in np.searchsorted(slots, [slot, slot + 1]))
        refs, asking = slice(first, last), np.flatnonzero(mask >> slot & 1)
        want, size = min(k, last - first), 256 if p == 2 else 64
        for start in range(0, len(asking), size):
            rows = asking[start : start + size]
            score = scores.of(rows, refs)
            if strict:
                same = own[rows][:, None] == ids[refs]
            loose = np.flatnonzero(~np.isfinite(limit[rows]))
            if len(loose) and want == k:  # the distances of the k best by score bound the true ones
                ranked = score[loose].astype(float)
                if strict:
                    ranked[same[loose]] = np.inf
                best = np.argpartition(ranked, want - 1, axis=1)[:, :want]
                far = _exact_distances(np.repeat(a[rows[loose]], want, 0), b[first + best.ravel()], p).reshape(best.shape)
                if strict:
                    far[np.take_along_axis(same[loose], best, 1)] = np.inf
                limit[rows[loose]] = np.where(np.isfinite(far).all(1), far.max(1), np.inf)
            hit = score <= scores.edge(rows, refs, limit[rows])[:, None]
            if strict:
                hit &= ~same
            i, j = np.nonzero(hit)
            true = [_exact_distances(a[rows[i[c : c + 65536]]], b[first + j[c : c + 65536]], p) for c in range(0, len(i), 65536)]
            true = np.concatenate([np.zeros(0), *true])
            kept = np.isfinite(true)
            i, near, true = i[kept], ids[first + j[kept]], true[kept]
            order = np.lexsort((near, true, i))
            i, near, true = i[order], near[order], true[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            full = rank == k - 1
            limit[rows[i[full]]] = np.minimum(limit[rows[i[full]]], true[full])
            found.append((rows[i[rank < k]], near[rank < k], true[rank < k]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, near, true = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((near, true, row))
    row, near, true = row[order], near[order], true[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], near[top], true[top]


UNITS = 8  # units of references, and as many of queries, that a tile holds at most
TILES = 32  # tiles wanted, while a cut has a quarter of a unit of queries


def knn_vectors(
    queries: DataFrame,
    refs: DataFrame,
    *,
    query_id: str,
    ref_id: str,
    vector: str,
    k: int,
    p: int = 2,
    strict: bool = False,
    per_block: int = 4096,
    report: dict | None = None,
) -> DataFrame:
    """Exact k nearest neighbours of high-dimensional vectors: ``query_id, nn_ref_id, dist, rank``.

    References go to the nearest of up to ``PIVOTS`` pivots, about ``per_block`` to a pivot. A query first meets the references
    of its own pivot; its k-th distance there bounds the true one, and by the triangle inequality only pivots whose
    references can be that near are met next. Crowded pivots are cut by the hash of the id into units of about ``per_block`` rows;
    ``UNITS`` units of neighbouring pivots and as many queries share a tile, in which a query meets the units it needs and takes
    the references within its bound. A tile keeps the k best per query, and the tiles are merged by a ranked top k. Ties go to the
    smaller id. ``report`` gets the ``share`` of all pairs that were compared.
    """

    def kernel(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        r = r.sort_by([("slot", "ascending"), ("__id", "ascending")])
        a, b = _stacked(q.column("__v")), _stacked(r.column("__v"))
        own, ids, bound, mask, slots = (t.column(c).to_numpy() for t, c in ((q, "__id"), (r, "__id"), (q, "__bound"), (q, "mask"), (r, "slot")))
        row, near, dist = nearest_rows(a, b, own, ids, bound, mask, slots, k, p, strict)
        return pa.table({"q": own[row], "r": near, "dist": dist})

    def read(df: DataFrame, row_id: str) -> DataFrame:
        kept = df.schema[vector].dataType.simpleString()
        return settle(df.select(F.col(row_id).cast("long").alias("__id"), F.col(vector).cast(kept if kept == "array<float>" else "array<double>").alias("__v")))

    left, right = read(queries, query_id), read(refs, ref_id)
    n_left, n_right = left.count(), right.count()
    wanted = min(PIVOTS, blocks_for(n_right, per_block))
    # a fixed number of short vectors, taken by hash
    chosen = right.orderBy(F.xxhash64("__id"), "__id").limit(wanted).select("__v").collect()
    pivots = np.array([r["__v"] for r in chosen], float)

    def place(batches):
        for batch in batches:
            rows = _stacked(batch.column("__v")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
            home, far = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for i in range(0, len(rows), 1024):
                d = _to_pivots(rows[i : i + 1024], pivots, p)
                home[i : i + 1024] = d.argmin(1)
                far[i : i + 1024] = d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], names=["__id", "__v", "part", "far"])

    def placed(df: DataFrame) -> DataFrame:
        if len(pivots) > 1:
            return settle(df.mapInArrow(place, f"__id long, __v {df.schema['__v'].dataType.simpleString()}, part int, far double"))
        return df.select("*", F.lit(0).alias("part"), F.lit(0.0).alias("far"))

    left, right = placed(left), placed(right)
    held = {r["part"]: r for r in right.groupBy("part").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).collect()}
    if report is not None:
        report["share"] = 0.0
    if not held:
        return left.select(F.col("__id").alias(query_id), F.col("__id").alias(f"nn_{ref_id}"), F.lit(0.0).alias("dist"), F.lit(0).alias("rank")).limit(0)
    # parts that lie near each other get neighbouring units: those of one of the first few pivots together
    near = _to_pivots(pivots, pivots[: math.isqrt(len(pivots))], p).argmin(1) if len(pivots) > 1 else np.zeros(1, int)
    order = sorted(held, key=lambda part: (near[part], part))
    subs = np.array([blocks_for(held[part]["n"], per_block) for part in order])
    begin = np.cumsum(subs) - subs
    units = [(part, int(u), int(n)) for part, u, n in zip(order, begin, subs)]  # at most PIVOTS rows
    known = F.broadcast(left.sparkSession.createDataFrame(units, "part int, __first int, __subs int"))
    unit = (F.col("__first") + F.pmod(F.xxhash64("__id"), F.col("__subs"))).cast("int")
    right = right.join(known, "part").select("__id", "__v", F.floor(unit / UNITS).cast("int").alias("group"), F.pmod(unit, F.lit(UNITS)).alias("slot"))
    groups = -(-int(subs.sum()) // UNITS)
    part_of = np.repeat(order, subs)
    low, high = (np.array([held[i][c] if i in held else np.inf * sign for i in range(len(pivots))]) for c, sign in (("lo", 1), ("hi", -1)))
    apart = _to_pivots(pivots, pivots, p)
    compared = [0.0]

    def ask(bounded: DataFrame, further: bool) -> DataFrame:
        """Every query once for each group of units it has to meet: those of its own part, or the ``further`` ones within its bound."""

        def reach(batches):
            for batch in batches:
                rows = _stacked(batch.column("__v")) if batch.num_rows else np.zeros((0, pivots.shape[1]))
                home = batch.column("part").to_numpy()
                limit = batch.column("__bound").to_numpy(zero_copy_only=False).astype(float)
                for i in range(0, len(rows), 1024):
                    h, at = home[i : i + 1024], np.arange(len(home[i : i + 1024]))
                    need = np.zeros((len(h), len(pivots)), bool)
                    if further:
                        d = _to_pivots(rows[i : i + 1024], pivots, p)
                        least = np.maximum(d - high, low - d)
                        if p == 2:  # references are nearer to their pivot than to the query's
                            with np.errstate(divide="ignore", invalid="ignore"):
                                least = np.fmax(least, np.where(apart[h] > 0, (d**2 - d[at, h][:, None] ** 2) / (2 * apart[h]), 0.0))
                        slack = 1e-6 * (1 + d + np.abs(rows[i : i + 1024]).sum(1)[:, None])
                        need = (least <= limit[i : i + 1024][:, None] + slack) & np.isfinite(low)
                    need[at, h] = not further
                    bits = np.zeros((len(h), groups * UNITS), bool)
                    bits[:, : len(part_of)] = need[:, part_of]
                    masks = bits.reshape(len(h), groups, UNITS) @ (1 << np.arange(UNITS, dtype=np.int32))
                    which, group = np.nonzero(masks)
                    taken = batch.slice(i, len(h)).take(pa.array(which))
                    columns = [*[taken.column(c) for c in ("__id", "__v", "__bound")], pa.array(group.astype(np.int32)), pa.array(masks[which, group].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["__id", "__v", "__bound", "group", "mask"])

        return bounded.mapInArrow(reach, f"__id long, __v {left.schema['__v'].dataType.simpleString()}, __bound double, group int, mask int")

    filled = {(r["group"], r["slot"]): r["count"] for r in right.groupBy("group", "slot").count().collect()} if report is not None else {}

    def tiles(asked: DataFrame) -> DataFrame:
        """The k best per query inside each tile of a group of units and a cut of its queries."""
        met = [F.sum(F.col("mask").bitwiseAND(1 << i) / (1 << i)).alias(f"m{i}") for i in range(UNITS)]
        sizes = asked.groupBy("group").agg(F.count("*").alias("n"), *met).collect()  # a row per group
        compared[0] += sum(filled.get((r["group"], i), 0) * r[f"m{i}"] for r in sizes for i in range(UNITS))
        share = -(-TILES // max(1, len(sizes)))
        cuts = [(r["group"], max(blocks_for(r["n"], per_block * UNITS), min(share, blocks_for(r["n"], -(-per_block // 4))))) for r in sizes]
        many = max(1, 2 * sum(n for _, n in cuts))
        cut = F.broadcast(left.sparkSession.createDataFrame(cuts, "group int, __cuts int"))
        q = asked.join(cut, "group").withColumn("cut", F.pmod(F.xxhash64("__id"), F.col("__cuts")).cast("int")).drop("__cuts")
        r = right.join(cut, "group").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1))).drop("__cuts")
        # Spark would size tasks by bytes, of which tiles have few for their work
        q, r = (t.repartition(many, "group", "cut").groupBy("group", "cut") for t in (q, r))
        return q.cogroup(r).applyInArrow(kernel, "q long, r long, dist double")

    best = Window.partitionBy("q").orderBy("dist", "r")

    def top(close: DataFrame) -> DataFrame:
        return close.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    found = top(tiles(settle(ask(left.withColumn("__bound", F.lit(float("inf"))), False))))
    if len(pivots) > 1:
        found = settle(found)
        bound = found.groupBy("q").agg(F.count("*").alias("n"), F.max("dist").alias("d")).where(F.col("n") >= k)
        bounded = left.join(bound.select(F.col("q").alias("__id"), F.col("d")), "__id", "left")
        bounded = bounded.withColumn("__bound", F.coalesce("d", F.lit(float("inf"))))
        found = top(found.drop("rank").unionByName(tiles(settle(ask(bounded, True)))))
    if report is not None:
        report["share"] = compared[0] / max(1, n_left * n_right)
    return found.select(F.col("q").alias(query_id), F.col("r").alias(f"nn_{ref_id}"), "dist", "rank")


def column_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs of a (short) list of columns."""
    cols = list(cols)
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


def union(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concat by column name, missing columns null, duplicates kept."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def join_regions(df: DataFrame, regions: DataFrame, key: str, region_key: str) -> DataFrame:
    """Attach region attributes by upper-cased, trimmed name."""
    norm = lambda c: F.upper(F.trim(F.col(c)))
    dim = regions.withColumn("__k", norm(region_key)).drop(region_key)
    return df.withColumn("__k", norm(key)).join(dim, "__k", "left").drop("__k")
