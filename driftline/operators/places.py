"""Places: radius joins on a grid, and clusters of stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.geo import MEAN_RADIUS_KM, mean_haversine_m
from driftline.operators.grouped import in_pieces

METRES_PER_DEGREE = MEAN_RADIUS_KM * 1000 * np.pi / 180


def radius_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], radius_m: float, keep_a: tuple[str, ...] = (), keep_b: tuple[str, ...] = ()
) -> DataFrame:
    """Pairs of rows of one key within ``radius_m`` metres: ``keys, a, b, metres``, and other columns to keep of either side.

    Both sides have columns keys, id, lat and lon.  A grid of latitude bands and
    longitude columns of the radius's width turns the distance into equality of
    cells: the left looks into its own cell and its neighbours.  Longitude
    columns widen toward the poles, so no pair is missed.  Both sides are
    shuffled: sizes estimated before events become points would put one of them
    into the driver's memory.
    """
    size = radius_m / METRES_PER_DEGREE
    row = F.floor(F.col("lat") / size)
    # The band's widest reach: its edge nearest to the pole, one band further out for the neighbours.
    edge = F.least(F.lit(89.9), F.greatest(F.abs(row - 1), F.abs(row + 2)) * size)
    width = size / F.cos(F.radians(edge))
    rows = F.col("id"), F.col("lat"), F.col("lon")
    looks = left.select(*keys, *rows, *[c for c in keep_a if c not in ("lat", "lon")], row.alias("r"), F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias("up"))
    looks = looks.withColumn("cell_y", F.col("r") + F.col("up"))
    edge2 = F.least(F.lit(89.9), F.greatest(F.abs(F.col("cell_y") - 1), F.abs(F.col("cell_y") + 2)) * size)
    width2 = size / F.cos(F.radians(edge2))
    looks = looks.withColumn("cell_x", F.explode(F.sequence(F.floor(F.col("lon") / width2) - 1, F.floor(F.col("lon") / width2) + 1)))
    cells = right.select(*keys, *[c.alias(f"__{n}") for c, n in zip(rows, ("id", "lat", "lon"), strict=True)], *keep_b, row.alias("cell_y"), F.floor(F.col("lon") / width).alias("cell_x"))
    metres = mean_haversine_m("lat", "lon", "__lat", "__lon")
    return (
        looks.join(cells.hint("merge"), [*keys, "cell_y", "cell_x"])
        .select(*keys, F.col("id").alias("a"), F.col("__id").alias("b"), metres.alias("metres"), *keep_a, *keep_b)
        .filter(F.col("metres") <= radius_m)
    )


#: Distances that are held at once.
_CELLS = 2_000_000


def _blocks(lat: np.ndarray, lon: np.ndarray, eps_m: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, others, metres between them) in pieces that together hold all neighbours, in order of latitude."""
    order = np.argsort(lat, kind="stable")
    y, x = np.radians(lat[order]), np.radians(lon[order])
    reach = eps_m / (MEAN_RADIUS_KM * 1000) * (1 + 1e-9)
    lo = 0
    while lo < len(order):
        first = int(np.searchsorted(y, y[lo] - reach))
        hi, last = lo + 1, int(np.searchsorted(y, y[lo] + reach, side="right"))
        while hi < len(order):
            end = int(np.searchsorted(y, y[hi] + reach, side="right"))
            if (hi + 1 - lo) * (end - first) > _CELLS:
                break
            hi, last = hi + 1, end
        a, b = y[lo:hi, None], y[first:last]
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((x[first:last] - x[lo:hi, None]) / 2) ** 2
        yield order[lo:hi], order[first:last], 2000 * MEAN_RADIUS_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))
        lo = hi


def clusters(lat: np.ndarray, lon: np.ndarray, eps_m: float, min_samples: int, days: np.ndarray | None = None) -> np.ndarray:
    """Number of each point's cluster: its first core point; noise is a cluster of its own.

    A point is core with ``min_samples`` points, itself included, within ``eps_m``,
    or with so many distinct ``days`` of them.  Others join the nearest core
    point within ``eps_m``, the first of equally near ones.
    """
    n = len(lat)
    count = np.zeros(n, dtype=int)
    for rows, others, metres in _blocks(lat, lon, eps_m):
        near = metres <= eps_m
        count[rows] = near.sum(axis=1) if days is None else [len(np.unique(days[others[x]])) for x in near]
    core = count >= min_samples
    root, nearest = np.arange(n), np.full(n, -1)
    for rows, others, metres in _blocks(lat, lon, eps_m):
        near = (metres <= eps_m) & core[others]
        i, j = np.nonzero(near & core[rows][:, None])
        a, b = rows[i], others[j]
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            for side in (root[a], root[b]):
                np.minimum.at(root, side, low)
            root = root[root]
        for r in np.flatnonzero(~core[rows] & near.any(axis=1)):
            gap = np.where(near[r], metres[r], np.inf)
            nearest[rows[r]] = others[gap == gap.min()].min()
    while (root[root] != root).any():
        root = root[root]
    return np.where(nearest >= 0, root[nearest], root)


def dbscan(
    stays: DataFrame, eps_m: float | str = 150.0, min_samples: int | str = 2, keys: tuple[str, ...] = ("user_id",), days: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """``place``: number of the stay's cluster among its key's, the order of its first core member.

    A stay counts as its own neighbour; with ``days``, a column, its distinct
    values are counted instead of stays.  ``eps_m`` and ``min_samples`` may name
    columns that are constant within a key.  Noise is a place of its own.
    Members are ordered by arrival, then position.  The stays of one key come
    together in one task; distances are taken in bounded pieces.  ``pieces`` is the
    number of partitions, of the result by ``keys`` too, where the engine shouldn't choose it.
    """
    names = stays.columns
    at = {c: names.index(c) for c in names}

    def one(table: pa.Table, value: float | str) -> float:
        return table.column(at[value])[0].as_py() if isinstance(value, str) else value

    def cluster(table: pa.Table) -> pa.Table:
        lat, lon = (table.column(at[c]).to_numpy().astype(float) for c in ("lat", "lon"))
        day = np.unique(np.array(table.column(at[days]).to_pylist(), dtype=object).astype(str), return_inverse=True)[1] if days else None
        place = clusters(lat, lon, float(one(table, eps_m)), int(one(table, min_samples)), day)
        return table.append_column("place", pa.array(place.astype(np.int64)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the key that isn't complete yet
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(at[k]).to_numpy(zero_copy_only=False) for k in keys]
            moved = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                moved[1:] |= c[1:] != c[:-1]
            moved[0] = last is not None and tuple(c[0] for c in columns) != last
            lo = 0
            for hi in [*np.flatnonzero(moved).tolist(), batch.num_rows]:
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                if hi < batch.num_rows:
                    yield from cluster(pa.Table.from_batches(held)).to_batches()
                    held = []
                lo = hi
            last = tuple(c[-1] for c in columns)
        if held:
            yield from cluster(pa.Table.from_batches(held)).to_batches()

    dealt = stays.repartition(pieces, *keys) if pieces else stays.repartition(*keys)
    placed = dealt.sortWithinPartitions(*keys, "arrival", "lat", "lon").mapInArrow(each, T.StructType([*stays.schema.fields, T.StructField("place", T.LongType())]))
    return in_pieces(placed, pieces, *keys)
