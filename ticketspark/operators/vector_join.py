"""Exact joins of vectors by cosine: cells around pivots, bounds by the triangle inequality, matrix products inside."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.written import written

#: Twice as many vectors are worth cells, and the most cells; pivots are a sample of as many vectors and go to every task.
CELL_ROWS, MAX_CELLS = 2000, 1024
#: Vectors that are sampled to choose the number of cells; to copy a vector counts as so many products for each of CELL_ROWS.
SAMPLE, COPY = 2048, 10
#: Bytes of vectors of one side that a task holds: a larger cell is split into pieces that are held against each other.
PIECE_BYTES = 64 << 20
#: Pairs that two pieces may give, by what the sample says: pieces are smaller where more pairs are close.
PIECE_PAIRS = 4_000_000
#: Rows and columns of one product.
TILE = 1024
#: Pairs whose vectors are copied at once, and pairs that are given at once.
DOTS, CHUNK = 1 << 15, 1 << 18
#: What rounding can add to a distance or a product of vectors of length 1.
SLACK = 1e-7

Pivots = dict[int, np.ndarray]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    lengths = batch.column("v").value_lengths().to_numpy()
    for dim in np.unique(lengths).tolist():
        part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
        yield dim, part, _matrix(part.column("v"), dim)


def _piece_rows(dim: int, piece_bytes: int, most: int) -> int:
    return max(1, min(most, piece_bytes // (8 * dim + 64)))


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ pivots.T)))


def _homes(pivots: Pivots):
    """Each vector with its cell, that of the nearest pivot, and its distance to that; without pivots of its length cell 0."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, v in _by_length(batch):
                cell, near = np.zeros(len(v), np.int32), np.zeros(len(v))
                if dim in pivots:
                    d = _distances(v, pivots[dim])
                    cell = d.argmin(1).astype(np.int32)
                    near = d[np.arange(len(v)), cell]
                yield pa.record_batch([*part.columns, pa.array(np.full(len(v), dim, np.int32)), pa.array(cell), pa.array(near)], [*part.schema.names, "dim", "cell", "near"])

    return homes


def _visits(pivots: Pivots, reach: dict[tuple[int, int], float], lower_only: bool):
    """A row for each cell beyond a vector's own where another may lie within the vector's radius."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, v in _by_length(batch):
                if dim not in pivots:
                    continue
                p = pivots[dim]
                between, furthest = _distances(p, p), np.array([reach.get((dim, c), -np.inf) for c in range(len(p))])
                kept = [c for c in part.schema.names if c not in ("cell", "near")]
                for i in range(0, len(v), TILE):
                    rows = part.slice(i, TILE)
                    d, home = _distances(v[i : i + TILE], p), rows.column("cell").to_numpy()
                    meets = _meets(d, home, between, furthest, rows.column("radius").to_numpy()[:, None] + SLACK)
                    if lower_only:
                        meets &= np.arange(len(p)) < home[:, None]
                    row, cell = np.nonzero(meets)
                    for j in range(0, len(row), TILE):
                        r, c = row[j : j + TILE], cell[j : j + TILE]
                        some = rows.take(pa.array(r))
                        yield pa.record_batch([*[some.column(x) for x in kept], pa.array(c.astype(np.int32)), pa.array(d[r, c])], [*kept, "cell", "near"])

    return visits


def _meets(d: np.ndarray, home: np.ndarray, between: np.ndarray, furthest: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which cells other than home may hold a vector within radius, by distances d to all pivots.

    A pair within the radius crosses the plane halfway between its cells' pivots,
    so either is no further from that plane; and no cell reaches further from
    its pivot than its furthest vector.
    """
    every = np.arange(len(d))
    own = d[every, home][:, None]
    meets = (d * d - own * own <= 2 * between[home] * radius) & (d <= furthest + radius)
    meets[every, home] = False
    return meets


def _cells_for(v: np.ndarray, n: int, radius: float | None, most: int, rows: int, copy: int) -> int:
    """The number of cells with the least work for n vectors like those of a sample v: more of them are smaller, but asked in more often.

    Vectors are copied once for each cell that they ask in and each piece of rows that they meet; a copy costs as much as copy products.
    """
    half = len(v) // 2
    asks, best, chosen = v[half:], np.inf, 1
    if radius is None:  # about the distance of the nearest ones
        d = _distances(asks, v[:half])
        radius = float(np.median(d.min(1)))
    cells = 1
    while cells <= min(most, half):
        p = v[:cells]
        d = _distances(asks, p)
        home = d.argmin(1)
        furthest = np.full(cells, -np.inf)
        np.maximum.at(furthest, home, d[np.arange(len(d)), home])
        asked = 1 + _meets(d, home, _distances(p, p), furthest, np.full((len(d), 1), radius)).sum() / max(1, len(d))
        copies = asked * max(1, n / cells / rows) + max(1, asked * n / cells / rows)
        work = asked * n / cells + copies * copy
        if work < best:
            best, chosen = work, cells
        cells *= 2
    return chosen


def _rows_for(v: np.ndarray, pivots: np.ndarray, threshold: float) -> int:
    """Rows of a piece so that two of them give PIECE_PAIRS at most, where the sample v has most close pairs of a cell."""
    home = _distances(v, pivots).argmin(1)
    share = 0.0
    for cell in np.unique(home):
        some = v[home == cell]
        if len(some) > 16 or len(pivots) == 1:
            close = (some @ some.T >= threshold).sum() - len(some)
            share = max(share, close / max(1, len(some) * (len(some) - 1)))
    return int(min(1e9, (PIECE_PAIRS / max(share, 1e-12)) ** 0.5))


class Cells:
    """Vectors (id, v) of length 1 in cells around pivots, written once, with their other columns; ids are all different.

    radius is how far vectors look for others, as far as it is known; it and a
    sample of SAMPLE vectors choose the number of cells, which changes the work but no result.
    With a threshold of the pairs that are wanted, pieces are cut so that two of them give a bounded number.
    """

    def __init__(self, vectors: DataFrame, radius: float | None = None, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS, piece_bytes: int = PIECE_BYTES, threshold: float | None = None):
        vectors = written(vectors)
        n = vectors.count()
        self.pivots: Pivots = {}
        # twice as many pairs of pieces as cores at least, where all vectors meet
        self.piece_bytes, self.most_rows = piece_bytes, max(2 * cell_rows, ceil(n / ceil((2 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5)))
        if n >= 2 * cell_rows:
            sample = vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
            by_length = {dim: np.array([r.v for r in sample if len(r.v) == dim]) for dim in {len(r.v) for r in sample}}
            dim, most = max(by_length.items(), key=lambda x: len(x[1]))
            if threshold is not None:
                self.most_rows = min(self.most_rows, _rows_for(most, most[:1], threshold))
            cells = _cells_for(most, n, radius, max_cells, _piece_rows(dim, piece_bytes, self.most_rows), COPY * cell_rows)
            if cells > 1:
                self.pivots = {dim: v[: -(-cells * len(v) // len(sample)) if len(by_length) > 1 else cells] for dim, v in by_length.items()}
                if threshold is not None:
                    self.most_rows = min(self.most_rows, *(_rows_for(v, self.pivots[dim], threshold) for dim, v in by_length.items()))
        schema = StructType([*vectors.schema.fields, StructField("dim", IntegerType()), StructField("cell", IntegerType()), StructField("near", DoubleType())])
        self.homes = written(vectors.mapInArrow(_homes(self.pivots), schema))
        stats = self.homes.groupBy("dim", "cell").agg(F.max("near").alias("far"))
        #: The furthest vector of each cell from its pivot; as many as cells and lengths of vectors.
        self.reach = {(r.dim, r.cell): r.far for r in stats.collect()} if self.pivots else {}

    def visits(self, rows: DataFrame, lower_only: bool) -> DataFrame:
        """Rows of homes with a radius, once for each other cell that they may have partners in."""
        return rows.mapInArrow(_visits(self.pivots, self.reach, lower_only), StructType([f for f in rows.schema.fields if f.name not in ("cell", "near")] + [f for f in rows.schema.fields if f.name in ("cell", "near")]))

    def joined(self, homes: DataFrame, asking: DataFrame, work, schema: str) -> DataFrame:
        """work(homes, asking) on some of the cells' vectors and those that ask in each cell, in pieces of piece_bytes at most."""
        rows = F.greatest(F.lit(1), F.least(F.lit(self.most_rows), F.floor(F.lit(self.piece_bytes) / (8 * F.col("dim") + 64))))
        pieces = lambda df, n: df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.first(rows)).cast("int").alias(n))
        size = pieces(homes, "home_pieces").join(pieces(asking, "ask_pieces"), ["dim", "cell"])
        # a row for each cell and length of vectors; vectors are dealt to pieces where they are, without another shuffle
        size = F.broadcast(homes.sparkSession.createDataFrame(size.collect(), size.schema))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = homes.join(size, ["dim", "cell"]).withColumn("i", own("home_pieces")).withColumn("j", every("ask_pieces")).drop("home_pieces", "ask_pieces")
        right = asking.join(size, ["dim", "cell"]).withColumn("j", own("ask_pieces")).withColumn("i", every("home_pieces")).drop("home_pieces", "ask_pieces")
        # columns of their own, as both sides may come from the same rows
        left = left.select(*[F.col(c).alias(c) for c in left.columns])
        key = ["dim", "cell", "i", "j"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, schema)

    def asking(self, radius: float, homes: DataFrame | None = None) -> DataFrame:
        """Rows of homes with a radius, in their own cell (own) and in those with a lower number within the radius: so each pair meets in one cell."""
        rows = (self.homes if homes is None else homes).withColumns({"radius": F.lit(radius), "own": F.lit(True)})
        return rows.unionByName(self.visits(rows.withColumn("own", F.lit(False)), True)) if self.pivots else rows


def _slack(dim: int) -> float:
    """What rounding can add to a product of vectors of length 1 in single precision."""
    return SLACK + 1.2e-7 * (dim + 4)


def _tiles(homes: pa.Table, asking: pa.Table, radius: np.ndarray):
    """Products of homes and asking by tiles, in single precision: places of both and product; tiles whose distances to the pivot are too far apart are passed over."""
    if not homes.num_rows or not asking.num_rows:
        return
    dim = homes.column("dim")[0].as_py()
    x, y = _matrix(homes.column("v"), dim), _matrix(asking.column("v"), dim)
    near, far = homes.column("near").to_numpy(), asking.column("near").to_numpy()
    by_x, by_y = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    single = x[by_x].astype(np.float32)
    for j in range(0, len(by_y), TILE):
        cols = by_y[j : j + TILE]
        most = radius[cols].max() + SLACK
        asks = np.ascontiguousarray(y[cols].astype(np.float32).T)
        for i in range(0, len(by_x), TILE):
            rows = by_x[i : i + TILE]
            if near[rows[0]] - far[cols[-1]] <= most and far[cols[0]] - near[rows[-1]] <= most:
                yield rows, cols, single[i : i + TILE] @ asks, x, y


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added from first to last."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += a * b
    return total


def _dots(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_dot of rows a of x and b of y, of which only so many are copied at once."""
    if len(a) <= DOTS:
        return _dot(x[a], y[b])
    return np.concatenate([_dot(x[a[i : i + DOTS]], y[b[i : i + DOTS]]) for i in range(0, len(a), DOTS)])


def _best(group: np.ndarray, other: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k largest s, of equals the smallest other."""
    order = np.lexsort((other, -s, group))
    start = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if len(order) else order
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[nth < k]


def _pairs(homes: pa.Table, asking: pa.Table, threshold: float, once: bool = True, alike=None):
    """Places (a, b) of close pairs with whether b asks in its own cell, tile by tile; the similarity is worked out if asked for by the caller.

    A pair of one cell is met from both sides: with once it is given from one of
    them, else from both, but no vector with itself. alike(a, b) may rule pairs out first.
    """
    ids, others = homes.column("id").to_numpy(), asking.column("id").to_numpy()
    same = asking.column("own").to_numpy(zero_copy_only=False).astype(bool) if asking.num_rows else np.zeros(0, bool)
    radius = np.full(asking.num_rows, np.sqrt(max(0.0, 2 - 2 * threshold)))
    for rows, cols, s, x, y in _tiles(homes, asking, radius):
        slack = _slack(x.shape[1])
        r, c = np.nonzero(s >= threshold - slack)
        sure = s[r, c] >= threshold + slack
        a, b = rows[r], cols[c]
        some = ~same[b] | ((ids[a] < others[b]) if once else (ids[a] != others[b]))
        if alike is not None:
            some &= alike(a, b)
        a, b, sure = a[some], b[some], sure[some]
        near = np.flatnonzero(~sure)
        sure[near] = _dots(x, y, a[near], b[near]) >= threshold
        yield a[sure], b[sure], same, x, y


def _close(threshold: float, top_k: int | None, fields: list[str], sets: list[list[str]]):
    def close(homes: pa.Table, asking: pa.Table) -> pa.Table:
        ids, others = homes.column("id").to_numpy(), asking.column("id").to_numpy()
        codes = {f: _codes(homes.column(f), asking.column(f)) for f in fields}
        equal = lambda f, a, b: (codes[f][0][a] == codes[f][1][b]) & (codes[f][0][a] >= 0)

        def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.logical_or.reduce([np.logical_and.reduce([equal(f, a, b) for f in some]) for some in sets])

        def rows(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.Table:
            one, two = ids[a], others[b]
            low = one < two
            out = {"a": pa.array(np.where(low, one, two), homes.schema.field("id").type), "b": pa.array(np.where(low, two, one), homes.schema.field("id").type), "similarity": s}
            return pa.table(out | {f"{f}_same": pa.array(equal(f, a, b)) for f in fields})

        def found(most: float) -> Iterator[tuple[np.ndarray, ...]]:
            """The pairs of some tiles at a time, of one more once there are most."""
            some = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for a, b, _, x, y in _pairs(homes, asking, threshold, True, alike if sets else None):
                some.append((a, b, _dots(x, y, a, b)))
                if sum(len(z[0]) for z in some) >= most:
                    yield tuple(np.concatenate(z) for z in zip(*some, strict=True))
                    some = some[:1]
            yield tuple(np.concatenate(z) for z in zip(*some, strict=True))

        if top_k is None:
            return pa.concat_tables([rows(*z) for z in found(CHUNK)])
        a, b, s = next(found(np.inf))
        if len(a):
            # no pair is among either side's best overall that isn't here
            some = np.union1d(_best(a, others[b], s, top_k), _best(b, ids[a], s, top_k))
            a, b, s = a[some], b[some], s[some]
        return rows(a, b, s)

    return close


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of the values of several columns, equal ones for equal values; -1 for null."""
    joined = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    coded = joined.dictionary_encode() if len(joined) else pa.array([], columns[0].type).dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(c) for c in columns])
    return [numbers[e - len(c) : e] for e, c in zip(ends, columns, strict=True)]


def close_pairs(vectors: DataFrame, threshold: float, top_k: int | None = None, cell_rows: int = CELL_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All pairs (a, b, similarity), a < b, of vectors (id, v) of length 1 with an inner product of at least threshold; exact.

    Vectors meet in the cells around a sample of pivots. A vector asks in its own cell and in those with a lower
    number that lie within the threshold's distance of it, so each pair meets in one cell. How many
    cells that are depends on the data: where vectors form clusters it is few; where all distances are
    alike, as in noise of many dimensions, there are few cells, all of them are asked, and the work is that of all pairs,
    in matrix products of pieces: each vector is copied about as often as there are pieces.
    With top_k, pairs beyond the best top_k of both sides may be left out.

    ids are different and not null; vectors of different lengths are no pair.
    """
    return _joined_pairs(vectors, threshold, top_k, [], [], cell_rows, piece_bytes)


def alike_pairs(vectors: DataFrame, threshold: float, fields: list[str], sets: list[list[str]], cell_rows: int = CELL_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """close_pairs of vectors (id, v, fields...) that are equal in all fields of one of the sets, with <field>_same for each field; null equals nothing."""
    return _joined_pairs(vectors, threshold, None, fields, sets, cell_rows, piece_bytes)


def _joined_pairs(vectors: DataFrame, threshold: float, top_k: int | None, fields: list[str], sets: list[list[str]], cell_rows: int, piece_bytes: int) -> DataFrame:
    kind = dict(vectors.dtypes)["id"]
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = Cells(vectors.select("id", "v", *fields), radius, cell_rows, piece_bytes=piece_bytes, threshold=threshold)
    schema = f"a {kind}, b {kind}, similarity double" + "".join(f", `{f}_same` boolean" for f in fields)
    return cells.joined(cells.homes, cells.asking(radius), _close(threshold, top_k, fields, sets), schema)


def _weighed(threshold: float):
    """Weights of what is close to each vector, a row for each side of a pair of pieces."""

    def weighed(homes: pa.Table, asking: pa.Table) -> pa.Table:
        total = np.zeros(homes.num_rows, np.int64), np.zeros(asking.num_rows, np.int64)
        weight = homes.column("weight").to_numpy(), asking.column("weight").to_numpy()
        for a, b, same, *_ in _pairs(homes, asking, threshold, False):
            np.add.at(total[1], b, weight[0][a])
            other = ~same[b]
            np.add.at(total[0], a[other], weight[1][b[other]])
        return _of_sides(homes, asking, total, "n")

    return weighed


def _of_sides(homes: pa.Table, asking: pa.Table, values: tuple[np.ndarray, np.ndarray], name: str) -> pa.Table:
    found = [(t.column("id").filter(pa.array(v > 0)), v[v > 0]) for t, v in zip((homes, asking), values, strict=True)]
    return pa.table({"id": pa.chunked_array([c for ids, _ in found for c in ids.chunks], homes.schema.field("id").type), name: np.concatenate([v for _, v in found])})


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while (parent[r] != r).any():
        r = parent[r]
    parent[x] = r
    return r


def _forest(threshold: float):
    """Links (a, b) that connect what close pairs of two pieces connect, fewer than vectors."""

    def forest(homes: pa.Table, asking: pa.Table) -> pa.Table:
        n = homes.num_rows
        # a vector of a piece that is met by itself is on both sides, and linked by its id
        parent = np.arange(n + asking.num_rows)
        for a, b, *_ in _pairs(homes, asking, threshold, True):
            b = b + n
            while len(a):
                one, two = _roots(parent, a), _roots(parent, b)
                apart = one != two
                a, b, one, two = a[apart], b[apart], one[apart], two[apart]
                np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        every = np.arange(len(parent))
        root = _roots(parent, every)
        ids = pa.chunked_array([*homes.column("id").chunks, *asking.column("id").chunks], homes.schema.field("id").type)
        some = np.flatnonzero(root != every)
        return pa.table({"a": ids.take(pa.array(root[some])), "b": ids.take(pa.array(some))})

    return forest


def _least(threshold: float):
    """The least component of what is close to each of asking."""

    def least(homes: pa.Table, asking: pa.Table) -> pa.Table:
        kinds, code = np.unique(homes.column("component").to_numpy(), return_inverse=True)
        best = np.full(asking.num_rows, len(kinds))
        for a, b, *_ in _pairs(homes, asking, threshold, False):
            np.minimum.at(best, b, code[a])
        some = np.flatnonzero(best < len(kinds))
        return pa.table({"id": asking.column("id").take(pa.array(some)), "component": pa.array(kinds[best[some]], asking.schema.field("id").type)})

    return least


def dense_components(vectors: DataFrame, threshold: float, min_samples: int, connected, cell_rows: int = CELL_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, component) of vectors (id, v, weight) of length 1 by DBSCAN, weight being how many points one stands for; noise has no row.

    No pair is written: a first join adds up the weights of what is close to each, a
    second gives a forest of links between cores for each two pieces, which connected(links) makes (node, component) of,
    and a third the least component that is close to the others. Exact, as close_pairs is.
    """
    kind = dict(vectors.dtypes)["id"]
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = Cells(vectors.select("id", "v", F.col("weight").cast("long").alias("weight")), radius, cell_rows, piece_bytes=piece_bytes)
    close = cells.joined(cells.homes, cells.asking(radius), _weighed(threshold), f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))
    points = F.coalesce("n", F.lit(0)) + F.col("weight")
    rows = written(cells.homes.join(close, "id", "left").withColumn("core", (points >= min_samples) & (points > 1)))
    # nothing that has no others close to it is a border
    core, rest = rows.where("core").drop("core", "n"), rows.where("not core and n > 0").drop("core", "n")
    links = written(cells.joined(core, cells.asking(radius, core), _forest(threshold), f"a {kind}, b {kind}").where("a <> b").distinct())
    parts = connected(links).withColumnsRenamed({"node": "id"})
    parts = written(core.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    asks = rest.withColumns({"radius": F.lit(radius), "own": F.lit(True)})
    asks = asks.unionByName(cells.visits(asks, False)) if cells.pivots else asks
    border = cells.joined(core.join(parts, "id"), asks, _least(threshold), f"id {kind}, component {kind}").groupBy("id").agg(F.min("component").alias("component"))
    return parts.unionByName(border)


def _near(k: int):
    def near(homes: pa.Table, asking: pa.Table) -> pa.Table:
        ids, others = homes.column("id").to_numpy(), asking.column("id").to_numpy()
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        radius = asking.column("radius").to_numpy()
        # the kth best product of each so far; only what reaches it is worked out in double precision
        worst = asking.column("least").to_numpy().copy()
        found, open_, last = [none], [none], None

        def best(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, s = (np.concatenate(z) for z in zip(*some, strict=True))
            kept = _best(b, ids[a], s, k)
            return a[kept], b[kept], s[kept]

        for rows, cols, s, x, y in _tiles(homes, asking, radius):
            slack = _slack(x.shape[1])
            if last is None or last[0] != cols[0]:
                found.append(best(open_))
                open_, last = [none], cols
            least = (worst[cols] - slack).astype(np.float32)
            if np.isneginf(worst[cols]).any() or (worst[cols] <= -2).any():
                # one of the best k + 1 may be the vector itself
                least = np.maximum(least, np.partition(s, -k - 1, axis=0)[-k - 1] - np.float32(2 * slack)) if len(rows) > k else least
            r, c = np.nonzero(s >= least - np.float32(slack))
            a, b = rows[r], cols[c]
            other = ids[a] != others[b]
            a, b = a[other], b[other]
            open_.append((a, b, _dot(x[a], y[b])))
            if sum(len(o[0]) for o in open_) > 2 * k * len(cols):
                a, b, exact = best(open_)
                open_ = [(a, b, exact)]
                # of each that has k, the last one is its kth best
                ends = np.flatnonzero(np.append(b[1:] != b[:-1], True))
                full = np.diff(np.append(-1, ends)) == k
                worst[b[ends[full]]] = np.maximum(worst[b[ends[full]]], exact[ends[full]])
        a, b, s = best([best(open_), *found])
        return pa.table({"id": pa.array(others[b], asking.schema.field("id").type), "other": pa.array(ids[a], asking.schema.field("id").type), "similarity": s})

    return near


def nearest(vectors: DataFrame, k: int, cell_rows: int = CELL_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The k others of largest inner product for each of vectors (id, v) of length 1: id, rank, other, similarity; ties to the smaller id; exact.

    The kth best in a vector's own cell says how far others can be that are better,
    and it asks in those cells alone that lie within that distance.
    """
    kind = dict(vectors.dtypes)["id"]
    cells = Cells(vectors.select("id", "v"), None, cell_rows, piece_bytes=piece_bytes)
    schema = f"id {kind}, other {kind}, similarity double"
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    best = lambda df: df.withColumn("rank", nth).where(F.col("rank") <= k).select("id", "rank", "other", "similarity")
    here = written(best(cells.joined(cells.homes, cells.homes.withColumns({"radius": F.lit(2.0), "least": F.lit(-2.0)}), _near(k), schema)))
    if not cells.pivots:
        return here
    kth = here.where(F.col("rank") == k).select("id", F.col("similarity").alias("least"))
    rows = cells.homes.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    rows = written(rows.withColumn("radius", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")))))
    there = cells.joined(cells.homes, cells.visits(rows, False), _near(k), schema)
    return best(here.drop("rank").unionByName(there))
