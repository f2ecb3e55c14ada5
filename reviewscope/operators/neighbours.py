"""Exact k-nearest-neighbour vote inside each game, without comparing all pairs.

Equal feature vectors share their neighbours, so only distinct vectors are searched, each carrying
its first k rows.  A game of up to ONE_CELL distinct vectors compares them all, its queries shared out over
tasks.  A bigger game is cut into cells of about CELL vectors around pivot vectors, which are drawn by hash from its
distinct vectors, so cells follow the density.  As cells keep their size, a vector near the border of its cell looks into
as many others in a large game as in a small one.  A vector first finds k neighbours in its own cell; with that distance
as bound it visits only the cells that could hold something nearer:

    |q - s| >= (|q - p|^2 - |q - own|^2) / (2 |p - own|)   for every s in the cell of pivot p
    |q - s| >= |q - p| - radius(p)

Inside a cell the vectors lie in boxes of up to LEAF, and a query is compared with those boxes only that its bound reaches.
Nothing is cut off: a vector with few neighbours at hand has an infinite bound and visits all cells.  Cells with
a vector that misses a component find nothing and are not visited, nor does a game of one cell find anything then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewscope.config import CREDIBILITY, CredibilityThresholds
from reviewscope.operators import grouping
from reviewscope.session import stored

GAME = "game_id"
ONE_CELL = 32_768  # distinct vectors up to which a game is a single cell: comparing all is cheaper
SHARE = 4096  # vectors of a one-cell game that are searched in one task
CELL = 65_536  # vectors of a cell of a large game, about
CELLS = 64  # cells of a game that is cut, at least (or as many as the root of its vectors)
LEAF = 256  # vectors of a box inside a cell
HOPS = 3  # nearest boxes that a query looks into before all those in reach
CHUNK = 50_000  # vectors compared with a game's pivots in one task
TURN = 200_000  # vectors that visit a cell in the same task, about
DIGITS = 9  # distances equal to this many digits are ties, broken by review_id
SLACK = 1e-8

VECTOR = "game_id string, vec_id long, f array<double>, members array<struct<review_id:long, label:boolean>>"
PLACED = VECTOR + ", cell long, own double"
FOUND = "game_id string, vec_id long, dist double, review_id long, label boolean"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differences squared and added one dimension at a time: exact zeros for equal vectors."""
    total = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        step = a[:, d, None] - b[None, :, d]
        total += step * step
    return np.sqrt(total)


def _slabs(n: int, width: int) -> Iterator[slice]:
    size = max(1, 1_000_000 // max(width, 1))
    for i in range(0, n, size):
        yield slice(i, i + size)


def _nearest(queries: pd.DataFrame, points: pd.DataFrame, k: int, limit: np.ndarray | None) -> pd.DataFrame:
    """The k nearest member rows of `points` per query, in the order (distance, review_id)."""
    rows = [
        (m["review_id"], m["label"], i) for i, ms in enumerate(points["members"]) for m in ms
    ]
    rows.sort()
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    labels = np.array([r[1] for r in rows], dtype=bool)
    places = _matrix(points["f"])[[r[2] for r in rows]]
    asked, vec = _matrix(queries["f"]), queries["vec_id"].to_numpy()
    out = []
    point_norms = (places * places).sum(axis=1)
    reach = 1e-14 * point_norms.max() if len(ids) else 0.0
    for part in _slabs(len(asked), len(ids)):
        own = asked[part]
        norms = (own * own).sum(axis=1)
        # Squared distances by matrix product: fast, and off by no more than `slack`.
        rough = norms[:, None] + point_norms[None, :] - 2.0 * (own @ places.T)
        slack = 1e-14 * norms + reach
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(ids) > k else rough.max(axis=1)
        kth = np.sqrt(np.maximum(kth, 0.0) + slack)
        if limit is not None:
            kth = np.minimum(kth, limit[part])
        # Rows come out in the order of the queries, columns in the order of review_id.
        q, c = np.nonzero(rough <= ((kth + SLACK) ** 2 + slack)[:, None])
        step = own[q] - places[c]
        near = np.round(np.sqrt((step * step).sum(axis=1)), DIGITS)
        order = np.lexsort((c, near, q))
        q, c, near = q[order], c[order], near[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < k
        out.append(
            pd.DataFrame(
                {
                    "vec_id": vec[part][q[kept]],
                    "dist": near[kept],
                    "review_id": ids[c[kept]],
                    "label": labels[c[kept]],
                }
            )
        )
    return pd.concat(out) if out else pd.DataFrame([], columns=["vec_id", "dist", "review_id", "label"])


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _boxes(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places in which every box is a run, and the bounds of the runs."""
    order, edges, open_ = np.arange(len(places)), [0], [(0, len(places))]
    while open_:
        a, b = open_.pop()
        if b - a <= LEAF:
            edges.append(b)
            continue
        some = places[order[a:b]]
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(some[:, np.ptp(some, axis=0).argmax()], middle)]
        open_ += [(a + middle, b), (a, a + middle)]
    return order, np.array(edges)


def _search(asked: np.ndarray, places: np.ndarray, k: int, limit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place and rounded distance of all places as near as the k-th nearest one of a query, and within its limit."""
    if np.isnan(places).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    order, edges = _boxes(places)
    places = places[order]
    low, high = (least.reduceat(places, edges[:-1]) for least in (np.minimum, np.maximum))
    point_norms = (places * places).sum(axis=1)
    reach, out = 1e-14 * point_norms.max(), []
    for part in _slabs(len(asked), max(64, len(low) // 4)):
        own = asked[part]
        norms = (own * own).sum(axis=1)
        slack = 1e-14 * norms + reach
        box = np.zeros((len(low), len(own)))
        for d in range(own.shape[1]):
            gap = np.maximum(np.maximum(low[:, d, None] - own[None, :, d], own[None, :, d] - high[:, d, None]), 0.0)
            box += gap * gap
        np.sqrt(box, out=box)
        top = np.full((len(own), k), np.inf)
        kth = np.full(len(own), np.inf) if limit is None else limit[part].copy()
        pairs = []

        def look(rows: np.ndarray, leaf: int) -> None:
            a, b = edges[leaf], edges[leaf + 1]
            # Squared distances by matrix product: fast, and off by no more than `slack`.
            rough = norms[rows, None] + point_norms[None, a:b] - 2.0 * (own[rows] @ places[a:b].T)
            nearer = (rough <= ((kth[rows] + SLACK) ** 2 + slack[rows])[:, None]).any(axis=1)
            rows, rough = rows[nearer], rough[nearer]
            if not len(rows):
                return
            best = np.partition(np.concatenate([top[rows], rough], axis=1), k - 1, axis=1)[:, :k]
            top[rows] = best
            kth[rows] = np.minimum(kth[rows], np.sqrt(np.maximum(best[:, k - 1], 0.0) + slack[rows]))
            q, c = np.nonzero(rough <= ((kth[rows] + SLACK) ** 2 + slack[rows])[:, None])
            pairs.append((rows[q], c + a))

        for _ in range(min(HOPS, len(low))):
            first = box.argmin(axis=0)
            nearest = box[first, np.arange(len(own))]
            go = np.flatnonzero((nearest <= kth + SLACK) & (nearest < np.inf))
            go = go[np.argsort(first[go], kind="stable")]
            for rows in np.split(go, np.flatnonzero(np.diff(first[go])) + 1):
                if len(rows):
                    look(rows, first[rows[0]])
            box[first[go], go] = np.inf
        for leaf in range(len(low)):
            rows = np.flatnonzero((box[leaf] <= kth + SLACK) & (box[leaf] < np.inf))
            if len(rows):
                look(rows, leaf)
        if pairs:
            q, c = (np.concatenate(side) for side in zip(*pairs))
            step = own[q] - places[c]
            dist = np.sqrt((step * step).sum(axis=1))
            fine = dist <= kth[q] + SLACK
            out.append((q[fine] + part.start, order[c[fine]], np.round(dist[fine], DIGITS)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(side) for side in zip(*out))


def _found(game: str, queries: pa.Table, points: pa.Table, k: int, limit: np.ndarray | None) -> pa.Table:
    """The k nearest member rows of `points` per query, in the order (distance, review_id)."""
    if len(queries) and len(points):
        q, p, near = _search(_dense(queries["f"]), _dense(points["f"]), k, limit)
        members = points["members"].combine_chunks()
        flat, size = members.flatten(), pc.list_value_length(members).to_numpy()
        ids = flat.field("review_id").to_numpy()
        labels = pc.fill_null(flat.field("label"), False).to_numpy(zero_copy_only=False)
        times = size[p]
        at = np.repeat(np.cumsum(size)[p] - np.cumsum(times), times) + np.arange(times.sum())
        q, near = np.repeat(q, times), np.repeat(near, times)
        order = np.lexsort((labels[at], ids[at], near, q))
        q, near, at = q[order], near[order], at[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, near, at = q[kept], near[kept], at[kept]
        vec, ids, labels = queries["vec_id"].to_numpy()[q], ids[at], labels[at]
    else:
        vec, near, ids, labels = (np.zeros(0, dtype=t) for t in (np.int64, np.float64, np.int64, bool))
    names = pa.array([game] * len(vec), pa.string())
    return pa.table({"game_id": names, "vec_id": vec, "dist": near, "review_id": ids, "label": labels})


def _sorted_pivots(pivots: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    pivots = pivots.sort_by("pivot")
    return pivots, pivots["pivot"].to_numpy(), _dense(pivots["pf"])


def _place(key: tuple, vectors: pa.Table, pivots: pa.Table) -> pa.Table:
    """Nearest pivot of every vector of a chunk (the first in pivot order on ties)."""
    _, names, centre = _sorted_pivots(pivots)
    cell, own = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    if len(vectors):
        asked = _dense(vectors["f"])
        for part in _slabs(len(asked), len(centre)):
            dist = _distances(asked[part], centre)
            best = dist.argmin(axis=1)
            cell.append(names[best])
            own.append(dist[np.arange(len(best)), best])
    kept = vectors.select(["game_id", "vec_id", "f", "members"])
    return kept.append_column("cell", pa.array(np.concatenate(cell))).append_column("own", pa.array(np.concatenate(own)))


def _at_home(k: int):
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        return _found(key[0].as_py(), cell, cell, k, None)

    return run


def _in_one_cell(k: int):
    def run(key: tuple, asked: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        columns = ["game_id", "vec_id", "dist", "review_id", "label"]
        if not len(asked):
            return pd.DataFrame([], columns=columns)
        return _nearest(asked, points, k, None).assign(game_id=key[0])[columns]

    return run


def _visits(counted: bool):
    """The other cells each query of a chunk has to look into; `counted`: only how many queries look into each."""

    def run(key: tuple, queries: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots, names, centre = _sorted_pivots(pivots)
        radius = pivots["radius"].to_numpy()
        pairs = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        if len(queries) and len(pivots):
            asked, bound = _dense(queries["f"]), queries["bound"].to_numpy()
            home = np.searchsorted(names, queries["cell"].to_numpy())
            apart = _distances(centre, centre)
            for part in _slabs(len(asked), len(names)):
                to_pivot = _distances(asked[part], centre)
                mine = home[part]
                own = to_pivot[np.arange(len(mine)), mine][:, None]
                between = apart[mine]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(between > 0, (to_pivot**2 - own**2) / (2 * between), 0.0)
                least = np.maximum(plane, to_pivot - radius[None, :])
                go = least <= bound[part][:, None] + SLACK
                go[np.arange(len(mine)), mine] = False
                q, c = np.nonzero(go)
                pairs.append((q + part.start, c))
        q, c = (np.concatenate(side) for side in zip(*pairs))
        if counted:
            cells, n = np.unique(names[c], return_counts=True)
            return pa.table({"game_id": pa.array([key[0].as_py()] * len(cells), pa.string()), "cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})
        rows = queries.select(["game_id", "vec_id", "f", "bound"]).take(pa.array(q))
        return rows.append_column("cell", pa.array(names[c], pa.int64()))

    return run


def _abroad(k: int):
    def run(key: tuple, visitors: pa.Table, points: pa.Table) -> pa.Table:
        return _found(key[0].as_py(), visitors, points, k, visitors["bound"].to_numpy())

    return run


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per game and feature vector with its first k rows; vec_id is the first row's id."""
    first = grouping.first_n(rows, [GAME, "f"], [F.col("review_id")], k)
    return first.groupBy(GAME, "f").agg(
        F.min("review_id").alias("vec_id"),
        F.array_sort(F.collect_list(F.struct("review_id", "label"))).alias("members"),
    ).select(GAME, "vec_id", "f", "members")


def vector_votes(vectors: DataFrame, k: int, one_cell: int = ONE_CELL) -> DataFrame:
    """(game_id, vec_id, vote): share of true labels among the k nearest rows."""
    sizes = vectors.groupBy(GAME).agg(F.count("*").alias("m"), F.min("vec_id").alias("opening"))
    sized = grouping.join_small(vectors, sizes, [GAME])
    big = F.col("m") > one_cell
    small = sized.filter(~big).withColumn("shares", F.ceil(F.col("m") / SHARE))
    asked = small.select(*vectors.columns, F.pmod(F.hash("vec_id"), F.col("shares")).alias("share"))
    each_share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    by_share = [GAME, "share"]
    found = (
        asked.groupBy(*by_share)
        .cogroup(_renewed(small.select(*vectors.columns, each_share)).groupBy(*by_share))
        .applyInPandas(_in_one_cell(k), FOUND)
    )
    if sizes.filter(big).isEmpty():
        return _share(found)

    # Written once to the shared folder: the placement is read by four later steps.
    cells = F.ceil(F.greatest(F.col("m") / CELL, F.least(F.sqrt("m"), F.lit(CELLS))))
    drawn = F.pmod(F.xxhash64("vec_id"), F.col("m")) < cells
    large = sized.filter(big).withColumn("chunks", F.ceil(F.col("m") / CHUNK)).withColumn(
        "chunk", F.pmod(F.hash("vec_id"), F.col("chunks"))
    )
    pivots = large.filter(drawn | (F.col("vec_id") == F.col("opening"))).select(
        GAME, F.col("vec_id").alias("pivot"), F.col("f").alias("pf"), "chunks"
    )
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    by_chunk = [GAME, "chunk"]
    placed = (
        large.groupBy(*by_chunk)
        .cogroup(_renewed(pivots.select(GAME, "pivot", "pf", spread)).groupBy(*by_chunk))
        .applyInArrow(_place, PLACED)
    )
    placed = stored(placed, "placed")
    home = placed.groupBy(GAME, "cell").applyInArrow(_at_home(k), FOUND)
    home = stored(home, "home")
    bounds = home.groupBy(GAME, "vec_id").agg(F.max("dist").alias("kth"), F.count("*").alias("n"))
    far = F.lit(float("inf"))
    queries = placed.join(bounds, [GAME, "vec_id"]).select(
        GAME, "vec_id", "f", "cell", F.when(F.col("n") >= k, F.col("kth")).otherwise(far).alias("bound")
    )
    queries = grouping.join_small(queries, large.select(GAME, "chunks").distinct(), [GAME]).withColumn(
        "chunk", F.pmod(F.hash("vec_id"), F.col("chunks"))
    )
    queries = stored(queries, "asked")
    radii = placed.groupBy(GAME, F.col("cell").alias("pivot")).agg(F.max("own").alias("radius"))
    reach = stored(pivots.join(radii, [GAME, "pivot"]).select(GAME, "pivot", "pf", "radius", spread), "reach")

    def visits(counted: bool, schema: str) -> DataFrame:
        return (
            queries.groupBy(*by_chunk)
            .cogroup(_renewed(reach).groupBy(*by_chunk))
            .applyInArrow(_visits(counted), schema)
        )

    # A cell is sent to as many tasks as its visitors need, not to one for each chunk of the game.
    turns = visits(True, "game_id string, cell long, n long").groupBy(GAME, "cell").agg(F.ceil(F.sum("n") / TURN).alias("turns"))
    turns = stored(turns, "turns")
    went = grouping.join_small(visits(False, "game_id string, vec_id long, f array<double>, bound double, cell long"), turns, [GAME, "cell"])
    went = went.withColumn("turn", F.pmod(F.hash("vec_id"), F.col("turns"))).drop("turns")
    each_turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn")
    points = grouping.join_small(placed, turns, [GAME, "cell"]).select(GAME, "cell", "f", "members", each_turn)
    by_turn = [GAME, "cell", "turn"]
    away = went.groupBy(*by_turn).cogroup(_renewed(points).groupBy(*by_turn)).applyInArrow(_abroad(k), FOUND)
    best = grouping.first_n(
        home.unionByName(away), [GAME, "vec_id"], [F.col("dist"), F.col("review_id")], k
    ).select(*found.columns)
    return _share(found.unionByName(best))


def _share(found: DataFrame) -> DataFrame:
    return found.groupBy(GAME, "vec_id").agg(F.avg(F.col("label").cast("int")).alias("vote"))


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can meet one derived from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def knn_relabel(
    flagged: DataFrame,
    k: int = CREDIBILITY.neighbours,
    label: str = "is_fake",
    t: CredibilityThresholds = CREDIBILITY,
    one_cell: int = ONE_CELL,
) -> DataFrame:
    """Add knn_fake, the majority label of the k nearest rows (the row itself may be one of them),
    and set the label to old OR new.  Games up to the row gate keep their labels.

    Needs `features` on the rows.
    """
    large = flagged.groupBy(GAME).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > t.gate_rows)
    open_games = grouping.join_small(flagged, large, [GAME], "left_semi")
    # Written once: the rules behind the labels are costly and several steps read the vectors.
    rows = stored(open_games.select(GAME, "review_id", F.col("features").alias("f"), F.col(label).alias("label")), "vector-rows")
    vectors = stored(distinct_vectors(rows, k), "vectors")
    # Rows and vectors come from one written table, so their features are the same bits.
    members = rows.join(vectors.select(GAME, "f", "vec_id"), [GAME, "f"]).select(GAME, "review_id", "vec_id")
    votes = vector_votes(vectors, k, one_cell)
    # Back to the rows by id: computed doubles may differ in the last bit from one computation to the next.
    fake = votes.filter("vote > 0.5").select(GAME, "vec_id", F.lit(True).alias("knn_fake"))
    verdict = members.join(fake, [GAME, "vec_id"]).select(GAME, "review_id", "knn_fake").distinct()
    joined = flagged.join(verdict, [GAME, "review_id"], "left")
    return joined.withColumn("knn_fake", F.coalesce("knn_fake", F.lit(False))).withColumn(
        label, F.col(label) | F.col("knn_fake")
    )
