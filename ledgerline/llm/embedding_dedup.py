"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them, one vector per group."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import connected_components, local_components
from ledgerline.llm.texts import attach
from ledgerline.sources.shared import written

CELL = 256
BLOCK = 512
MOST_CELLS = 4096
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20
#: Of a calibrated margin: standard deviations that it covers, rows compared with each other, and pairs that tell.
DEVIATIONS = 3.5
PAIRED_ROWS = 4096
TOLD_SHARE = 0.999


def unit_rows(vectors) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest part first, so nothing over- or underflows."""
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _recentred(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """One round: the direction of the mean of each cell; a cell that loses all its rows stays as it is."""
    home = np.concatenate([(rows[at : at + 2048] @ centroids.T).argmax(axis=1) for at in range(0, len(rows), 2048)])
    sums = np.zeros_like(centroids)
    np.add.at(sums, home, rows)
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)


def spherical_kmeans(rows: np.ndarray, cells: int, closest: float = 1.0, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Unit centroids, of which no two have a cosine of ``closest`` or more before the last round.

    Near copies in great number draw many first centroids; one of them is kept, so such a group is one cell
    (worked in blocks) and not many cells that all probe each other.
    """
    centroids = rows[np.random.default_rng(seed).choice(len(rows), cells, replace=False)].copy()
    for _ in range(rounds):
        centroids = _recentred(rows, centroids)
    kept = np.zeros(len(centroids), bool)
    for at in range(len(centroids)):
        kept[at] = not (centroids[kept] @ centroids[at] >= closest).any()
    return _recentred(rows, centroids[kept])


def _usable(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _classes(vectors: DataFrame) -> DataFrame:
    """node (the smallest vec_id), vector and copies of every different vector."""
    return vectors.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))


def _fit(classes: DataFrame, count: int, cell: int, sample_rows: int, closest: float, exact: bool) -> tuple[np.ndarray, float]:
    """Centroids, and the share of the margin to probe, from a sample of the classes by a hash of their id.

    The sample has ``sample_rows`` rows or SAMPLE_BYTES at most.
    """
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    rows = max(1, min(sample_rows, SAMPLE_BYTES // (8 * width)))
    sample = classes.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(rows).toPandas()
    drawn = unit_rows(sample["vector"])
    centroids = spherical_kmeans(drawn, max(1, min(-(-count // cell), MOST_CELLS, -(-len(drawn) // 4))), closest)
    return centroids, 1.0 if exact else calibrated_share(drawn, centroids, closest)


def calibrated_share(rows: np.ndarray, centroids: np.ndarray, least_cosine: float) -> float:
    """Which share of the whole margin (see ``probed_cells``) finds nearly all partners of vectors like ``rows``.

    Partners differ in some direction, of which only the part along the line between two centroids matters. In n
    effective dimensions (of the rows' covariance) that part is about 1 / sqrt(n) of the whole, so DEVIATIONS / sqrt(n)
    of the margin is enough. Linked pairs among the first PAIRED_ROWS rows that need more raise it to what TOLD_SHARE of them need.
    """
    spread = np.linalg.eigvalsh(np.cov(rows.T)) if len(rows) > 1 and rows.shape[1] > 1 else np.ones(1)
    dimensions = spread.sum() ** 2 / max((spread**2).sum(), 1e-300)
    share = min(1.0, DEVIATIONS / np.sqrt(max(1.0, dimensions)))
    drawn = rows[:PAIRED_ROWS]
    left, right = np.nonzero(np.triu(drawn @ drawn.T >= least_cosine, 1))
    if not len(left):
        return share
    reach = np.sqrt(max(1e-300, (1 - least_cosine) / 2))
    home = np.concatenate([(drawn[at : at + 2048] @ centroids.T).argmax(axis=1) for at in range(0, len(drawn), 2048)])
    needed = np.zeros(len(left))
    for at in range(0, len(left), 4096):
        a, b = left[at : at + 4096], right[at : at + 4096]
        line = centroids[home[a]] - centroids[home[b]]
        apart = np.maximum(np.linalg.norm(line, axis=1), 1e-300)
        nearest = np.minimum((drawn[a] * line).sum(axis=1), -(drawn[b] * line).sum(axis=1))
        needed[at : at + 4096] = np.where(home[a] == home[b], 0, nearest / apart / reach)
    return float(min(1.0, max(share, np.quantile(needed, TOLD_SHARE))))


def probed_cells(rows: np.ndarray, centroids: np.ndarray, least_cosine: float, share: float = 1.0) -> tuple[list[np.ndarray], np.ndarray]:
    """(cells, cosine to the home centroid) of unit rows: the home cell first, then every cell that may hold a partner.

    Two rows of different homes lie on either side of the plane midway between the two centroids, so the
    angle between them is at least the sum of their angles to that plane. If they are linked, one of them is within
    half the angle of ``least_cosine`` of the plane. Each row probes the cells it is so near to, hence every linked
    pair meets, whatever the number of cells. A ``share`` below 1 narrows that margin.
    """
    reach = share * np.sqrt(max(0.0, (1 - least_cosine) / 2))
    cells, nearest = [], []
    for at in range(0, len(rows), 512):
        near = rows[at : at + 512] @ centroids.T
        home = near.argmax(axis=1)
        top = near[np.arange(len(near)), home]
        apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[home] @ centroids.T)))
        probed = top[:, None] - near <= reach * apart + 1e-7
        probed[np.arange(len(near)), home] = False
        cells += [np.concatenate([[h], np.nonzero(p)[0]]).astype(np.int32) for h, p in zip(home, probed)]
        nearest.append(top)
    return cells, np.concatenate([*nearest, np.zeros(0)])


def _assigned(classes: DataFrame, shared, least_cosine: float, share: float) -> DataFrame:
    """``classes`` with their probed cells (the first is the vector's home), and ``core``.

    A vector is core if its angle to its home centroid is at most half the angle of ``least_cosine``: any two
    core vectors of a cell are then linked for certain. The tiny margin keeps rounding out of that.
    """
    half = np.sqrt((1 + least_cosine) / 2) + 1e-9

    def assign(batches):
        for batch in batches:
            if len(batch):
                cells, nearest = probed_cells(unit_rows(batch["vector"]), shared.value, least_cosine, share)
                yield batch.assign(cells=cells, core=nearest >= half)

    return classes.mapInPandas(assign, "vector array<double>, node long, copies long, cells array<int>, core boolean")


def _dealt(assigned: DataFrame, size: int, number_type: str) -> DataFrame:
    """The rows of every product: cell, x and y name it, ``side`` is 0 for its block x and 1 for its block y.

    A cell's rows are split, by a hash of the node, into blocks of about ``size`` rows, numbered through: loose home
    rows, core home rows, and guests, which only probe the cell. Loose blocks meet all blocks, core blocks meet
    guests, and core blocks need not meet each other, so a dense group of copies costs no more than its
    few loose rows and guests times its size. What the driver learns is three counts per cell. Vectors travel as
    ``number_type``, the type they came in.
    """
    spark = assigned.sparkSession
    spread = assigned.select("core", F.posexplode("cells").alias("rank", "cell"))
    home = F.col("rank") == 0
    sizes = spread.groupBy("cell").agg(
        F.count_if(home & ~F.col("core")).alias("loose"), F.count_if(home & F.col("core")).alias("core"), F.count_if(~home).alias("guests")
    )
    counts = {r["cell"]: tuple(-(-r[kind] // size) for kind in ("loose", "core", "guests")) for r in sizes.collect()}
    blocks = spark.sparkContext.broadcast(counts)

    def meetings(number, rank, core, draw):
        loose, cores, guests = blocks.value[number]
        visitors = range(loose + cores, loose + cores + guests)
        if rank:
            own = loose + cores + draw % guests
            return [(number, o, own, 1) for o in range(loose + cores)]
        if core:
            own = loose + draw % cores
            return [(number, o, own, 1) for o in range(loose)] + [(number, own, o, 0) for o in visitors]
        own = draw % loose
        met = [(number, min(own, o), max(own, o), int(o < own)) for o in range(loose)]
        return met + [(number, own, o, 0) for o in [*range(loose, loose + cores), *visitors]]

    def part(batch, own, products, told):
        names = pd.DataFrame(products, columns=["cell", "x", "y", "side"])
        return pd.concat([names, batch.iloc[own].reset_index(drop=True)], axis=1).assign(cells=told)

    def deal(batches):
        for batch in batches:
            own, products, told = [], [], []
            draws = pd.util.hash_array(batch["node"].to_numpy(np.int64))
            core = batch["core"].to_numpy()
            every = batch["cells"].to_numpy()
            batch = batch.drop(columns=["core", "cells"])
            for at, (cells, draw) in enumerate(zip(every, draws.tolist())):
                for rank, number in enumerate(cells):
                    met = meetings(number, rank, core[at], draw)
                    own.extend([at] * len(met))
                    products.extend(met)
                    told.extend([cells[:1] if rank else cells] * len(met))  # of a guest, only its home is asked
                    if len(own) >= 4096:
                        yield part(batch, own, products, told)
                        own, products, told = [], [], []
            if own:
                yield part(batch, own, products, told)

    shape = f"cell int, x int, y int, side int, vector array<{number_type}>, node long, copies long, cells array<int>"
    return assigned.mapInPandas(deal, shape)


def _core_links(assigned: DataFrame) -> DataFrame:
    """The links among the core rows of each cell, without comparing them: a star and the counts."""
    core = assigned.where("core").select(F.element_at("cells", 1).alias("home"), "node", "copies")
    whole = core.groupBy("home").agg(F.min("node").alias("least"), F.sum("copies").alias("all_copies"))
    known = core.join(F.broadcast(whole), "home")  # MOST_CELLS rows at most
    none = F.lit(None).cast("long")
    star = known.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"), none.alias("copies"))
    counts = known.select(F.col("node").alias("a"), none.alias("b"), (F.col("all_copies") - F.col("copies")).alias("copies"))
    return star.unionAll(counts.where("copies > 0"))


def _compare(least_cosine: float):
    """The links inside one product: (a, b, null) stars that connect the same nodes, (a, null, linked copies)."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        cell, x, y = rows["cell"].iat[0], rows["x"].iat[0], rows["y"].iat[0]
        left = rows[rows["side"] == 0]
        right = left if x == y else rows[rows["side"] == 1]
        nothing = pd.DataFrame({"a": [], "b": [], "copies": []}).astype("Int64")
        if not len(left) or not len(right):
            return nothing
        near = unit_rows(left["vector"]) @ unit_rows(right["vector"]).T >= least_cosine
        if x == y:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        # a home row and a guest meet a second time in the guest's home if the first probes it: the lower cell counts
        homes = np.array([c[0] for c in right["cells"]])[j]
        probed = [right_home in left_cells for left_cells, right_home in zip(left["cells"].to_numpy()[i], homes)]
        once = ~(np.array(probed, bool) & (homes < cell))
        i, j = i[once], j[once]
        if not len(i):
            return nothing
        a, b = left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)
        linked = [
            (a, np.bincount(i, right["copies"].to_numpy(np.float64)[j], len(a))),
            (b, np.bincount(j, left["copies"].to_numpy(np.float64)[i], len(b))),
        ]
        nodes, roots = local_components(a[i], b[j])
        star = pd.DataFrame({"a": nodes, "b": roots}).query("a != b")
        counts = [pd.DataFrame({"a": n[c > 0], "copies": c[c > 0]}) for n, c in linked]
        return pd.concat([star, *counts])[["a", "b", "copies"]].astype("Int64")

    return compare


def near_duplicates(
    vectors: DataFrame,
    least_cosine: float = 0.9,
    cell: int = CELL,
    block: int = BLOCK,
    sample_rows: int = SAMPLE_ROWS,
    exact: bool = True,
) -> DataFrame:
    """vec_id, n_links, component_id (long) and kept (boolean): one row per row of ``vectors`` (vec_id, embedding).

    Two rows are linked if the cosine of their vectors, in double precision, is ``least_cosine`` or more: the
    index puts every vector into the cell of its nearest centroid and compares it with the members of
    every cell that may hold a partner (see ``probed_cells``), so all such pairs are found and no others. Unless ``exact``,
    cells are probed within a share of that margin that is calibrated on the sample (see ``calibrated_share``): a
    few of the pairs near the bound may be missed, and far fewer cells are probed. Centroids are fitted on a sample of at most ``sample_rows`` rows (fewer
    if they exceed SAMPLE_BYTES), one per ``cell`` vectors, at most MOST_CELLS, and merged where they are
    near copies themselves. A larger cell is compared in blocks of ``block`` rows. Vectors so near their centroid that
    they must be linked with each other are counted and not compared; the rest of a cell costs its size times the cell's.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest vec_id reachable, ``kept`` says
    that it is the row's own. Equal vectors are compared once and count as linked copies, repeated rows of one
    vec_id too. Null, zero and non-finite vectors, and rows without vec_id, are linked with nothing. A shorter
    vector is compared as if it ended in zeros. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    usable = rows.where(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    width = usable.agg(F.max(F.size("vector"))).first()[0]
    alone = F.col("vec_id").isNull() | ~_usable(F.col("vector"))
    single = rows.where(alone).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if width is None:
        return single.withColumn("kept", F.lit(True))
    padded = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector")))
    usable = usable.select("vec_id", F.when(F.size("vector") < width, padded).otherwise(F.col("vector")).alias("vector"))
    classes = written(_classes(usable), "vectors")
    centroids, share = _fit(classes, classes.count(), cell, sample_rows, least_cosine, exact)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS vectors at most
    assigned = written(_assigned(classes, shared, least_cosine, share), "assigned")
    number_type = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    products = _dealt(assigned, block, number_type).groupBy("cell", "x", "y")
    compared = products.applyInPandas(_compare(least_cosine), "a long, b long, copies long")
    found = written(compared.unionAll(_core_links(assigned)), "cosines")
    links = found.where("b is not null").groupBy("a", "b").agg(F.lit(1).alias("one"))
    components = connected_components(links.select("a", "b")).withColumnRenamed("component", "component_id")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("linked"))
    judged = attach(attach(classes, counts, ["node"]), components, ["node"]).select(
        "vector",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "node").alias("component_id"),
    )
    joined = usable.join(judged, "vector").select("vec_id", "n_links", "component_id")
    return joined.unionAll(single).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
