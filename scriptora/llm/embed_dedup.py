"""Embedding near-duplicates: exact cosine-threshold links by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scriptora.llm.common import materialise
from scriptora.llm.components import connected_components, forest

COSINE = 0.93
#: Vectors of one cell, whose tree one task builds; vectors of the sample that the upper levels come from; a leaf of a tree; children of a node above the cells.
CELL, SAMPLE, LEAF, FAN = 2048, 16_384, 256, 512
#: Cosines nearer to the threshold than CLOSE are taken again with more digits; less than TIE below it, the rounding of a double, they count as reaching it.
CLOSE, TIE = 1e-12, 2.3e-16
#: Trees of cells that a task keeps for the pairs that follow.
KEPT = 4
NODE = "id long, label string, width int, centre binary, radius double"


class CoverTree:
    """Nested levels with halving radii over unit vectors: a node's first child has its centre, and the lowest nodes are single points.

    Arrays hold each node's centre (a row of the points), covering radius (the
    true largest distance of its points), size and children. Nodes of up to
    `leaf` points have their points for children.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.centre, self.radius, self.size, self.children = [], [], [], []
        if len(points):
            self._build(leaf)
        self.centre, self.radius = np.array(self.centre, "i8"), np.array(self.radius, "f8")
        self.single = np.array(self.size, "i8") == 1

    def _node(self, centre: int, radius: float, size: int) -> int:
        for v, x in ((self.centre, centre), (self.radius, radius), (self.size, size), (self.children, np.zeros(0, "i8"))):
            v.append(x)
        return len(self.centre) - 1

    def _build(self, leaf: int) -> None:
        every = np.arange(len(self.points))
        gaps = _distance(self.points, self.points[:1])[:, 0]
        todo = [(self._node(0, float(gaps.max()), len(every)), every, 1.0)] if len(every) > 1 else []
        if not todo:
            self._node(0, 0.0, 1)
        while todo:
            node, rows, level = todo.pop()
            children = []
            if len(rows) <= leaf or self.radius[node] < 1e-7:
                first = rows == self.centre[node]
                children = [self._node(int(k), 0.0, 1) for k in np.concatenate([rows[first], rows[~first]])]
            else:
                while level >= self.radius[node]:
                    level /= 2
                pick, points = self.centre[node], self.points[rows]
                while len(rows):
                    gaps = _distance(points, self.points[pick][None])[:, 0]
                    near = gaps <= level
                    near |= rows == pick
                    own, far = rows[near], ~near
                    children.append(self._node(int(pick), float(gaps[near].max()) if len(own) > 1 else 0.0, len(own)))
                    if len(own) > 1:
                        todo.append((children[-1], own, level / 2))
                    rows, points = rows[far], points[far]
                    pick = rows[0] if len(rows) else 0
            self.children[node] = np.array(children, "i8")

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes one level down; single points stay."""
        single = self.single[nodes]
        return np.concatenate([nodes[single], *(self.children[k] for k in nodes[~single])])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def near_pairs(a: CoverTree, b: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of a, j of b) whose cosine is at least `cosine`; within one tree (a is b) each pair i < j once.

    Both trees are gone down together, a block of nodes against a block of
    nodes: pairs of nodes further apart than their covering radii and the
    threshold's distance allow are pruned, pairs of points are decided, and
    every other node goes on with those that are left beside it.
    """
    far, same = math.sqrt(2 - 2 * cosine) + 1e-6, a is b
    top = np.zeros(1, "i8")
    todo = [(a.below(top), b.below(top), same)] if len(a.points) and len(b.points) else []
    while todo:
        xs, ys, mirror = todo.pop()
        for lo in range(0, len(xs), 1024):
            own = xs[lo : lo + 1024]
            dots = a.points[a.centre[own]] @ b.points[b.centre[ys]].T
            close = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots)) <= far + a.radius[own][:, None] + b.radius[ys][None]
            if mirror:
                close &= np.arange(lo, lo + len(own))[:, None] <= np.arange(len(ys))[None]
            p, q = np.nonzero(close)
            decided = a.single[own[p]] & b.single[ys[q]]
            hit = decided & (dots[p, q] >= cosine - CLOSE)
            if mirror:
                hit &= p + lo != q
            edge = np.flatnonzero(hit & (dots[p, q] < cosine + CLOSE))
            hit[edge] = [_reaches(a.points[a.centre[own[p[k]]]], b.points[b.centre[ys[q[k]]]], cosine) for k in edge]
            i, j = a.centre[own[p[hit]]], b.centre[ys[q[hit]]]
            if len(i):
                yield (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)
            p, q = p[~decided], q[~decided]
            large = ~a.single[own[p]]
            for k, at in _grouped(p[large]):
                others = ys[q[large][at]]
                if mirror and (others == own[k]).any():
                    todo.append((a.children[own[k]], b.children[own[k]], True))
                    others = others[others != own[k]]
                if len(others):
                    todo.append((a.children[own[k]], b.below(others), False))
            for k, at in _grouped(q[~large]):
                todo.append((own[p[~large][at]], b.children[ys[k]], False))


def _reaches(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    return bool((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= np.longdouble(cosine) - TIE)


def _grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different value with the places where it is."""
    order = np.argsort(values, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
        if len(at):
            yield int(values[at[0]]), at


def unit_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, the unit vector as bytes (unit: eight bytes a component) and key, 128 bits of label and unit; both are null where a vector links with nothing."""

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("embedding").to_pylist():
                v = np.array([np.nan if c is None else c for c in x], "<f8") if x else np.zeros(1)
                top = np.abs(v).max(initial=0.0)
                out.append((v / top / np.linalg.norm(v / top)).astype("<f8").tobytes() if np.isfinite(top) and top > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    chosen = df.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return chosen.mapInArrow(scaled, "vec_id long, label string, unit binary").withColumn("unit", F.when(F.col("label").isNotNull(), F.col("unit"))).withColumn("key", _key())


def _key() -> Column:
    """What tells vectors of a label apart where they are joined without their components."""
    label = F.concat(F.octet_length("label").cast("string"), F.lit(":"), F.col("label")).cast("binary")
    return F.unhex(F.md5(F.concat(label, F.col("unit"))))


def _upper_levels(sample: pd.DataFrame, cells: dict[tuple, int]) -> dict[tuple, np.ndarray]:
    """Centres of the cells of each label and width: nets of the sample at halving radii, until there are as many as asked for."""
    out = {}
    for key, own in sample.groupby(["label", "width"]):
        points, want = np.frombuffer(b"".join(own["unit"]), "<f8").reshape(len(own), -1), cells.get(key, 1)
        level, centres = 2.0, [0]
        gaps = _distance(points, points[:1])[:, 0]
        while len(centres) < min(want, len(points)) and level > 1e-3:
            while gaps.max() > level and len(centres) < want:
                centres.append(int(np.argmax(gaps > level)))
                gaps = np.minimum(gaps, _distance(points, points[centres[-1]][None])[:, 0])
            level /= 2
        out[key] = points[centres]
    return out


def _nearest(frames: Iterator[pd.DataFrame], nets: dict[tuple, np.ndarray], vector: str, net: str) -> Iterator[pd.DataFrame]:
    """frames with the place of each vector's nearest centre in the net of its label and width; 0 where there is none."""
    for x in frames:
        x[net] = 0
        for key, rows in x.groupby(["label", "width"]).groups.items():
            if (c := nets.get(key)) is not None and len(c) > 1:
                points = np.frombuffer(b"".join(x.loc[rows, vector]), "<f8").reshape(len(rows), -1)
                x.loc[rows, net] = np.argmax(points @ c.T, axis=1)
        yield x


def _dealt(df: DataFrame, net: str, row: str, most: int) -> DataFrame:
    """df with chunk: the rows of one centre of a net, dealt by `row` where there are more than `most`. A group is of one label, width, net and chunk."""
    sizes = df.groupBy("label", "width", net).agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    return df.join(sizes, ["label", "width", net]).withColumn("chunk", F.pmod(F.xxhash64(row, F.lit(7)), F.col("chunks")).cast("int")).drop("chunks")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a written table with an id for each row, which no two rows share."""
    return materialise(df.select(F.monotonically_increasing_id().alias("id"), "*"), name)


def _level_up(nodes: DataFrame, nets: dict[tuple, np.ndarray], fan: int) -> DataFrame:
    """The level over nodes (NODE): nodes with the ids, centres and radii of at most about `fan` children near each other, and a covering radius."""

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        centres = np.frombuffer(b"".join(x["centre"]), "<f8").reshape(len(x), -1)
        radius = float((_distance(centres, centres[:1])[:, 0] + x["radius"].to_numpy()).max())
        return pd.DataFrame({"label": [x["label"].iloc[0]], "width": [x["width"].iloc[0]], "centre": [centres[0].tobytes()], "radius": [radius], "ids": [x["id"].to_numpy("<i8").tobytes()], "centres": [centres.tobytes()], "radii": [x["radius"].to_numpy("<f8").tobytes()]})

    found = nodes.mapInPandas(lambda frames: _nearest(frames, nets, "centre", "net"), NODE + ", net int")
    return _dealt(found, "net", "id", fan).groupBy("label", "width", "net", "chunk").applyInPandas(pack, NODE.partition(", ")[2] + ", ids binary, centres binary, radii binary")


def _level_down(pairs: DataFrame, level: DataFrame, cosine: float) -> DataFrame:
    """Pairs (id <= other) of children whose covering radii leave room for a link, of such pairs of nodes of a level."""
    far = math.sqrt(2 - 2 * cosine) + 1e-6
    held = level.select("id", "ids", "centres", "radii")
    second = level.select(F.col("id").alias("other"), F.col("ids").alias("ids2"), F.col("centres").alias("centres2"), F.col("radii").alias("radii2"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                ids, ids2 = (np.frombuffer(row[c], "<i8") for c in ("ids", "ids2"))
                a, b = (np.frombuffer(row[c], "<f8").reshape(len(n), -1) for c, n in (("centres", ids), ("centres2", ids2)))
                near = _distance(a, b) <= far + np.frombuffer(row["radii"], "<f8")[:, None] + np.frombuffer(row["radii2"], "<f8")[None]
                if row["id"] == row["other"]:
                    near &= ids[:, None] <= ids2[None]
                x, y = (n[at] for n, at in zip((ids, ids2), np.nonzero(near), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["id", "other"])

    return pairs.join(held, "id").join(second, "other").repartition("id", "other").mapInArrow(opened, "id long, other long")


def near_cells(cells: DataFrame, nets: dict[tuple, np.ndarray], cosine: float = COSINE, fan: int = FAN) -> DataFrame:
    """Pairs (id <= other, each cell with itself too) of cells (NODE, a written table) of a label between which links may be.

    Levels are put over the cells until each label and width has one node, and
    then gone down together: a pair of nodes that its covering radii rule out is
    never opened, so rows are made for the pairs that are left, not for all.
    nets holds centres, coarse ones first; a level uses the first of them. The
    driver holds a count for each label.
    """
    if fan < 8:
        raise ValueError("fan must be 8 at least, or levels do not shrink")
    nodes, levels = cells.selectExpr("id", "label", "width", "centre", "radius"), []
    while True:
        counts = {(r["label"], r["width"]): r["n"] for r in nodes.groupBy("label", "width").agg(F.count("*").alias("n")).collect()}
        if levels and max(counts.values(), default=0) <= 1:
            break
        coarse = {k: c[: -(-2 * counts[k] // fan)] for k, c in nets.items() if counts.get(k, 0) > fan}
        levels.append(_numbered(_level_up(nodes, coarse, fan), "level"))
        nodes = levels[-1].selectExpr("id", "label", "width", "centre", "radius")
    pairs = nodes.select("id", F.col("id").alias("other"))
    for level in reversed(levels):
        pairs = materialise(_level_down(pairs, level, cosine), "node-pairs")
    return pairs


def near_vectors(df: DataFrame, cosine: float = COSINE, cell: int = CELL, sample: int = SAMPLE, fan: int = FAN) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector (vec_id, embedding, label), links being cosine >= `cosine` within a label.

    The upper levels of each label's tree come from at most `sample` vectors;
    every vector goes to its nearest centre, and cells get at most about `cell`
    vectors, larger ones being dealt into several. Each cell has its true
    covering radius, so pruning pairs of cells is exact whatever the sample;
    levels of at most about `fan` children over the cells find the pairs.
    One task joins one pair of cells by dual traversal of their lower levels
    and emits link counts and a spanning forest, never the pairs. Equal vectors
    count once in the search. Vectors that are null, empty, zero or hold a null
    or non-finite component, and null labels, link with nothing, and vectors of
    different lengths don't link. Repeated rows are vectors of their own and
    link with each other. No rows give no rows.
    """
    spark = df.sparkSession
    own = materialise(unit_vectors(df), "units")
    fit = own.where("unit is not null")
    distinct = materialise(
        fit.groupBy("label", "unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("key").alias("key")).withColumn("rep", F.monotonically_increasing_id()).withColumn("width", F.octet_length("unit")), "distinct-vectors"
    )
    counts = {(r["label"], r["width"]): r["n"] for r in distinct.groupBy("label", "width").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # The sample's rows are those of the smallest hashes, about `sample` of them.
    low = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total))
    few = distinct.where(low).select("label", "width", "unit", "key").orderBy("key", "label").limit(2 * sample).toPandas()
    centres = _upper_levels(few, {k: -(-n // cell) * 2 for k, n in counts.items() if n > cell})

    placed = distinct.mapInPandas(lambda frames: _nearest(frames, centres, "unit", "cell"), StructType([*distinct.schema.fields, StructField("cell", IntegerType())]))
    placed = _dealt(materialise(placed, "cells"), "cell", "key", cell).select("label", "width", "cell", "chunk", "unit", "rep", "n")

    def bundle(x: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer(b"".join(x["unit"]), "<f8").reshape(len(x), -1)
        radius = float(_distance(points, points[:1]).max())
        return pd.DataFrame({"label": [x["label"].iloc[0]], "width": [x["width"].iloc[0]], "centre": [points[0].tobytes()], "radius": [radius], "units": [points.tobytes()], "reps": [x["rep"].to_numpy("<i8").tobytes()], "counts": [x["n"].to_numpy("<i8").tobytes()]})

    bundles = placed.groupBy("label", "width", "cell", "chunk").applyInPandas(bundle, "label string, width int, centre binary, radius double, units binary, reps binary, counts binary")
    bundles = _numbered(bundles, "bundles")

    pairs = near_cells(bundles, centres, cosine, fan)
    held = bundles.select("id", "units", "reps", "counts")
    second = held.select(F.col("id").alias("other"), F.col("units").alias("units2"), F.col("reps").alias("reps2"), F.col("counts").alias("counts2"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, CoverTree] = {}

        def tree(cell: int, units: bytes, points: int) -> CoverTree:
            found = trees.pop(cell, None) or CoverTree(np.frombuffer(units, "<f8").reshape(points, -1))
            trees[cell] = found
            if len(trees) > KEPT:
                del trees[next(iter(trees))]
            return found

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = row["id"] == row["other"]
                reps, n = np.frombuffer(row["reps"], "<i8"), np.frombuffer(row["counts"], "<i8")
                a = tree(row["id"], row["units"], len(reps))
                if same:
                    b, reps2, n2 = a, reps, n
                else:
                    reps2, n2 = np.frombuffer(row["reps2"], "<i8"), np.frombuffer(row["counts2"], "<i8")
                    b = tree(row["other"], row["units2"], len(reps2))
                more, more2, found = np.zeros(len(reps), "i8"), np.zeros(len(reps2), "i8"), []
                for i, j in near_pairs(a, b, cosine):
                    np.add.at(more, i, n2[j])
                    np.add.at(more if same else more2, j, n[i])
                    shift = 0 if same else len(reps)
                    found.append(np.stack([i, j + shift]))
                    if sum(f.shape[1] for f in found) > 1 << 20:
                        found = [_thin(found, len(reps) + (0 if same else len(reps2)))]
                both = reps if same else np.concatenate([reps, reps2])
                counted = more if same else np.concatenate([more, more2])
                member, root = _thin(found, len(both)) if found else (np.zeros(0, "i8"),) * 2
                some = counted > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[some], both[member]])), pa.array(np.concatenate([counted[some], np.zeros(len(member), "i8")])), pa.array(np.concatenate([both[some], both[root]]))], ["rep", "links", "to"])

    # A pair of a cell with itself ships it once; of the others the first cell is shipped with the pair, and pairs meet their second cell where that lies.
    alone = held.select("id", F.col("id").alias("other"), "units", "reps", "counts", *(F.lit(None).cast("binary").alias(f"{c}2") for c in ("units", "reps", "counts")))
    apart = pairs.where("id <> other").join(held, "id").join(second, "other").select(*alone.columns)
    found = materialise(alone.unionByName(apart).mapInArrow(joined, "rep long, links long, to long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = materialise(connected_components(found.where("rep <> to"), "rep", "to"), "vector-components")
    nodes = distinct.select("rep", "key", "least", "n").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rep").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    table = nodes.join(least, "root").select("key", (F.col("links") + F.col("n") - 1).alias("links"), "component_id")
    out = own.select("vec_id", "key").join(table, "key", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _thin(found: list[np.ndarray], n: int) -> np.ndarray:
    both = np.concatenate(found, axis=1)
    return np.stack(forest(n, both[0], both[1]))
