"""DBSCAN (X03) on tables of any size: zones, boxes and dual refinement.

Equal points become one weighted point.  A k-d tree over a bounded sample cuts space into zones of about equal numbers of
points (at most ``MOST_ZONES``, so their boxes fit everywhere); a task cuts its zone into boxes of at most ``leaf``
points.  Nothing compares all pairs of a dense region:

* **core test**: a box no wider than eps that holds ``min_samples`` points is core as a whole; points of other boxes are sent to the
  zones within eps of them, where whole boxes count at once and only boxes cut by the sphere are measured;
* **links inside a zone**: boxes whose largest distance is at most eps are linked unmeasured, and a pair of boxes is only measured
  if nothing has linked it yet.  What is linked becomes one unit;
* **links between zones**: both zone trees are split together; zones farther apart than eps are dropped, those within eps as a
  whole are linked, and only the rest send the points near the other zone, which are measured there;
* units and links are a graph whose connected components (by Spark joins) are the clusters;
* points that are not core look for core points in the zones within eps: each has fewer than ``min_samples`` neighbours.

Boxes of wide points overlap nearly all others.  From ``WIDE`` columns on, points meet all near boxes at once by a matrix product, and
pairs that its rounding leaves open are measured as narrow ones are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.components import connected_components
from tessera.functions.ranking import cumulative
from tessera.session import cut_lineage, ship_package

ZONE = 20_000
MOST_ZONES = 16_384
SAMPLE = 32
LEAF = 64
WIDE = 8
#: points of a zone that meet its others in one matrix product
ROWS = 256
NOISE = -1

_LEAVES = "zone int, leaf int, sure boolean, pid array<long>, w array<long>, x array<double>"


# k-d tree

def _halves(x: np.ndarray) -> tuple[int, float] | None:
    """Widest dimension and a cut that leaves points on both sides; None if all points are equal."""
    wide = x.max(axis=0) - x.min(axis=0)
    d = int(wide.argmax())
    if not wide[d] > 0:
        return None
    cut = float(np.median(x[:, d]))
    return d, cut if (x[:, d] > cut).any() else float(np.nextafter(x[:, d].max(), -np.inf))


class Zones:
    """Cuts of space by a k-d tree over sample points: ``find`` gives the zone of each point."""

    def __init__(self, sample: np.ndarray, zones: int):
        self.dim, self.cut, self.child, self.count = [], [], [], 0
        room = max(1, len(sample) // max(zones, 1))
        self._grow(sample, room)

    def _grow(self, sample: np.ndarray, room: int) -> None:
        open_ = [(sample, None, 0)]
        while open_:
            x, parent, side = open_.pop()
            split = _halves(x) if len(x) > room else None
            if split is None:
                place, self.count = -1 - self.count, self.count + 1
            else:
                place = len(self.dim)
                self.dim.append(split[0])
                self.cut.append(split[1])
                self.child.append([0, 0])
                left = x[:, split[0]] <= split[1]
                open_ += [(x[~left], place, 1), (x[left], place, 0)]
            if parent is not None:
                self.child[parent][side] = place

    def find(self, x: np.ndarray) -> np.ndarray:
        if not self.dim:
            return np.zeros(len(x), np.int32)
        dim, cut, child = np.array(self.dim), np.array(self.cut), np.array(self.child)
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = at >= 0
            if not inner.any():
                return (-1 - at).astype(np.int32)
            node = at[inner]
            at[inner] = child[node, (x[row[inner], dim[node]] > cut[node]).astype(int)]


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the boxes of at most ``most`` (distinct) points."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        split = _halves(x[rows]) if len(rows) > most else None
        if split is None:
            done.append(rows)
        else:
            left = x[rows, split[0]] <= split[1]
            open_ += [rows[left], rows[~left]]
    return done


# squared distances

def _nearest2(lo, hi, lo2, hi2) -> np.ndarray:
    """Least squared distance of each box (or point) of the first kind to each of the second."""
    out = np.zeros((len(lo), len(lo2)))
    for d in range(lo.shape[1]):
        gap = np.maximum(lo2[None, :, d] - hi[:, None, d], lo[:, None, d] - hi2[None, :, d])
        out += np.square(np.maximum(gap, 0))
    return out


def _farthest2(lo, hi, lo2, hi2) -> np.ndarray:
    out = np.zeros((len(lo), len(lo2)))
    for d in range(lo.shape[1]):
        out += np.square(np.maximum(hi2[None, :, d] - lo[:, None, d], hi[:, None, d] - lo2[None, :, d]))
    return out


def _points2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += np.square(a[:, None, d] - b[None, :, d])
    return out


def _within(a: np.ndarray, b: np.ndarray, e2: float) -> np.ndarray:
    """``_points2(a, b) <= e2``.  Wide points by a matrix product; pairs within its rounding of ``e2`` are measured."""
    width = a.shape[1]
    if width < WIDE:
        return _points2(a, b) <= e2
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d2 = a @ b.T
    d2 *= -2
    d2 += a2[:, None]
    d2 += b2[None, :]
    most = float(a2.max(initial=0)) + float(b2.max(initial=0)) + e2
    slack = 16 * (width + 8) * np.finfo(float).eps * most
    near = d2 <= e2 - slack
    i, j = np.nonzero(~(near | (d2 > e2 + slack)))  # also where the product is not a number
    for lo in range(0, len(i), 65_536):
        p, q = i[lo:lo + 65_536], j[lo:lo + 65_536]
        exact = np.zeros(len(p))
        for d in range(width):
            exact += np.square(a[p, d] - b[q, d])
        near[p, q] = exact <= e2
    return near


def _diagonal2(x: np.ndarray) -> float:
    return float(np.square(x.max(axis=0) - x.min(axis=0)).sum()) if len(x) else 0.0


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def _joined(x: np.ndarray, e2: float) -> np.ndarray:
    """The first point of each point's chain of neighbours: ``ROWS`` points meet all later ones at a time."""
    tree = _Union(len(x))
    root = tree.up.copy()
    for lo in range(0, len(x), ROWS):
        near = _within(x[lo:lo + ROWS], x[lo:], e2)
        later = root[lo:]
        own = root[lo:lo + ROWS]
        for u in np.unique(own):
            for v in np.unique(later[near[own == u].any(axis=0)]):
                tree.join(int(u), int(v))
        root = tree.roots()
    return root


class _Boxes:
    """Rows of the table of leaves: their points one after the other, and their boxes."""

    def __init__(self, rows: list[dict], width: int):
        self.rows = [r for r in rows if len(r["pid"])]
        self.size = np.array([len(r["pid"]) for r in self.rows], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        join = lambda c, kind: np.concatenate([np.asarray(r[c], kind) for r in self.rows]) if self.rows else np.zeros(0, kind)
        self.pid, self.x = join("pid", np.int64), join("x", np.float64).reshape(-1, width)
        self.w = join("w", np.int64) if self.rows and self.rows[0].get("w") is not None else None
        self.unit = join("unit", np.int64) if self.rows and self.rows[0].get("unit") is not None else None
        if self.rows:
            self.lo, self.hi = (f.reduceat(self.x, self.start[:-1], axis=0) for f in (np.minimum, np.maximum))
        else:
            self.lo = self.hi = np.zeros((0, width))
        self._named = None

    def part(self, i: int) -> slice:
        return slice(self.start[i], self.start[i + 1])

    def rows_of(self, boxes: np.ndarray) -> np.ndarray | slice:
        """Places of the points of ``boxes`` (rising)."""
        if len(boxes) == len(self.rows):
            return slice(None)
        return np.concatenate([np.arange(self.start[i], self.start[i + 1]) for i in boxes]) if len(boxes) else np.zeros(0, np.int64)

    def named(self) -> tuple[np.ndarray, np.ndarray]:
        """The units, rising, and for each point the place of its own."""
        if self._named is None:
            self._named = np.unique(self.unit, return_inverse=True)
        return self._named


def _zone_boxes(leaves: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zone numbers and their boxes from a table with zone and x (flat, with width): at most ``MOST_ZONES`` rows."""
    width = F.col("width")
    each = F.sequence(F.lit(0), width - 1)
    own = lambda d: F.filter("x", lambda v, i: F.pmod(i, width) == d)
    flat = leaves.where(F.size("x") > 0).select("zone", F.posexplode(F.transform(each, lambda d: F.struct(
        F.array_min(own(d)).alias("lo"), F.array_max(own(d)).alias("hi")))).alias("d", "s"))
    boxes = flat.groupBy("zone", "d").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi")).groupBy("zone").agg(
        F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("b"))
    found = sorted(boxes.select("zone", "b.lo", "b.hi").collect())
    return (np.array([r["zone"] for r in found], np.int64), np.array([r["lo"] for r in found], float).reshape(-1, dims),
            np.array([r["hi"] for r in found], float).reshape(-1, dims))


# stages

def _cut(points: DataFrame, zones: Zones, width: int, eps: float, min_samples: int, leaf: int, parts: int) -> DataFrame:
    """The table of leaves (see ``_LEAVES``; x is flat) of all points."""
    def assign(batches):
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(zones.find(x)), *b.columns], names=["zone", "pid", "w", "x"])

    def build(batches):
        held = [(np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)),
                 np.asarray(b.column(3).flatten()).reshape(-1, width)) for b in batches]
        if not held:
            return
        zone, pid, w, x = (np.concatenate(c) for c in zip(*held, strict=True))
        for z in np.unique(zone):
            own = np.flatnonzero(zone == z)
            out = []
            for i, rows in enumerate(_leaves(x[own], leaf)):
                rows = own[rows]
                sure = _diagonal2(x[rows]) <= eps * eps and int(w[rows].sum()) >= min_samples
                out.append({"zone": int(z), "leaf": i, "sure": sure, "pid": pid[rows], "w": w[rows], "x": x[rows].ravel()})
            yield pa.RecordBatch.from_pylist(out, _schema(_LEAVES))

    zoned = points.select("pid", "w", "x").mapInArrow(assign, "zone int, pid long, w long, x array<double>")
    return zoned.repartition(parts, "zone").mapInArrow(build, _LEAVES)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = []
    for name, kind in (c.split() for c in ddl.split(", ")):
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


def _near(rows: DataFrame, boxes, width: int, eps: float, pairs=None) -> DataFrame:
    """The points of ``rows`` (zone, leaf, pid, x and, if it has them, unit) once for each zone whose box is within eps of them:
    zone, from_zone, leaf, pid, x, unit.  ``pairs``: only those zones, by the zone of the row."""
    ids, lo, hi = boxes
    place = {int(z): i for i, z in enumerate(ids)}
    schema = "zone int, from_zone int, leaf int, pid array<long>, x array<double>, unit array<long>"

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                x = np.asarray(r["x"], float).reshape(-1, width)
                if not len(x):
                    continue
                at = np.arange(len(ids)) if pairs is None else np.array([place[z] for z in pairs.value.get(r["zone"], ())], int)
                box = _nearest2(x.min(axis=0)[None], x.max(axis=0)[None], lo[at], hi[at])[0] <= eps * eps
                at = at[box]
                if not len(at):
                    continue
                near = _nearest2(x, x, lo[at], hi[at]) <= eps * eps
                pid = np.asarray(r["pid"], np.int64)
                unit = None if r.get("unit") is None else np.asarray(r["unit"], np.int64)
                for j in np.flatnonzero(near.any(axis=0)):
                    own = near[:, j]
                    out.append({"zone": int(ids[at[j]]), "from_zone": r["zone"], "leaf": r["leaf"], "pid": pid[own],
                                "x": x[own].ravel(), "unit": None if unit is None else unit[own]})
                if len(out) > 2_000:
                    yield pa.RecordBatch.from_pylist(out, _schema(schema))
                    out = []
            yield pa.RecordBatch.from_pylist(out, _schema(schema))

    return rows.mapInArrow(run, schema)


def _meet(leaves: DataFrame, sent: DataFrame, width: int, parts: int, fn, schema: str) -> DataFrame:
    """Rows that ``fn(boxes of a zone, sent row)`` yields for every row sent to the zone.  A zone's own leaves come first and are
    held, what is sent to it streams past."""
    columns = {"w": "array<long>", "unit": "array<long>"}
    own = leaves.select("zone", F.lit(0).alias("kind"), F.lit(0).alias("from_zone"), "leaf", "pid", "x", *(
        F.col(c) if c in leaves.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
    come = sent.select("zone", F.lit(1).alias("kind"), "from_zone", "leaf", "pid", "x", F.lit(None).cast("array<long>").alias("w"), "unit")

    def run(batches):
        zone, held, boxes, out = None, [], None, []
        for b in batches:
            for r in b.to_pylist():
                if r["zone"] != zone:
                    zone, held, boxes = r["zone"], [], None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if boxes is None:
                    boxes, held = _Boxes(held, width), []
                out.extend(fn(boxes, r))
                if len(out) > 5_000:
                    yield pa.RecordBatch.from_pylist(out, _schema(schema))
                    out = []
        yield pa.RecordBatch.from_pylist(out, _schema(schema))

    return own.unionByName(come).repartition(parts, "zone").sortWithinPartitions("zone", "kind").mapInArrow(run, schema)


def _counter(eps: float, width: int):
    """Neighbours of the sent points in the zone, whole boxes at once."""
    def wide(boxes: _Boxes, r: dict, x: np.ndarray):
        lo, hi = x.min(axis=0)[None], x.max(axis=0)[None]
        near = _nearest2(lo, hi, boxes.lo, boxes.hi)[0] <= eps * eps
        whole = near & (_farthest2(lo, hi, boxes.lo, boxes.hi)[0] <= eps * eps)
        rows = boxes.rows_of(np.flatnonzero(near & ~whole))
        n = _within(x, boxes.x[rows], eps * eps) @ boxes.w[rows] + boxes.w[boxes.rows_of(np.flatnonzero(whole))].sum()
        for p, c in zip(r["pid"], n, strict=True):
            if c:
                yield {"zone": r["from_zone"], "leaf": r["leaf"], "pid": p, "n": int(c)}

    def count(boxes: _Boxes, r: dict):
        x = np.asarray(r["x"], float).reshape(-1, width)
        if width >= WIDE:
            yield from wide(boxes, r, x)
            return
        near = _nearest2(x, x, boxes.lo, boxes.hi) <= eps * eps
        whole = near & (_farthest2(x, x, boxes.lo, boxes.hi) <= eps * eps)
        weight = np.add.reduceat(boxes.w, boxes.start[:-1]) if len(boxes.rows) else np.zeros(0, np.int64)
        n = whole @ weight
        cut = near & ~whole
        for i in np.flatnonzero(cut.any(axis=0)):
            rows = np.flatnonzero(cut[:, i])
            n[rows] += (_points2(x[rows], boxes.x[boxes.part(i)]) <= eps * eps) @ boxes.w[boxes.part(i)]
        for p, c in zip(r["pid"], n, strict=True):
            if c:
                yield {"zone": r["from_zone"], "leaf": r["leaf"], "pid": p, "n": int(c)}
    return count


def _linker(eps: float, width: int):
    """Pairs of units of the sent (core) points and the zone's."""
    def link(boxes: _Boxes, r: dict):
        x, unit = np.asarray(r["x"], float).reshape(-1, width), np.asarray(r["unit"], np.int64)
        close = np.flatnonzero(_nearest2(x.min(axis=0)[None], x.max(axis=0)[None], boxes.lo, boxes.hi)[0] <= eps * eps)
        found = set()
        if width >= WIDE:
            rows = boxes.rows_of(close)
            names, at = boxes.named()
            near = _within(x, boxes.x[rows], eps * eps)
            for u in np.unique(unit):
                found |= {(int(u), int(v)) for v in names[np.unique(at[rows][near[unit == u].any(axis=0)])]}
            close = ()
        for i in close:
            part = boxes.part(i)
            mine, theirs = set(unit.tolist()), set(boxes.unit[part].tolist())
            if len(mine) * len(theirs) <= 64 and all((a, b) in found for a in mine for b in theirs):
                continue
            a, b = np.nonzero(_points2(x, boxes.x[part]) <= eps * eps)
            found |= set(zip(unit[a].tolist(), boxes.unit[part][b].tolist(), strict=True))
        for a, b in found:
            yield {"a": a, "b": b}
    return link


def _border(eps: float, width: int):
    """Units whose core points lie within eps of the sent points."""
    def look(boxes: _Boxes, r: dict):
        x = np.asarray(r["x"], float).reshape(-1, width)
        if width >= WIDE:
            rows = boxes.rows_of(np.flatnonzero(_nearest2(x.min(axis=0)[None], x.max(axis=0)[None], boxes.lo, boxes.hi)[0] <= eps * eps))
            names, at = boxes.named()
            for p, near in zip(r["pid"], _within(x, boxes.x[rows], eps * eps), strict=True):
                for u in names[np.unique(at[rows][near])]:
                    yield {"pid": p, "unit": int(u)}
            return
        near = _nearest2(x, x, boxes.lo, boxes.hi) <= eps * eps
        found = set()
        for i in np.flatnonzero(near.any(axis=0)):
            rows = np.flatnonzero(near[:, i])
            a, b = np.nonzero(_points2(x[rows], boxes.x[boxes.part(i)]) <= eps * eps)
            found |= set(zip((int(r["pid"][j]) for j in rows[a]), boxes.unit[boxes.part(i)][b].tolist(), strict=True))
        for p, u in found:
            yield {"pid": p, "unit": u}
    return look


def _chained(near: np.ndarray) -> np.ndarray:
    """The first point of each point's chain, from the matrix of neighbours of a few points."""
    own = np.arange(len(near))
    while True:
        least = np.where(near, own[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == own).all():
            return own
        own = least


def _linked(boxes: _Boxes, e2: float) -> np.ndarray:
    """The first point of each point's chain of neighbours.  Boxes that are neighbours as a whole are linked first, each pair by one
    step; only pairs that these links leave apart are measured, and linked once for each pair of units."""
    tree = _Union(len(boxes.pid))
    n, first = len(boxes.rows), boxes.start[:-1]
    tight = np.zeros(n, bool)  # one unit inside

    def tighten(i):
        if not tight[i]:
            for p in range(boxes.start[i] + 1, boxes.start[i + 1]):
                tree.join(int(first[i]), p)
            tight[i] = True

    def ends(i):  # the units of a box's points, as linked so far
        if tight[i]:
            return np.full(boxes.size[i], tree.find(int(first[i])))
        return np.array([tree.find(p) for p in range(boxes.start[i], boxes.start[i + 1])])

    def pairs(i):  # one row of box pairs at a time
        later, own = slice(i + 1, n), slice(i, i + 1)
        near = _nearest2(boxes.lo[own], boxes.hi[own], boxes.lo[later], boxes.hi[later])[0] <= e2
        return near, _farthest2(boxes.lo[own], boxes.hi[own], boxes.lo[later], boxes.hi[later])[0] <= e2

    for i in range(n):
        part = boxes.part(i)
        if _diagonal2(boxes.x[part]) <= e2:
            tighten(i)
        else:
            for p, q in enumerate(_chained(_points2(boxes.x[part], boxes.x[part]) <= e2)):
                if p != q:
                    tree.join(int(first[i] + p), int(first[i] + q))
    for i in range(n):
        near, whole = pairs(i)
        for j in np.flatnonzero(near & whole) + i + 1:  # every point of both is a neighbour of every other's
            tighten(i)
            tighten(j)
            tree.join(int(first[i]), int(first[j]))
    for i in range(n):
        near, whole = pairs(i)
        for j in np.flatnonzero(near & ~whole) + i + 1:
            if tight[i] and tight[j] and tree.find(int(first[i])) == tree.find(int(first[j])):
                continue
            a, b = ends(i), ends(j)
            if (a == a[0]).all() and (b == a[0]).all():
                continue
            p, q = np.nonzero(_points2(boxes.x[boxes.part(i)], boxes.x[boxes.part(j)]) <= e2)
            for u, v in set(zip(a[p].tolist(), b[q].tolist(), strict=True)):
                tree.join(u, v)
    return tree.roots()


def _units(core: DataFrame, width: int, eps: float, parts: int) -> DataFrame:
    """zone, leaf, pid, x and unit (smallest point linked inside the zone) of the core points."""
    schema = "zone int, leaf int, pid array<long>, x array<double>, unit array<long>"
    e2 = eps * eps

    def solve(rows: list[dict]):
        boxes = _Boxes(rows, width)
        if not boxes.rows:
            return
        if width >= WIDE:
            yield from named(boxes, _joined(boxes.x, e2))
            return
        yield from named(boxes, _linked(boxes, e2))

    def named(boxes: _Boxes, root: np.ndarray):
        least = np.full(len(root), np.iinfo(np.int64).max)
        np.minimum.at(least, root, boxes.pid)
        unit = least[root]
        for i, r in enumerate(boxes.rows):
            part = boxes.part(i)
            yield {"zone": r["zone"], "leaf": r["leaf"], "pid": boxes.pid[part], "x": boxes.x[part].ravel(), "unit": unit[part]}

    def run(batches):
        zone, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["zone"] != zone and held:
                    yield pa.RecordBatch.from_pylist(list(solve(held)), _schema(schema))
                    held = []
                zone = r["zone"]
                held.append(r)
        yield pa.RecordBatch.from_pylist(list(solve(held)), _schema(schema))

    return core.select("zone", "leaf", "pid", "x").repartition(parts, "zone").sortWithinPartitions("zone").mapInArrow(run, schema)


def zone_links(boxes, eps: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Zones linked as a whole, and pairs of zones that need their points: both from the zones' boxes alone.

    Zones are grouped by halving until a group is no wider than eps: the members of a group are linked, and pairs of
    groups are split together until the boxes decide.  A pair of groups that has one whole link needs no other."""
    ids, lo, hi = boxes
    e2 = eps * eps
    if not len(ids):
        return [], []
    links, open_pairs, groups = [], [], []
    todo = [np.arange(len(ids))]
    while todo:
        rows = todo.pop()
        if len(rows) == 1 or np.square(hi[rows].max(axis=0) - lo[rows].min(axis=0)).sum() <= e2:
            groups.append(rows)
            links += [(int(ids[rows[0]]), int(ids[r])) for r in rows[1:]]
            continue
        todo += _half(rows, lo, hi)
    glo = np.array([lo[g].min(axis=0) for g in groups]).reshape(len(groups), -1)
    ghi = np.array([hi[g].max(axis=0) for g in groups]).reshape(len(groups), -1)
    for i in range(len(groups)):
        near = np.flatnonzero(_nearest2(glo[i:i + 1], ghi[i:i + 1], glo[i + 1:], ghi[i + 1:])[0] <= e2) + i + 1
        for j in near:
            linked, undecided = _dual(groups[i], groups[int(j)], lo, hi, e2)
            if linked is not None:
                links.append((int(ids[linked[0]]), int(ids[linked[1]])))
            else:
                open_pairs += [(int(ids[a]), int(ids[b])) for a, b in undecided]
    return links, open_pairs


def _half(rows, lo, hi):
    middle = (lo[rows] + hi[rows]) / 2
    d = int((middle.max(axis=0) - middle.min(axis=0)).argmax())
    order = rows[np.argsort(middle[:, d], kind="stable")]
    return [order[:len(order) // 2], order[len(order) // 2:]]


def _dual(a, b, lo, hi, e2):
    """A pair of zones of both groups that is within eps as a whole, or all pairs that the boxes leave open."""
    undecided, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        box = [(lo[g].min(axis=0)[None], hi[g].max(axis=0)[None]) for g in (a, b)]
        if _nearest2(*box[0], *box[1])[0, 0] > e2:
            continue
        if _farthest2(*box[0], *box[1])[0, 0] <= e2:
            return (a[0], b[0]), []
        if len(a) == 1 and len(b) == 1:
            undecided.append((a[0], b[0]))
        elif len(a) >= len(b):
            todo += [(h, b) for h in _half(a, lo, hi)]
        else:
            todo += [(a, h) for h in _half(b, lo, hi)]
    return None, undecided


def dbscan(df: DataFrame, key: str, features: str, eps: float, min_samples: int = 5, zone: int = ZONE, leaf: int = LEAF) -> DataFrame:
    """key, cluster (long) and core (boolean) of every row: Euclidean DBSCAN on the array or vector column ``features``.

    A row is core if ``min_samples`` rows, itself included, lie within ``eps``.  Clusters are numbered from 0 by their smallest core key; a
    row near core rows of several clusters goes to the first of them, and one near none is noise (-1).  Vectors that are null, of
    different widths or hold anything but finite numbers are an error; encode a table with ``exploration.as_vectors`` first.
    The result does not depend on the sample, the zones or the partitions."""
    if not (eps > 0 and math.isfinite(eps)) or min_samples < 1:
        raise ValueError("eps is a positive number and min_samples 1 or more")
    ship_package(df.sparkSession)
    x = F.col(features) if dict(df.dtypes)[features].startswith("array") else vector_to_array(features)
    rows = cut_lineage(df.select(F.col(key).alias("key"), x.cast("array<double>").alias("x")))
    odd = F.col("x").isNull() | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"),
                    F.count_if(odd).alias("odd")).first()
    empty = rows.select(F.col("key").alias(key), F.lit(NOISE).cast("long").alias("cluster"), F.lit(False).alias("core"))
    if not seen["n"]:
        return empty
    if seen["odd"] or seen["least"] != seen["most"] or not seen["most"]:
        raise ValueError(f"{seen['odd']} of {seen['n']} vectors hold missing or infinite numbers; widths {seen['least']} to {seen['most']}")
    width = seen["most"]
    same = rows.groupBy("x").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("w")).withColumn("one", F.lit(1).cast("long"))
    points = cut_lineage(cumulative(same, [], ["key", "x"], weight="one", before="pid").select("pid", "w", "x"))
    n = points.count()
    zones = -(-n // zone)
    if width >= WIDE:  # boxes spare wide points little: at least a zone for every core that has ROWS points to work on
        zones = max(zones, min(-(-n // ROWS), df.sparkSession.sparkContext.defaultParallelism))
    zones = min(MOST_ZONES, zones)
    sample = np.zeros((0, width))
    if zones > 1:
        part = points.select("x") if n <= SAMPLE * zones else points.select("x").sample(False, SAMPLE * zones / n, 42)
        sample = np.array([r["x"] for r in part.limit(2 * SAMPLE * zones).collect()], float).reshape(-1, width)  # bounded
    spark = df.sparkSession
    cuts = Zones(sample, zones)
    parts = max(1, min(cuts.count, 4 * spark.sparkContext.defaultParallelism), cuts.count // 2)
    leaf = max(leaf, 2 * min_samples)
    leaves = cut_lineage(_cut(points, cuts, width, eps, min_samples, leaf, parts).withColumn("width", F.lit(width)))

    # core points
    unsure = leaves.where("not sure").select("zone", "leaf", "pid", "x", F.lit(None).cast("array<long>").alias("unit"))
    sent = _near(unsure, _zone_boxes(leaves, width), width, eps)
    met = _meet(leaves, sent, width, parts, _counter(eps, width), "zone int, leaf int, pid long, n long")
    many = met.groupBy("zone", "leaf", "pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
    many = many.groupBy("zone", "leaf").agg(F.collect_set("pid").alias("many"))  # at most a leaf's points
    marked = leaves.join(many, ["zone", "leaf"], "left").withColumn("core", F.transform("pid", lambda p: F.col("sure") | F.coalesce(
        F.array_contains("many", p), F.lit(False))))
    marked = cut_lineage(marked.drop("many", "sure", "w"))

    def where(flag):
        own = F.filter("pid", lambda p, i: F.get("core", i) == flag)
        values = F.filter("x", lambda v, i: F.get("core", F.call_function("div", i, F.col("width")).cast("int")) == flag)
        return marked.select("zone", "leaf", "width", own.alias("pid"), values.alias("x")).where(F.size("pid") > 0)

    core = where(True)
    units = cut_lineage(_units(core, width, eps, parts))
    boxes = _zone_boxes(units.withColumn("width", F.lit(width)), width)
    links, open_pairs = zone_links(boxes, eps)

    # links between zones: zones linked as a whole stand as nodes below zero
    asked: dict[int, list[int]] = {}
    for a, b in open_pairs:
        asked.setdefault(a, []).append(b)
    wanted = spark.sparkContext.broadcast(asked)
    sent = _near(units, boxes, width, eps, pairs=wanted)
    edges = _meet(units, sent, width, parts, _linker(eps, width), "a long, b long").distinct()
    belongs = units.select("zone", F.explode("unit").alias("a")).distinct()
    if links:
        whole = spark.createDataFrame([(-1 - a, -1 - b) for a, b in links], "a long, b long")
        in_zone = belongs.join(F.broadcast(spark.createDataFrame(sorted({(z,) for link in links for z in link}), "zone int")), "zone")
        edges = edges.unionByName(whole).unionByName(in_zone.select("a", (F.lit(-1) - F.col("zone")).cast("long").alias("b")))
    edges = cut_lineage(edges)
    nodes = belongs.select(F.col("a").alias("node")).union(edges.select("a")).union(edges.select("b")).distinct()
    found = cut_lineage(connected_components(edges, nodes).where("node >= 0").withColumnRenamed("node", "unit"))
    firsts = found.groupBy("root").agg(F.min("unit").alias("first")).withColumn("one", F.lit(1).cast("long"))
    numbers = cumulative(firsts, [], ["first"], weight="one", before="cluster").select("root", "cluster")
    labels = cut_lineage(found.join(numbers, "root").select("unit", "cluster"))

    # border points
    sent = _near(where(False).withColumn("unit", F.lit(None).cast("array<long>")).drop("width"), boxes, width, eps)
    near = _meet(units, sent, width, parts, _border(eps, width), "pid long, unit long").distinct()
    border = near.join(labels, "unit").groupBy("pid").agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False))
    inner = units.select(F.inline(F.arrays_zip("pid", "unit"))).join(labels, "unit").select("pid", "cluster", F.lit(True).alias("core"))
    decided = points.select("pid", "x").join(inner.unionByName(border), "pid", "left")
    out = rows.join(decided.select("x", "cluster", "core"), "x", "left")
    return out.select(F.col("key").alias(key), F.coalesce("cluster", F.lit(NOISE).cast("long")).alias("cluster"),
                      F.coalesce("core", F.lit(False)).alias("core"))
