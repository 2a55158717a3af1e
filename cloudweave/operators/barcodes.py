"""Cross-barcodes of pairs, and the scalars that sum them up.

A bar row is (pair keys, direction, hom_dim, birth, death). Direction qc keeps the query's distances and sets the
class's to 0; cq the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.functions import kernels
from cloudweave.functions import loops as loops_

LIMIT = 1e6
REPS = ("mtd", "total_persistence", "pers_entropy", "landscape_l2", "betti_0", "betti_1", "betti_2")


def _clouds(column: pa.Array) -> list[np.ndarray]:
    """Each row's points as a matrix, views of the batch's one buffer; a null row has no points."""
    inner = column.flatten()
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.concatenate(([0], np.cumsum(sizes)))
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(inner).to_numpy(zero_copy_only=False))))
    return [flat[at[i] : at[j]].reshape(j - i, -1) if j > i else np.zeros((0, 1)) for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


_BARS = "array<struct<direction:string,hom_dim:int,birth:double,death:double>>"
_DIRECTIONS = ("qc", "cq")
#: Kept clouds whose own part a task holds, latest first.
HELD = 16


class _Bars:
    """Bars of pairs, gathered for one batch; what a kept cloud needs alone is made once and held for the next pairs."""

    def __init__(self, loops: bool):
        self.loops = loops
        self.made: dict[bytes, loops_.Kept | np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.counts: list[int] = []
        self.columns: tuple[list, list, list, list] = ([], [], [], [])

    def _alone(self, kept: np.ndarray) -> loops_.Kept | np.ndarray:
        key = kept.tobytes()
        found = self.made.pop(key, None)
        if found is None:
            found = loops_.Kept(kept) if self.loops else kernels.kept_tree(kept)
            if len(self.made) >= HELD:
                self.made.pop(next(iter(self.made)))
        self.made[key] = found
        return found

    def add(self, a: np.ndarray, b: np.ndarray, directions: tuple[str, ...] = _DIRECTIONS) -> None:
        """The pair of a query's cloud and a class's. A pair without points on a side has no bars."""
        total = 0
        for code, kept, other in ((0, a, b), (1, b, a)):
            if not len(kept) or not len(other) or _DIRECTIONS[code] not in directions:
                continue
            alone = self._alone(kept)
            h0 = kernels.cross_h0(alone.tree if self.loops else alone, kept, other)
            found = [(0, np.zeros(len(h0)), h0)]
            if self.loops:
                found.append((1, *loops_.cross_h1(alone, other).T))
            for dim, birth, death in found:
                total += len(birth)
                for column, values in zip(self.columns, (np.full(len(birth), code, np.int8), np.full(len(birth), dim, np.int32), birth, death), strict=True):
                    column.append(values)
        self.counts.append(total)

    def take(self) -> pa.Array:
        """The bars of all pairs added since the last call, a list for each."""
        codes, dims, births, deaths = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(self.columns, (np.int8, np.int32, float, float), strict=True))
        names = pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(_DIRECTIONS)).cast(pa.string())
        bars = pa.StructArray.from_arrays([names, pa.array(dims), pa.array(births), pa.array(deaths)], ["direction", "hom_dim", "birth", "death"])
        out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(self.counts))).astype(np.int32)), bars)
        self.clear()
        return out


def _shape(table: DataFrame, keys: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def _dealt(table: DataFrame, *keys: str) -> DataFrame:
    """Dealt evenly by a count, which adaptive execution keeps: the rows' bytes say little about their work."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cross_barcodes(pairs: DataFrame, keys: list[str], loops: bool = False) -> DataFrame:
    """keys, bars: for each pair row (points, class_points) its nested bars of both directions.

    bars is array<struct<direction, hom_dim, birth, death>>; H0, and with loops H1, are exact for clouds of any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = _Bars(loops)
        for batch in batches:
            for a, b in zip(_clouds(batch.column("points")), _clouds(batch.column("class_points")), strict=True):
                bars.add(a, b)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), bars.take()], names=[*keys, "bars"])

    return _dealt(pairs.select(*keys, "points", "class_points"), *keys).mapInArrow(run, f"{_shape(pairs, keys)}bars {_BARS}")


def class_barcodes(series: DataFrame, keys: list[str], classes: dict[int, list], loops: bool = False, directions: tuple[str, ...] = _DIRECTIONS) -> DataFrame:
    """keys, class_label, bars: each row's cloud (points) with every class in its array wanted.

    classes are the class clouds, of bounded number and size, which go with the tasks; so a row travels once whatever the number of classes.
    own (null: the class's) takes the place of the cloud of the class in the column label.
    """
    held = {c: np.array(p, float).reshape(len(p), -1) for c, p in classes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars = _Bars(loops)
        for batch in batches:
            # A few rows at a time: each may have a cloud of its own and meet many classes.
            for part in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                rows, labels = [], []
                clouds = zip(_clouds(part.column("points")), _clouds(part.column("own")), part.column("own").is_valid().to_pylist(), part.column("label").to_pylist(), part.column("wanted").to_pylist(), strict=True)
                for k, (a, own, has_own, label, wanted) in enumerate(clouds):
                    for c in wanted:
                        bars.add(a, own if has_own and c == label else held.get(c, a[:0]), directions)
                        rows.append(k)
                        labels.append(c)
                taken = part.select(keys).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(k) for k in keys), pa.array(labels, pa.int32()), bars.take()], names=[*keys, "class_label", "bars"])

    dealt = _dealt(series.select(*dict.fromkeys([*keys, "label"]), "points", "own", "wanted"), *keys)
    return dealt.mapInArrow(run, f"{_shape(series, keys)}class_label int, bars {_BARS}")


#: Distances that a task holds at once; clouds of their own whose trees are made at once.
DISTANCES, TREES = 1 << 21, 16
_MEASURES = ("mtd", "total_persistence", "pers_entropy", "landscape_l2")
_MEASURED = f"direction string, hom_dim int, base int, gone array<double>, life array<double>, {', '.join(f'{m} double' for m in _MEASURES)}"


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values in runs of counts, some of which may be empty."""
    out, some = np.zeros(len(counts)), counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _measure(raw: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lifetimes (see lifetimes()), and _MEASURES, of bars' lengths in runs of counts."""
    with np.errstate(all="ignore"):
        clip = lambda x: np.where(np.isfinite(x), np.clip(x, -LIMIT, LIMIT), LIMIT)
        life, odd = raw, ~np.isfinite(raw)
        if odd.any():
            row, most = np.repeat(np.arange(len(counts)), counts), np.full(len(counts), -np.inf)
            np.maximum.at(most, row[~odd], raw[~odd])
            life = np.where(odd, np.where(np.isfinite(most), most, 0.0)[row], raw)
        life = np.clip(life, 0.0, LIMIT)
        total = _sums(life, counts)
        parts = _sums(life * np.log2(np.where(life > 0, life, 1.0)), counts)
        entropy = np.where(total > 0, np.log2(np.where(total > 0, total, 1.0)) - parts / np.where(total > 0, total, 1.0), 0.0)
        return life, [clip(_sums(raw, counts)), clip(_sums(raw * raw, counts)), entropy, np.sqrt(_sums(life * life, counts))]


class ClassTrees:
    """Clouds of classes with their trees, and the lengths of these that are bars where no other cloud comes near."""

    def __init__(self, classes: dict[int, list]):
        self.clouds = {c: np.array(p, float).reshape(len(p), -1) for c, p in classes.items() if len(p)}
        self.trees = {c: kernels.kept_tree(x) for c, x in self.clouds.items()}
        lengths = {c: np.array(t[2], float) for c, t in self.trees.items()}
        self.bases = {c: x[x > 0] for c, x in lengths.items() if np.isfinite(x).all() and (x <= LIMIT).all()}

    def cross(self, c: int, rows: list[np.ndarray], directions: tuple[str, ...]) -> tuple[list, list]:
        """Of rows, none empty, with the class's cloud: how far each of a row's points is from it, and (lengths, those of the tree that are not among them, those that are new)."""
        cloud, stars, kept = self.clouds[c], [], []
        lengths = np.array([*self.trees[c][2], 0.0])
        step = max(1, DISTANCES // max(1, len(cloud) * max(len(a) for a in rows)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            apart, at = kernels.distances(np.concatenate(part), cloud), np.cumsum([0, *map(len, part)])
            stars += np.split(apart.min(1), at[1:-1])
            if "cq" in directions:
                bars = np.ascontiguousarray(kernels.cross_many(self.trees[c], np.ascontiguousarray(np.minimum.reduceat(apart, at[:-1], axis=0).T)).T)
                changed = bars != lengths
                for b, k in zip(bars, changed, strict=True):
                    new, gone = b[k], lengths[k]
                    kept.append((b[b > 0], gone[gone > 0], new[new > 0]))
        return stars, kept


def class_measures(series: DataFrame, keys: list[str], trees: ClassTrees, directions: tuple[str, ...] = _DIRECTIONS) -> DataFrame:
    """keys, class_label, direction, hom_dim (0), base, gone, life, _MEASURES: what scalars() needs of class_barcodes(), a row for each slot of a pair.

    Bars are not listed, and their lengths are summed up where they are made. Most of a class cloud's are its own tree's, whatever the series: base is
    the class whose trees.bases count among the lifetimes, but for those in gone; life are the others.
    """

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        points, own, has_own = _clouds(part.column("points")), _clouds(part.column("own")), part.column("own").is_valid().to_pylist()
        labels, wanted = part.column("label").to_pylist(), part.column("wanted").to_pylist()
        none = np.zeros(0)
        found: dict[tuple[int, int, str], tuple] = {}
        stars: dict[int, list[tuple[int, np.ndarray]]] = {}
        for c in trees.clouds:
            rows = [k for k in range(len(points)) if c in wanted[k] and len(points[k]) and not (has_own[k] and labels[k] == c)]
            near, kept = trees.cross(c, [points[k] for k in rows], directions) if rows else ([], [])
            for k, star in zip(rows, near, strict=True):
                stars.setdefault(k, []).append((c, star))
            for k, (bars, gone, new) in zip(rows, kept, strict=False):
                found[k, c, "cq"] = (bars, gone, new, c) if c in trees.bases and np.isfinite(new).all() else (bars, none, bars, None)
        by_size: dict[int, list[int]] = {}
        for k in range(len(points)):
            if has_own[k] and labels[k] in wanted[k] and len(own[k]) and len(points[k]):
                by_size.setdefault(len(own[k]), []).append(k)
        for ks in (ks[i : i + TREES] for ks in by_size.values() for i in range(0, len(ks), TREES)):
            for k, edges in zip(ks, kernels.trees(np.stack([own[k] for k in ks])), strict=True):
                stars.setdefault(k, []).append((labels[k], kernels.distances(points[k], own[k]).min(1)))
                if "cq" in directions:
                    bars = kernels.cross_h0(kernels.merges(edges), own[k], points[k])
                    found[k, labels[k], "cq"] = (bars, none, bars, None)
        if "qc" in directions:
            for k, each in stars.items():
                for (c, _), b in zip(each, kernels.cross_many(kernels.kept_tree(points[k]), np.stack([s for _, s in each], 1)).T, strict=True):
                    b = b[b > 0]
                    found[k, c, "qc"] = (b, none, b, None)
        grid = [(k, c, d) for k in range(len(points)) for c in wanted[k] for d in _DIRECTIONS]
        bars, gone, new, base = zip(*(found.get(g, (none, none, none, None)) for g in grid), strict=True) if grid else ((), (), (), ())
        run_lengths = lambda x: np.array([len(b) for b in x], np.int64)
        flat = lambda x: np.concatenate(x) if x else none
        lists = lambda x, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(run_lengths(x)))).astype(np.int32)), pa.array(values))
        _, measures = _measure(flat(bars), run_lengths(bars))
        whole = [n if b is None else none for n, b in zip(new, base, strict=True)]
        life = flat(new)
        if not np.isfinite(life).all() or (life > LIMIT).any():
            life[np.repeat([b is None for b in base], run_lengths(new))] = _measure(flat(whole), run_lengths(whole))[0]
            life = np.minimum(life, LIMIT)
        rows, label, way = zip(*grid, strict=True) if grid else ((), (), ())
        taken = part.select(keys).take(pa.array(rows, pa.int64()))
        columns = [*(taken.column(k) for k in keys), pa.array(label, pa.int32()), pa.array(way, pa.string()), pa.array(np.zeros(len(grid), np.int32)), pa.array(base, pa.int32()), lists(gone, flat(gone)), lists(new, life), *map(pa.array, measures)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "class_label", "direction", "hom_dim", "base", "gone", "life", *_MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                yield made(batch.slice(i, 128))

    dealt = _dealt(series.select(*dict.fromkeys([*keys, "label"]), "points", "own", "wanted"), *keys)
    return dealt.mapInArrow(run, f"{_shape(series, keys)}class_label int, {_MEASURED}")


def measured(slotted: DataFrame) -> DataFrame:
    """The same from slots(), of all lifetimes, without a base."""
    rows = slotted.withColumn("base", F.lit(None).cast("int")).withColumn("gone", F.array().cast("array<double>")).withColumn("life", lifetimes())
    made = [mtd(), total_persistence(), pers_entropy(), landscape_l2()]
    return rows.select(*(c for c in rows.columns if c not in ("bars", "life")), "life", *(c.alias(n) for c, n in zip(made, _MEASURES, strict=True)))


_FLOAT_BITS = 40  # of a lifetime's 64 bits those that a first count leaves out


def _counted(rows: DataFrame, bases: dict[int, np.ndarray], ranges: dict[int, list[int]] | None) -> DataFrame:
    """(hom_dim, range, value, n): lifetimes by range of values, or, of the given ranges, by value. What is in gone counts against a base's."""

    def tally(h: int, values: np.ndarray, times: int) -> tuple:
        values = values + 0.0
        at = values.view(np.int64) >> _FLOAT_BITS
        if ranges is None:
            at, n = np.unique(at, return_counts=True)
            values = np.zeros(len(at))
        else:
            values, n = np.unique(values[np.isin(at, ranges.get(h, []))], return_counts=True)
            at = values.view(np.int64) >> _FLOAT_BITS
        return np.full(len(at), h, np.int32), at, values, n * times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, found = batch.column("hom_dim").to_numpy(), []
            for name, times in (("life", 1), ("gone", -1)):
                counts = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
                values, dim = batch.column(name).flatten().to_numpy(zero_copy_only=False), np.repeat(dims, counts)
                found += [tally(h, values[dim == h], times) for h in np.unique(dim).tolist()]
            base = batch.column("base").drop_null().to_numpy(zero_copy_only=False)
            found += [tally(0, bases[c], n) for c, n in zip(*(x.tolist() for x in np.unique(base, return_counts=True)), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["hom_dim", "range", "value", "n"])

    found = rows.select("hom_dim", "base", "gone", "life").mapInArrow(run, "hom_dim int, range long, value double, n long")
    return found.groupBy("hom_dim", "range", "value").agg(F.sum("n").alias("n")).where("n > 0")


def life_thresholds(rows: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """betti_thresholds() of measured rows, exact for any number of lifetimes.

    A first pass counts them by the upper bits of their numbers, which are in order of size; a second one only those in the ranges where the quartiles
    are, by value. So what reaches the driver are counts of ranges, and no task holds all values.
    """
    spark, sums = rows.sparkSession, {}
    for r in _counted(rows, bases, None).collect():
        sums.setdefault(r.hom_dim, []).append((r.range, r.n))
    places, ranges, before = {}, {}, {}
    for h, found in sums.items():
        at, n = np.array(sorted(found), np.int64).T
        upto = np.cumsum(n)
        places[h] = [(int(upto[-1]) - 1) * q for q in (0.25, 0.5, 0.75)]
        asked = np.searchsorted(upto, [f(p) for p in places[h] for f in (np.floor, np.ceil)], "right")
        ranges[h] = np.unique(at[asked]).tolist()
        before |= {(h, int(at[k])): int(upto[k] - n[k]) for k in np.unique(asked)}
    values: dict[tuple[int, int], float] = {}
    if ranges:
        w = Window.partitionBy("hom_dim", "range").orderBy("value")
        start = spark.createDataFrame([(h, r, n) for (h, r), n in before.items()], "hom_dim int, range long, before long")
        places_ = spark.createDataFrame([(h, int(f(p))) for h, ps in places.items() for p in ps for f in (np.floor, np.ceil)], "hom_dim int, place long").distinct()
        counted = _counted(rows, bases, ranges).join(F.broadcast(start), ["hom_dim", "range"]).withColumn("upto", F.sum("n").over(w) + F.col("before"))
        met = counted.join(F.broadcast(places_), "hom_dim").where("place < upto and place >= upto - n")
        values = {(r.hom_dim, r.place): r.value for r in met.collect()}

    def quartile(h: int, p: float) -> float:
        low, high = int(np.floor(p)), int(np.ceil(p))
        a, b = values[h, low], values[h, high]
        return a if low == high or a == b else (high - p) * a + (p - low) * b

    dims = [r[0] for r in rows.select("hom_dim").distinct().collect()]
    return spark.createDataFrame([(h, [quartile(h, p) for p in places[h]] if h in places else [0.0] * 3) for h in dims], "hom_dim int, thresholds array<double>")


def measured_scalars(rows: DataFrame, thresholds: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """scalars() of measured rows."""
    zeros = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    rows = rows.join(F.broadcast(thresholds), "hom_dim", "left").withColumn("thresholds", F.coalesce("thresholds", zeros))
    rest = [c for c in rows.columns if c not in ("base", "gone", "life", "thresholds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("thresholds").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            found, base = np.zeros((3, batch.num_rows)), pc.fill_null(batch.column("base").cast(pa.int64()), -(1 << 40)).to_numpy()
            for name, times in (("life", 1), ("gone", -1)):
                counts = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
                values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                found += [times * _sums((values >= np.repeat(marks[:, k], counts)).astype(float), counts) for k in range(3)]
            for c, lengths in bases.items():
                at = np.flatnonzero(base == c)
                found[:, at] += len(lengths) - np.searchsorted(np.sort(lengths), marks[at].T, "left")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, found)], names=[*rest, "betti_0", "betti_1", "betti_2"])

    return rows.mapInArrow(run, f"{_shape(rows, rest)}betti_0 double, betti_1 double, betti_2 double")


def slots(barcodes: DataFrame, keys: list[str], hom_dims: tuple[int, ...]) -> DataFrame:
    """keys, direction, hom_dim, bars: a row for each slot of a pair, bars or none. Narrow."""
    grid = F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(h).alias("hom_dim")) for d in ("qc", "cq") for h in hom_dims))
    rows = barcodes.select(*keys, "bars", F.explode(grid).alias("slot"))
    own = F.filter("bars", lambda b: (b["direction"] == F.col("slot.direction")) & (b["hom_dim"] == F.col("slot.hom_dim")))
    return rows.select(*keys, "slot.direction", "slot.hom_dim", F.transform(own, lambda b: F.struct(b["birth"].alias("birth"), b["death"].alias("death"))).alias("bars"))


def gather_bars(pairs: DataFrame, bars: DataFrame, keys: list[str], hom_dims: tuple[int, ...]) -> DataFrame:
    """The same from long bars: every (pair, direction, hom_dim) has a row, with an empty array where it has no bars.

    Pairs come in as rows without a bar, so one shuffle by pair gathers all, and no join is needed.
    """
    bar = F.struct("direction", "hom_dim", "birth", "death")
    none = F.lit(None).cast(bars.select(bar.alias("bar")).schema["bar"].dataType)
    rows = pairs.select(*keys).distinct().withColumn("bar", none).unionByName(bars.select(*keys, bar.alias("bar")))
    return slots(rows.groupBy(*keys).agg(F.array_sort(F.collect_list("bar")).alias("bars")), keys, hom_dims)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def lifetimes(bars: str | Column = "bars") -> Column:
    """Lengths, an infinite one as long as the longest finite one of the barcode (0 if none), within 0 and LIMIT."""
    raw = F.transform(bars, lambda b: b["death"] - b["birth"])
    finite = lambda x: (F.abs(x) < float("inf")) & ~F.isnan(x)
    longest = F.coalesce(F.array_max(F.filter(raw, finite)), F.lit(0.0))
    return F.transform(raw, lambda x: F.least(F.greatest(F.when(finite(x), x).otherwise(longest), F.lit(0.0)), F.lit(LIMIT)))


def betti_thresholds(slotted: DataFrame, exact: bool = True) -> DataFrame:
    """(hom_dim, thresholds): quartiles of all lifetimes of a dimension, both directions; zeros where there are none.

    Exact percentiles keep a count for each distinct value; above some millions of them take exact=False, whose
    summaries have a fixed size.
    """
    each = slotted.select("hom_dim", F.explode(lifetimes()).alias("life"))
    quart = F.expr("percentile(life, array(0.25, 0.5, 0.75))" if exact else "approx_percentile(life, array(0.25D, 0.5D, 0.75D), 10000)")
    found = each.groupBy("hom_dim").agg(quart.alias("thresholds"))
    all_dims = slotted.select("hom_dim").distinct()
    zeros = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return all_dims.join(found, "hom_dim", "left").withColumn("thresholds", F.coalesce("thresholds", zeros))


def mtd() -> Column:
    """Sum of raw lengths; not finite or beyond LIMIT becomes LIMIT of its sign."""
    return _clip(_sum(F.transform("bars", lambda b: b["death"] - b["birth"])))


def total_persistence() -> Column:
    return _clip(_sum(F.transform("bars", lambda b: (b["death"] - b["birth"]) * (b["death"] - b["birth"]))))


def _clip(total: Column) -> Column:
    return F.when(F.isnan(total) | (F.abs(total) == float("inf")), LIMIT).otherwise(F.least(F.greatest(total, F.lit(-LIMIT)), F.lit(LIMIT)))


def pers_entropy(life: str = "life") -> Column:
    """Base-2 entropy of the lifetimes' shares; 0 of none, and of all zero."""
    total = _sum(F.col(life))
    parts = _sum(F.transform(F.filter(life, lambda x: x > 0), lambda x: x * F.log2(x)))
    return F.when(total > 0, F.log2(total) - parts / total).otherwise(0.0)


def landscape_l2(life: str = "life") -> Column:
    return F.sqrt(_sum(F.transform(life, lambda x: x * x)))


def betti(life: str, thresholds: str, k: int) -> Column:
    """Lifetimes not below the k-th threshold."""
    return F.size(F.filter(life, lambda x: x >= F.get(thresholds, F.lit(k)))).cast("double")


def scalars(slotted: DataFrame, thresholds: DataFrame) -> DataFrame:
    """All REPS of every (pair, direction, hom_dim), zero-bar ones too. thresholds has a row for each dimension."""
    rows = slotted.withColumn("life", lifetimes()).join(F.broadcast(thresholds), "hom_dim", "left")
    rows = rows.withColumn("thresholds", F.coalesce("thresholds", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    made = [mtd(), total_persistence(), pers_entropy(), landscape_l2(), *(betti("life", "thresholds", k) for k in range(3))]
    rest = [c for c in slotted.columns if c != "bars"]
    return rows.select(*rest, *(c.alias(n) for c, n in zip(made, REPS, strict=True)))


def long_scores(scored: DataFrame, keys: list[str], reps: tuple[str, ...] = REPS) -> DataFrame:
    """keys, direction, hom_dim, rep, value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.col(r).cast("double").alias("value")) for r in reps)))
    return scored.select(*keys, "direction", "hom_dim", pairs.alias("s")).select(*keys, "direction", "hom_dim", "s.rep", "s.value")
