"""Least-squares networks: linearised rows, normal equations, adjustment of many networks at once, and its statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.operators.observations import usable_observations
from cadastre.sources.tables import written


def normal_equations(rows: DataFrame) -> DataFrame:
    """(net, i, j, value) of A'WA from rows(net, row, param, coef, misclosure, weight); j null holds A'Wl.

    A row has few parameters, so joining it with itself stays small.
    """
    other = rows.select("net", "row", F.col("param").alias("j"), F.col("coef").alias("other"))
    products = rows.join(other, ["net", "row"]).groupBy("net", F.col("param").alias("i"), "j").agg(F.sum(F.col("weight") * F.col("coef") * F.col("other")).alias("value"))
    right = rows.groupBy("net", F.col("param").alias("i")).agg(F.sum(F.col("weight") * F.col("coef") * F.col("misclosure")).alias("value"))
    return products.unionByName(right, allowMissingColumns=True)


def error_ellipses(covariances: DataFrame, scale: float = 2.45) -> DataFrame:
    """covariances(..., sxx, sxy, syy) with half axes a, b and theta, the angle of a from +x."""
    mean, half = F.expr("(sxx + syy) / 2"), F.expr("(sxx - syy) / 2")
    spread = F.sqrt(half * half + F.col("sxy") * F.col("sxy"))
    axis = lambda eigen: scale * F.sqrt(F.greatest(eigen, F.lit(0.0)))
    return covariances.withColumns({"a": axis(mean + spread), "b": axis(mean - spread), "theta": F.atan2(2 * F.col("sxy"), F.expr("sxx - syy")) / 2})


def point_sigmas(covariance: DataFrame) -> DataFrame:
    """(net, i, sigma): roots of the diagonal of covariance(net, i, j, value)."""
    return covariance.where("i = j").select("net", "i", F.sqrt("value").alias("sigma"))


#: Standard deviation of an observation that states none, by kind (radians or metres).
SIGMAS = {"azimuth": 0.001 * math.pi / 180, "horizontal_angle": 0.001 * math.pi / 180, "horizontal_distance": 0.005, "slope_distance": 0.005, "height_difference": 0.002, "gnss": 0.005}
AXES = ("x", "y", "z")


def free_params(points: DataFrame, mode: str = "auto") -> DataFrame:
    """(net, id, axis) of the coordinates of points(net, id, ord, fixed) that an adjustment may move.

    free: all.  partial, full: those of points that aren't fixed.  minimal: all
    but the first fixed point (or the first of all) and x of the second fixed
    one.  auto: partial for networks with two fixed points, else minimal.
    """
    if mode not in ("auto", "free", "minimal", "partial", "full"):
        raise ValueError(f"unknown mode {mode}")
    net, fixed = Window.partitionBy("net"), F.coalesce("fixed", F.lit(False))
    ranked = points.withColumns({"fixed": fixed, "n_fixed": F.sum(fixed.cast("int")).over(net), "rank": F.row_number().over(net.orderBy((~fixed).cast("int"), "ord"))})
    minimal = (F.col("rank") == 1) | ((F.col("rank") == 2) & F.col("fixed") & (F.col("axis") == "x"))
    held = {"free": F.lit(False), "partial": F.col("fixed"), "full": F.col("fixed"), "minimal": minimal, "auto": F.when(F.col("n_fixed") >= 2, F.col("fixed")).otherwise(minimal)}
    axes = F.explode(F.array(*map(F.lit, AXES))).alias("axis")
    return ranked.select("net", "id", "fixed", "n_fixed", "rank", axes).where(~held[mode]).select("net", "id", "axis")


def _weight() -> Column:
    """1 / sigma squared of an observation, with the usual sigma of its kind where it states none."""
    usual = F.lit(None).cast("double")
    for kind, sigma in SIGMAS.items():
        usual = F.when(F.col("kind") == kind, F.lit(sigma)).otherwise(usual)
    sigma = F.coalesce("sigma", usual)
    return 1 / (sigma * sigma)


def jacobian_rows(points: DataFrame, obs: DataFrame, free: DataFrame) -> DataFrame:
    """(net, row, id, axis, coef, misclosure, weight): linearised obs(net, obs, kind, from_pt, to_pt, value, vector, sigma).

    points(net, id, x, y, z) are the present coordinates; row is struct(obs,
    part), a GNSS vector has three parts.  Observations whose ends coincide or
    aren't known, of other kinds or rejected ones give no row.
    """
    ends = points.select("net", F.col("id").alias("pt"), F.struct("x", "y", "z").alias("at"))
    placed = usable_observations(obs).join(ends.withColumnsRenamed({"pt": "from_pt", "at": "p"}), ["net", "from_pt"]).join(ends.withColumnsRenamed({"pt": "to_pt", "at": "q"}), ["net", "to_pt"])
    placed = placed.withColumns({f"d{c}": F.col(f"q.{c}") - F.col(f"p.{c}") for c in AXES})
    dx, dy, dz = (F.col(f"d{c}") for c in AXES)
    placed = placed.withColumns({"flat": F.sqrt(dx * dx + dy * dy), "slope": F.sqrt(dx * dx + dy * dy + dz * dz)})
    flat, slope, value = F.nullif(F.col("flat"), F.lit(0.0)), F.nullif(F.col("slope"), F.lit(0.0)), F.col("value")
    off = F.pmod(value - F.atan2(dx, dy) + F.pi(), F.lit(2 * math.pi)) - F.pi()
    none = F.lit(0.0)

    def part(number: int, misclosure: Column, *coefs: Column) -> Column:
        return F.struct(F.lit(number).alias("part"), misclosure.alias("misclosure"), F.struct(*[c.alias(a) for a, c in zip(AXES, coefs, strict=True)]).alias("to"))

    turned = F.array(part(0, off, dy / (flat * flat), -dx / (flat * flat), none))
    parts = (
        F.when(F.col("kind").isin("azimuth", "horizontal_angle"), turned)
        .when(F.col("kind") == "horizontal_distance", F.array(part(0, value - flat, dx / flat, dy / flat, none)))
        .when(F.col("kind") == "slope_distance", F.array(part(0, value - slope, dx / slope, dy / slope, dz / slope)))
        .when(F.col("kind") == "height_difference", F.array(part(0, value - dz, none, none, F.lit(1.0))))
        .otherwise(F.array(*[part(i, F.col("vector")[i] - F.col(f"d{c}"), *[F.lit(float(c == a)) for a in AXES]) for i, c in enumerate(AXES)]))
    )
    rows = placed.select("net", "obs", "from_pt", "to_pt", _weight().alias("weight"), F.explode(parts).alias("r")).where("r.misclosure is not null")
    sides = F.array(*[F.struct(F.col(pt).alias("id"), F.lit(a).alias("axis"), (F.col(f"r.to.{a}") * sign).alias("coef")) for pt, sign in (("to_pt", 1.0), ("from_pt", -1.0)) for a in AXES])
    out = rows.select("net", F.struct("obs", "r.part").alias("row"), "r.misclosure", "weight", F.explode(sides).alias("s")).select("net", "row", "s.id", "s.axis", "s.coef", "misclosure", "weight")
    return out.where("coef != 0").join(free, ["net", "id", "axis"], "left_semi")


#: What a row of _by_net() is.
POINT, FREE, OBSERVED, COFACTOR = range(4)
#: Rows of observations that are multiplied out at once.
CHUNK = 1 << 15


def _by_net(points: DataFrame, obs: DataFrame, free: DataFrame, cofactors: DataFrame | None = None) -> DataFrame:
    """All rows of the tables in one, by network and kind of row (``what``); ``first`` marks the first row of a network.

    a and b are ids as texts.  An observation is a row for each number that it
    measures along its line: direction 0, flat length 1, slope length 2, differences of x, y, z 3 to 5.
    Networks are numbered by a window, so tables that stand by network already aren't sent again.
    """
    text = lambda c, name: F.col(c).cast("string").alias(name)
    axis = lambda c: sum(F.when(F.col(c) == a, i).otherwise(0) for i, a in enumerate(AXES))
    part = lambda number, kind, value: F.struct(F.lit(number).alias("part"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))
    one = F.when(F.col("kind") == "horizontal_distance", 1).when(F.col("kind") == "slope_distance", 2).when(F.col("kind") == "height_difference", 5).otherwise(0)
    single = F.array(F.struct(F.lit(0).alias("part"), one.alias("kind"), F.col("value").cast("double").alias("value")))
    parts = F.when(F.col("kind") == "gnss", F.array(*[part(i, 3 + i, F.col("vector")[i]) for i in range(3)])).otherwise(single)
    tables = [
        points.select("net", F.lit(POINT).alias("what"), text("id", "a"), *[F.col(c).cast("double").alias(c) for c in AXES]),
        free.select("net", F.lit(FREE).alias("what"), text("id", "a"), axis("axis").alias("kind"), "axis").where(F.col("net").isNotNull() & F.col("axis").isin(*AXES)).drop("axis"),
        usable_observations(obs).where("net is not null").select("net", F.lit(OBSERVED).alias("what"), text("from_pt", "a"), text("to_pt", "b"), "obs", _weight().alias("weight"), F.explode(parts).alias("m")).select("net", "what", "a", "b", "obs", "weight", "m.*").where("value is not null"),
    ]
    if cofactors is not None:
        tables.append(cofactors.where("net is not null").select("net", F.lit(COFACTOR).alias("what"), text("i.id", "a"), text("j.id", "b"), (3 * axis("i.axis") + axis("j.axis")).alias("kind"), "value"))
    rows = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), tables)
    number = F.row_number().over(Window.partitionBy("net").orderBy("what", "obs", "part", "a", "b"))
    return rows.withColumn("first", number == 1).select("net", "first", "what", "a", "b", *AXES, "obs", "part", "kind", "value", "weight")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole networks from rows of _by_net(); the last network of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
        last = int(begins[-1]) if len(begins) else None
        if last is not None and (held or last):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch if last is None else batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


class _Networks:
    """Whole networks of one table as numbers: coordinates of points, which are free, and observations between known points."""

    def __init__(self, table: pa.Table) -> None:
        self.table, what, group = table, table["what"].to_numpy(), np.cumsum(table["first"].to_numpy()) - 1
        ends = pa.concat_arrays([*table["a"].chunks, *table["b"].chunks]).dictionary_encode()
        codes = pc.fill_null(ends.indices, -1).to_numpy().astype(np.int64) + 1  # 0: no id
        width, numbers = len(ends.dictionary) + 1, {c: table[c].to_numpy() for c in ("kind", "value", "weight")}
        self.points = np.flatnonzero(what == POINT)
        self.group, self.groups = group[self.points], int(group[-1]) + 1 if len(group) else 0
        self.at = np.stack([table[c].to_numpy()[self.points] for c in AXES], axis=1)
        keys = self.group * width + codes[self.points]
        order = np.argsort(keys, kind="stable")
        known = keys[order]

        def find(kind: int, *sides: int) -> tuple[np.ndarray, ...]:
            """Rows of a kind whose ends are points of their network, and those points."""
            rows = np.flatnonzero(what == kind)
            at = []
            for side in sides:
                code = codes[rows + side * len(what)]
                key = group[rows] * width + code
                place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                at.append(np.where((code > 0) & (known[place] == key), order[place], -1) if len(known) else np.full(len(rows), -1))
            good = np.all([p >= 0 for p in at], axis=0)
            return rows[good], *[p[good] for p in at]

        self.free = np.zeros((len(self.points), 3), dtype=bool)
        rows, place = find(FREE, 0)
        self.free[place, numbers["kind"][rows].astype(int)] = True
        self.rows, self.begin, self.end = find(OBSERVED, 0, 1)
        self.of, self.kind, self.value, self.weight = group[self.rows], numbers["kind"][self.rows].astype(int), numbers["value"][self.rows], numbers["weight"][self.rows]
        rows, i, j = find(COFACTOR, 0, 1)
        kind = numbers["kind"][rows].astype(int)
        self.cofactors = (3 * i + kind // 3) * 3 * len(self.points) + 3 * j + kind % 3, numbers["value"][rows]

    def linear(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, coordinates, misclosure) of observations, as jacobian_rows() states them: a row has six places, those that say nothing are 0; without any the misclosure is 0."""
        d, kind, value = self.at[self.end[rows]] - self.at[self.begin[rows]], self.kind[rows], self.value[rows]
        flat, slope = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2), np.sqrt((d * d).sum(axis=1))
        flat[flat == 0], slope[slope == 0] = np.nan, np.nan
        turned, level, slanted = kind == 0, kind == 1, kind == 2
        coef, off = np.zeros((len(rows), 3)), value - np.take_along_axis(d, np.maximum(kind - 3, 0)[:, None], axis=1)[:, 0]
        coef[kind > 2, kind[kind > 2] - 3] = 1.0
        coef[turned, 0], coef[turned, 1] = d[turned, 1] / flat[turned] ** 2, -d[turned, 0] / flat[turned] ** 2
        off[turned] = np.mod(value[turned] - np.arctan2(d[turned, 0], d[turned, 1]) + math.pi, 2 * math.pi) - math.pi
        coef[level, :2], off[level] = d[level, :2] / flat[level, None], value[level] - flat[level]
        coef[slanted], off[slanted] = d[slanted] / slope[slanted, None], value[slanted] - slope[slanted]
        place = np.concatenate([3 * self.end[rows, None] + np.arange(3), 3 * self.begin[rows, None] + np.arange(3)], axis=1)
        both = np.concatenate([coef, -coef], axis=1)
        both[np.isnan(both) | np.isnan(off)[:, None] | ~self.free.ravel()[place]] = 0.0
        return both, place, np.where(both.any(axis=1), off, 0.0)

    def params(self, coef: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coordinates that observations say something about, and how many each network has."""
        params = np.unique(place[coef != 0])
        return params, np.bincount(self.group[params // 3], minlength=self.groups)

    def turn(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(networks, coordinates, corrections, cofactors, free directions) by the observations ``rows``, networks of one size together."""
        coef, place, off = self.linear(rows)
        params, size = self.params(coef, place)
        start = np.cumsum(size) - size
        own = np.searchsorted(params, place) - start[self.of[rows]][:, None]
        own[coef == 0] = 0
        for n in np.unique(size[size > 0]).tolist():
            nets = np.flatnonzero(size == n)
            number = np.zeros(self.groups, dtype=np.int64)
            number[nets] = np.arange(len(nets))
            normal, absolute = np.zeros(len(nets) * n * n), np.zeros(len(nets) * n)
            here = np.flatnonzero(size[self.of[rows]] == n)
            for part in np.split(here, range(CHUNK, len(here), CHUNK)):
                c, w = coef[part], self.weight[rows[part]][:, None]
                at = number[self.of[rows[part]]][:, None] * n + own[part]
                absolute += np.bincount(at.ravel(), (w * c * off[part][:, None]).ravel(), minlength=len(absolute))
                normal += np.bincount((at[:, :, None] * n + own[part][:, None, :]).ravel(), ((w * c)[:, :, None] * c[:, None, :]).ravel(), minlength=len(normal))
            normal, absolute = normal.reshape(-1, n, n), absolute.reshape(-1, n, 1)
            # Networks without enough held points have no inverse; the least solution of all stands in.
            low = ~(np.linalg.cond(normal) < 1e14)
            loose = np.zeros(len(nets), dtype=np.int32)
            loose[low] = n - np.linalg.matrix_rank(normal[low], hermitian=True)
            q = np.zeros_like(normal)
            q[~low], q[low] = np.linalg.inv(normal[~low]), np.linalg.pinv(normal[low], hermitian=True)
            yield nets, params[start[nets][:, None] + np.arange(n)], (q @ absolute)[:, :, 0], q, loose


def _adjusted(table: pa.Table, most: int, close: float, fit: bool = False) -> Iterator[dict[str, pa.Array]]:
    """Columns of the points, cofactors and rejects of whole networks, or with ``fit`` of their redundancy and variance alone."""
    own = _Networks(table)
    net, ids = table["net"].take(pa.array(own.points)), table["a"].take(pa.array(own.points))
    coef, place, _ = own.linear(np.arange(len(own.rows)))
    rows = np.bincount(own.of[coef.any(axis=1)], minlength=own.groups)
    open_ = rows >= np.maximum(own.params(coef, place)[1], 1)
    begins = np.flatnonzero(np.diff(own.group, prepend=-1))
    rejected = begins[~open_[own.group[begins]]]
    if not fit:
        yield {"what": pa.array(np.full(len(rejected), 2, dtype=np.int32)), "net": net.take(pa.array(rejected))}
    kept = np.flatnonzero(open_[own.group])
    turns, done, loose = np.zeros(own.groups, dtype=np.int32), np.zeros(own.groups, dtype=bool), np.zeros(own.groups, dtype=np.int32)
    for turn in range(1, most + 1):
        if not open_.any():
            break
        turns[open_], done[open_], loose[open_] = turn, True, 0
        for nets, params, dx, q, free in own.turn(np.flatnonzero(open_[own.of])):
            own.at[params // 3, params % 3] += dx
            done[nets], loose[nets] = np.abs(dx).max(axis=1) <= close, free
            ready = done[nets] | (turn == most)
            n = q.shape[1]
            if fit:
                continue
            names = pc.binary_join_element_wise(pa.array(AXES).take(pa.array((params % 3).ravel())), ids.take(pa.array((params // 3).ravel())), "")
            g, i, j = (x.ravel()[np.repeat(ready, n * n)] for x in np.indices(q.shape))
            yield {"what": pa.array(np.ones(len(g), dtype=np.int32)), "net": net.take(pa.array(params[g, 0] // 3)), "i": names.take(pa.array(g * n + i)), "j": names.take(pa.array(g * n + j)), "value": pa.array(q[ready].ravel())}
        open_ = open_ & ~done
    if fit:
        coef, place, off = own.linear(np.arange(len(own.rows)))
        used = coef.any(axis=1) & (turns[own.of] > 0)
        rows, wvv = np.bincount(own.of[used], minlength=own.groups), np.bincount(own.of[used], own.weight[used] * off[used] * off[used], minlength=own.groups)
        told = begins[rows[own.group[begins]] > 0]
        g = own.group[told]
        spare = (rows - own.params(coef, place)[1])[g]
        yield {"net": net.take(pa.array(told)), "redundancy": pa.array(spare), "sigma0_sq": pa.array(np.where(spare > 0, wvv[g] / np.maximum(spare, 1), 0.0))}
        return
    at, g = own.at[kept], own.group[kept]
    given = {c: pc.is_null(table[c]).to_numpy()[own.points[kept]] for c in AXES}
    yield {"what": pa.array(np.zeros(len(kept), dtype=np.int32)), "net": net.take(pa.array(kept)), "i": ids.take(pa.array(kept)), **{c: pa.array(at[:, k], mask=given[c]) for k, c in enumerate(AXES)}, "turns": pa.array(turns[g]), "converged": pa.array(done[g]), "free": pa.array(loose[g])}


def _batches(columns: dict[str, pa.Array | pa.ChunkedArray], schema: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Columns by name, missing ones null, as batches."""
    size = len(columns["net"])
    yield from pa.table([columns[c] if c in columns else pa.nulls(size, t) for c, t in schema.items()], names=list(schema)).to_batches(1 << 16)


def adjust_networks(points: DataFrame, obs: DataFrame, free: DataFrame, most: int = 12, close: float = 0.0005) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gauss-Newton over all networks at once: points(net, id, x, y, z, turns, converged, free), covariance cofactors, and rejects(net, reason).

    Points, observations and free coordinates are brought together by network
    once; a task takes its networks in Arrow batches, solves those of one size
    together and goes on with a network until no coordinate moves more than ``close``.
    One that has fewer rows than coordinates is rejected.  ``free`` above 0 marks
    a network that its observations don't hold in that many directions (its
    normal matrix then has no inverse, and the least solution of all is taken).
    A network's normal matrix is dense and stands in one task with its
    observations: that bounds the size of a network, never the number of networks.
    """
    kinds = dict(points.dtypes)

    def adjust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            schema = {"what": pa.int32(), "net": table.schema.field("net").type, "i": pa.string(), "j": pa.string(), **dict.fromkeys((*AXES, "value"), pa.float64()), "turns": pa.int32(), "converged": pa.bool_(), "free": pa.int32()}
            for columns in _adjusted(table, most, close):
                yield from _batches(columns, schema)

    numbers = ", ".join(f"{c} double" for c in (*AXES, "value"))
    out = written(_by_net(points, obs, free).mapInArrow(adjust, f"what int, net {kinds['net']}, i string, j string, {numbers}, turns int, converged boolean, free int"), "adjusted")
    # an axis is one letter, so that it comes off again whatever the id holds
    named = lambda c: F.struct(F.substring(c, 2, 2**31 - 1).cast(kinds["id"]).alias("id"), F.substring(c, 1, 1).alias("axis")).alias(c)
    adjusted = out.where("what = 0").select("net", F.col("i").cast(kinds["id"]).alias("id"), *AXES, "turns", "converged", "free")
    return adjusted, out.where("what = 1").select("net", named("i"), named("j"), "value"), out.where("what = 2").select("net", F.lit("underdetermined").alias("reason"))


def network_fits(points: DataFrame, obs: DataFrame, free: DataFrame, most: int = 12, close: float = 0.0005) -> DataFrame:
    """nets(net, redundancy, sigma0_sq) of residuals_blunders() at what adjust_networks() makes of the points, in the task that adjusts them: nothing is written or sent again."""
    kinds = dict(points.dtypes)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            for columns in _adjusted(table, most, close, fit=True):
                yield from _batches(columns, {"net": table.schema.field("net").type, "redundancy": pa.int64(), "sigma0_sq": pa.float64()})

    return _by_net(points, obs, free).mapInArrow(fits, f"net {kinds['net']}, redundancy long, sigma0_sq double")


def _residuals(table: pa.Table) -> dict[str, pa.Array]:
    """Columns of the observations of whole networks that say something about a free coordinate; ``first`` marks one of each network."""
    own = _Networks(table)
    coef, place, off = own.linear(np.arange(len(own.rows)))
    used = np.flatnonzero(coef.any(axis=1))
    params = own.params(coef, place)[1]
    of, weight, off = own.of[used], own.weight[used], off[used]
    keys, values = own.cofactors
    order = np.argsort(keys)
    keys, values, aqa = keys[order], values[order], np.zeros(len(used))
    for part in np.split(np.arange(len(used)), range(CHUNK, len(used), CHUNK)) if len(keys) else ():
        c, p = coef[used[part]], place[used[part]]
        pair = p[:, :, None] * 3 * len(own.points) + p[:, None, :]
        near = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        aqa[part] = (c[:, :, None] * c[:, None, :] * np.where(keys[near] == pair, values[near], 0.0)).sum(axis=(1, 2))
    first = np.diff(of, prepend=-1) > 0
    rows, wvv = np.bincount(of, minlength=own.groups), np.bincount(of, weight * off * off, minlength=own.groups)
    given = {c: table[c].take(pa.array(own.rows[used])) for c in ("net", "obs", "part")}
    return given | {c: pa.array(v) for c, v in {"first": first, "misclosure": off, "weight": weight, "aqa": aqa, "rows": rows[of], "params": params[of], "wvv": wvv[of]}.items()}


def adjust_levels(points: DataFrame, obs: DataFrame, free: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """adjust_networks for height differences alone: linear, so one turn is exact."""
    return adjust_networks(points, obs.where("kind = 'height_difference'"), free, most=1)


def residuals_blunders(points: DataFrame, obs: DataFrame, free: DataFrame, cofactors: DataFrame, threshold: float = 3.29, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Residuals (net, obs, part, v, standardized, blunder) and networks (net, redundancy, sigma0_sq) at adjusted points.

    A residual is computed minus observed; it is divided by the root of 1/w - a
    Q a', or with ``compat`` of 1/w - a Q a' without the variance taken out of Q.
    """
    kinds = dict(obs.dtypes)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield from _batches(_residuals(table), {c: None for c in ("net", "obs", "part", "first", "misclosure", "weight", "aqa", "rows", "params", "wvv")})

    found = _by_net(points, obs, free, cofactors).mapInArrow(residuals, f"net {kinds['net']}, obs {kinds['obs']}, part int, first boolean, misclosure double, weight double, aqa double, rows long, params long, wvv double")
    spare = F.col("rows") - F.col("params")
    found = found.withColumns({"redundancy": spare, "sigma0_sq": F.when(spare > 0, F.col("wvv") / spare).otherwise(0.0)})
    scale = F.greatest("sigma0_sq", F.lit(1e-30)) if compat else F.lit(1.0)
    room = F.greatest(1 / F.col("weight") - F.col("aqa") / scale, F.lit(1e-30))
    out = found.withColumn("v", -F.col("misclosure")).withColumn("standardized", F.col("v") / F.sqrt(room))
    return out.select("net", "obs", "part", "v", "standardized", (F.abs("standardized") > threshold).alias("blunder")), found.where("first").select("net", "redundancy", "sigma0_sq")


def _gamma_part(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, r: int) -> float:
    low, high = 0.0, r + 40 * math.sqrt(2 * r) + 40
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_part(r / 2, middle / 2) < p else (low, middle)
    return (low + high) / 2


def chi_square_gate(nets: DataFrame, alpha: float = 0.05) -> DataFrame:
    """nets(net, redundancy, sigma0_sq) with ``passes``: redundancy * sigma0_sq between both critical values; false without redundancy.

    A task computes the critical values of a redundancy once, so ``nets`` is read once.
    """

    def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits: dict[int, tuple[float, float]] = {}
        for batch in batches:
            r, chi = pc.fill_null(batch.column("redundancy"), 0).to_numpy(), pc.fill_null(batch.column("sigma0_sq"), math.nan).to_numpy()
            passes = np.zeros(len(r), dtype=bool)
            for n in np.unique(r[r > 0]).tolist():
                if n not in limits:
                    limits[n] = chi_square_quantile(alpha / 2, n), chi_square_quantile(1 - alpha / 2, n)
                low, high = limits[n]
                passes |= (r == n) & (n * chi >= low) & (n * chi <= high)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passes)], names=[*batch.schema.names, "passes"])

    return nets.mapInArrow(gate, nets.select("*", F.lit(False).alias("passes")).schema)
