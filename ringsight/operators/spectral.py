"""Filters over the graph Laplacian, diffusion, and heterophily.

Everything rests on one step, ``propagate``: weighted sums of the signals over the links, made block by
block (``links.py``). Signals are plain double columns, so k signals cost one pass.
"""

from __future__ import annotations

import math
from numpy.polynomial import polynomial

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.functions.linear import gaussian, gram, orthonormal, pca, project, seeded_normal
from ringsight.functions.ordered import with_position
from ringsight.functions.scalars import mean_of, one_row, pop_std_of, safe_div, total
from ringsight.graph import FraudGraph
from ringsight.operators.blocks import path_masses
from ringsight.operators.links import Links, link_differences, link_sums, pack_links
from ringsight.operators.structure import undirected_degree
from ringsight.session import cut_lineage

EPS = 1e-8


# --- links and propagation -------------------------------------------------------------------

def symmetric_links(und: DataFrame, eps: float = EPS) -> DataFrame:
    """Weights 1/sqrt((d_i + eps)(d_j + eps))."""
    d = undirected_degree(und, "d").select("node", (1.0 / F.sqrt(F.col("d") + eps)).alias("w"))
    return und.join(d.withColumnRenamed("w", "wi"), "node").join(
        d.withColumnsRenamed({"node": "nbr", "w": "wj"}), "nbr"
    ).select("node", "nbr", (F.col("wi") * F.col("wj")).alias("weight"))


def random_walk_links(und: DataFrame) -> DataFrame:
    """Weights 1/d_i."""
    d = undirected_degree(und, "d").select("node", (1.0 / F.col("d")).alias("weight"))
    return und.join(d, "node").select("node", "nbr", "weight")


def propagate(links: Links | DataFrame, signals: DataFrame, columns: list[str]) -> DataFrame:
    """``(node_id, columns..)`` with the weighted sum over the neighbours; nodes without any are absent.

    Pass ``pack_links(links)`` where there are several products over the same links.
    """
    if not isinstance(links, Links):
        links = pack_links(links)
    if isinstance(links, Links):
        return link_sums(links, signals, columns)
    sides = signals.select(F.col("node_id").alias("nbr"), *columns)
    return links.join(sides, "nbr").groupBy(F.col("node").alias("node_id")).agg(
        *[F.sum(F.col("weight") * F.col(c)).alias(c) for c in columns]
    )


def with_propagated(links: Links | DataFrame, rows: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add ``new = A old`` for every ``new: old``; 0 for nodes without neighbours."""
    moved = propagate(links, rows, list(pairs.values()))
    renamed = moved.select("node_id", *[F.col(old).alias(new) for new, old in pairs.items()])
    return rows.join(renamed, "node_id", "left").fillna(0.0, list(pairs))


def laplacian(links: Links | DataFrame, rows: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Add ``new = old - A old``."""
    moved = with_propagated(links, rows, pairs)
    return moved.withColumns({new: F.col(old) - F.col(new) for new, old in pairs.items()})


def _signals(graph: FraudGraph, first: int | None = None) -> tuple[DataFrame, list[str]]:
    names = graph.feature_names[:first]
    return graph.features(names), names


# --- L1, L2: smoothness ------------------------------------------------------------------------

def laplacian_smoothness(graph: FraudGraph, filled: int | None = None) -> DataFrame:
    """L1: x * (L x); mean, max and std over all columns; those after the first ``filled`` count as 0."""
    return _smoothness(graph, symmetric_links(graph.neighbours()), filled)


def _smoothness(graph: FraudGraph, links: Links | DataFrame, filled: int | None) -> DataFrame:
    rows, names = _signals(graph, filled)
    out = laplacian(links, rows, {f"l_{c}": c for c in names})
    scores = [F.col(c) * F.col(f"l_{c}") for c in names]
    scores += [F.lit(0.0)] * (len(graph.feature_names) - len(names))
    return out.select(
        "node_id", mean_of(scores).alias("smoothness_mean"), F.greatest(*scores).alias("smoothness_max"),
        pop_std_of(scores).alias("smoothness_std"),
    )


def neighbour_smoothness_diff(graph: FraudGraph, filled: int | None = None) -> DataFrame:
    """L2: mean absolute difference of the smoothness to the neighbours."""
    links = pack_links(symmetric_links(graph.neighbours()))
    s = cut_lineage(_smoothness(graph, links, filled).select("node_id", F.col("smoothness_mean").alias("s")))
    apart = F.abs(F.col("a") - F.col("b"))
    if isinstance(links, Links) and not s.groupBy("node_id").count().where("node_id is not null and count > 1").take(1):
        sums = link_differences(links, s, "s")
        diff = sums.select("node_id", (F.col("apart") / F.col("n")).alias("neighbor_smoothness_diff"))
    else:  # rows of one id are compared one by one
        pairs = graph.neighbours().join(s.toDF("node", "a"), "node").join(s.toDF("nbr", "b"), "nbr")
        diff = pairs.groupBy(F.col("node").alias("node_id")).agg(F.avg(apart).alias("neighbor_smoothness_diff"))
    return graph.attach(diff).fillna(0.0)


# --- L3: Chebyshev --------------------------------------------------------------------------------

def chebyshev(graph: FraudGraph, order: int = 3, keep: int | None = None) -> DataFrame:
    """L3: T0..T3 of the random-walk Laplacian; all columns, or the ``keep`` of largest variance, ascending."""
    rows, names = _signals(graph)
    links = pack_links(random_walk_links(graph.neighbours()))
    rows = rows.select("node_id", *[F.col(c).alias(f"t0_{i}") for i, c in enumerate(names)])
    n = len(names)
    for step in range(1, order + 1):
        rows = laplacian(links, rows, {f"t{step}_{i}": f"t{step - 1}_{i}" for i in range(n)})
        if step > 1:
            rows = rows.withColumns({
                f"t{step}_{i}": 2 * F.col(f"t{step}_{i}") - F.col(f"t{step - 2}_{i}") for i in range(n)
            })
        rows = cut_lineage(rows)
    columns = [f"t{s}_{i}" for s in range(order + 1) for i in range(n)]
    # One number per column decides which columns stay.
    spread = rows.agg(*[F.var_pop(c).alias(c) for c in columns]).first().asDict()
    chosen = sorted(columns, key=lambda c: spread[c] or 0.0)[-(keep or len(columns)):]
    return rows.select("node_id", *[F.col(c).alias(f"chebyshev_{j}") for j, c in enumerate(chosen)])


# --- L4: low and high frequencies ---------------------------------------------------------------

def spectral_response(graph: FraudGraph, first: int | None = None) -> DataFrame:
    """L4: three half steps (x + Lx)/2 against one L x, added up over all features (or the first)."""
    rows, names = _signals(graph, first)
    links = pack_links(symmetric_links(graph.neighbours()))
    rows = laplacian(links, rows, {f"h_{c}": c for c in names})
    rows = rows.withColumns({f"s_{c}": (F.col(c) + F.col(f"h_{c}")) / 2 for c in names})
    for _ in range(2):
        rows = laplacian(links, rows.drop(*[f"q_{c}" for c in names]), {f"q_{c}": f"s_{c}" for c in names})
        rows = rows.withColumns({f"s_{c}": (F.col(f"s_{c}") + F.col(f"q_{c}")) / 2 for c in names})
    sums = cut_lineage(rows.select(
        "node_id", total([F.abs(f"s_{c}") for c in names]).alias("low"), total([F.abs(f"h_{c}") for c in names]).alias("high")
    ))
    top = one_row(sums.agg(F.max("low").alias("low"), F.max("high").alias("high")))
    low = F.when(top["low"] > 0, F.try_divide(F.col("low"), top["low"])).otherwise(F.col("low"))
    high = F.when(top["high"] > 0, F.try_divide(F.col("high"), top["high"])).otherwise(F.col("high"))
    return sums.select(
        "node_id", low.alias("low_freq_response"), high.alias("high_freq_response"),
        (low / (high + EPS)).alias("spectral_ratio"),
    )


# --- L5, L7, L8: degree proxies ---------------------------------------------------------------------

def _degrees(graph: FraudGraph) -> DataFrame:
    return graph.attach(undirected_degree(graph.neighbours(), "d").withColumnRenamed("node", "node_id")).fillna(0)


def degree_gap(graph: FraudGraph) -> DataFrame:
    """Degree share times the relative gap of the two largest degrees; variance; min-max log degree."""
    d = cut_lineage(_degrees(graph))
    # The two largest degrees: at most two rows per task before the last step.
    top2 = d.select("d").orderBy(F.desc("d")).limit(2).agg(F.max("d").alias("a"), F.min("d").alias("b"))
    t = one_row(top2)
    m = one_row(d.agg(
        F.max("d").alias("max"), F.var_pop("d").alias("var"), F.min("d").alias("min"),
    ))
    low, high = F.log1p(m["min"]), F.log1p(m["max"])
    gap = (t["a"] - t["b"]) / (t["a"] + EPS)
    return d.select(
        "node_id", (safe_div(F.col("d"), m["max"]) * gap).alias("degree_spectral_gap"),
        (m["var"] / (m["max"] * m["max"] + EPS)).alias("degree_variance_norm"),
        safe_div(F.log1p("d") - low, high - low).alias("log_degree_gap"),
    )


def approximate_eigenvectors(graph: FraudGraph, k: int = 15, seed: int = 42) -> DataFrame:
    """Proxies for large graphs: degree shares, then unit-length features and random mixtures."""
    names = graph.feature_names
    weights = gaussian(len(names), k, seed)
    d = _degrees(graph)
    columns = {}
    for i in range(k):
        columns[i] = F.col(names[i]) if i < min(5, len(names)) else total(
            [F.col(c) * F.lit(float(weights[j, i])) for j, c in enumerate(names)]
        )
    rows = cut_lineage(graph.features().join(d, "node_id").select("node_id", "d", *[v.alias(f"e{i}") for i, v in columns.items()]))
    m = one_row(rows.agg(F.max("d").alias("d"), *[F.sqrt(F.sum(F.col(f"e{i}") * F.col(f"e{i}"))).alias(f"n{i}") for i in range(k)]))
    out = [(F.col("d") / (m["d"] + EPS)).alias("laplacian_eig_0")]
    if k > 1:
        out.append((F.log1p("d") / (F.log1p(m["d"]) + 1)).alias("laplacian_eig_1"))
    out += [
        F.when(m[f"n{i}"] > 0, F.try_divide(F.col(f"e{i}"), m[f"n{i}"])).otherwise(F.col(f"e{i}")).alias(f"laplacian_eig_{i}")
        for i in range(2, k)
    ]
    return rows.select("node_id", *out)


def fast_laplacian_approx(graph: FraudGraph, k: int = 16) -> DataFrame:
    """L7, embedding form: degree transforms, second-order degree, and waves of the degree."""
    und = graph.neighbours()
    d = undirected_degree(und, "d")
    second = und.join(d.withColumnRenamed("node", "nbr"), "nbr").groupBy(F.col("node").alias("node_id")).agg(F.sum("d").alias("s"))
    rows = cut_lineage(graph.attach(d.withColumnRenamed("node", "node_id"), second).fillna(0))
    m = one_row(rows.agg(F.max("d").alias("d"), F.sum("d").alias("sum"), F.max("s").alias("s")))
    x = F.col("d")
    columns = [
        safe_div(x, m["d"]), safe_div(F.log1p(x), F.log1p(m["d"])), safe_div(F.sqrt(x), F.sqrt(m["d"])),
        x / (m["sum"] + EPS), safe_div(F.col("s"), m["s"]),
    ]
    for i in range(5, k):
        wave = F.sin if i % 2 == 0 else F.cos
        columns.append(wave(x * F.lit(i / k)) * 0.5 + 0.5)
    return rows.select("node_id", *[c.alias(f"laplacian_dim{i}") for i, c in enumerate(columns[:k])])


def degree_pca(graph: FraudGraph, k: int = 10) -> DataFrame:
    """Principal components of three degree transforms, zero columns up to k."""
    d = cut_lineage(_degrees(graph))
    top = one_row(d.agg(F.max("d").alias("d")))["d"]
    shapes = d.select(
        "node_id", (F.col("d") / (top + EPS)).alias("a"), (F.log1p("d") / (F.log1p(top) + 1)).alias("b"),
        (F.sqrt("d") / (F.sqrt(top) + 1)).alias("c"),
    )
    scores = pca(shapes, ["a", "b", "c"], 3, "spectral_cluster_")
    return scores.withColumns({f"spectral_cluster_{j}": F.lit(0.0) for j in range(3, k)})


# --- L6: eigenvectors -----------------------------------------------------------------------------

def held_links(links: DataFrame) -> Links | DataFrame:
    """Packed links in the partitions of their blocks, so that repeated products shuffle signals only."""
    packed = pack_links(links)
    return packed.held() if isinstance(packed, Links) else packed


def drop_links(links: Links | DataFrame) -> None:
    if isinstance(links, Links):
        links.drop()


def leading_subspace(
    links: Links | DataFrame, ids: DataFrame, k: int, iterations: int, shift: float, seed: int = 42, inner: int = 2
) -> DataFrame:
    """Orthonormal block ``q0..`` that iterates towards the leading eigenvectors of A + shift I.

    ``inner`` products are made between two orthonormalisations. Each product writes the node rows, so that the
    shuffles of one product only are on the disks, which are many times as large.
    """
    columns = [f"q{j}" for j in range(k)]
    block = ids.select("node_id", *[seeded_normal("node_id", F.lit(j), seed=seed).alias(c) for j, c in enumerate(columns)])
    block = orthonormal(cut_lineage(block), columns)
    for _ in range(iterations):
        for _ in range(inner):
            moved = with_propagated(links, block, {f"m_{c}": c for c in columns})
            block = cut_lineage(moved.select("node_id", *[(F.col(f"m_{c}") + shift * F.col(c)).alias(c) for c in columns]))
        block = orthonormal(block, columns)
    return cut_lineage(block)


def ritz(links: Links | DataFrame, block: DataFrame, k: int):
    """Eigenvalues and mixing matrix of the projected operator, largest first."""
    import numpy as np

    columns = [f"q{j}" for j in range(k)]
    moved = with_propagated(links, block, {f"m_{c}": c for c in columns})
    projected = gram(moved, columns, [f"m_{c}" for c in columns])
    values, mix = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(-values)
    return values[order], mix[:, order]


def laplacian_eigenvectors(
    graph: FraudGraph, k: int = 10, iterations: int = 8, extra: int = 4, prefix: str = "laplacian_eig_", seed: int = 42
) -> DataFrame:
    """Eigenvectors of the smallest non-trivial eigenvalues of L, by iterating on 2I - L = I + A.

    The sign of every vector makes its largest entry positive.
    """
    import numpy as np

    links = held_links(symmetric_links(graph.neighbours()))
    width = k + 1 + extra
    block = leading_subspace(links, graph.ids(), width, iterations, 1.0, seed)
    _, mix = ritz(links, block, width)
    drop_links(links)
    columns = [f"q{j}" for j in range(width)]
    vectors = cut_lineage(project(block, columns, mix[:, 1 : k + 1], prefix))
    names = [f"{prefix}{j}" for j in range(k)]
    lead = vectors.agg(*[F.max_by(c, F.abs(c)).alias(c) for c in names]).first()
    signs = {c: (-1.0 if (lead[c] or 0.0) < 0 else 1.0) for c in names}
    return vectors.select("node_id", *[(F.col(c) * F.lit(signs[c])).alias(c) for c in names])


# --- L9, L10: diffusion and attention ---------------------------------------------------------------

def scaled(graph: FraudGraph) -> FraudGraph:
    """The graph with z-scored features (population std, constant columns left centred)."""
    names = graph.feature_names
    m = one_row(graph.nodes.agg(*[f(c).alias(f"{c}_{s}") for c in names for s, f in (("m", F.avg), ("s", F.stddev_pop))]))
    z = {
        c: (F.col(c) - m[f"{c}_m"]) / F.when(m[f"{c}_s"] == 0, 1.0).otherwise(m[f"{c}_s"]) for c in names
    }
    return FraudGraph(cut_lineage(graph.nodes.withColumns(z)), graph.edges, graph.label_splits)


def graph_smoothness(graph: FraudGraph, first: int | None = None) -> DataFrame:
    """L1 on scaled features: sum of x * (L x) over all of them (or the first)."""
    rows, names = _signals(graph, first)
    out = laplacian(symmetric_links(graph.neighbours(), 0.0), rows, {f"l_{c}": c for c in names})
    return out.select("node_id", total([F.col(c) * F.col(f"l_{c}") for c in names]).alias("graph_smoothness"))


def diffusion(graph: FraudGraph) -> DataFrame:
    """One and two steps of D^-1 A X: mean and std over the columns, and the length of the first move."""
    rows, names = _signals(graph)
    links = pack_links(random_walk_links(graph.neighbours()))
    one = cut_lineage(with_propagated(links, rows, {f"p1_{c}": c for c in names}))
    two = with_propagated(links, one, {f"p2_{c}": f"p1_{c}" for c in names})
    moved = total([(F.col(f"p1_{c}") - F.col(c)) * (F.col(f"p1_{c}") - F.col(c)) for c in names])
    out = [F.sqrt(moved).alias("graph_diffusion_diffusion_change_norm")]
    for step in (1, 2):
        columns = [F.col(f"p{step}_{c}") for c in names]
        out += [mean_of(columns).alias(f"graph_diffusion_step{step}_mean"), pop_std_of(columns).alias(f"graph_diffusion_step{step}_std")]
    return two.select("node_id", *out)


def attention(graph: FraudGraph) -> DataFrame:
    """Mean cosine between a node and its neighbours of non-zero length, 0 without any."""
    rows, names = _signals(graph)
    norm = F.sqrt(total([F.col(c) * F.col(c) for c in names]))
    unit = rows.select(
        "node_id", *[safe_div(F.col(c), norm).alias(c) for c in names], (norm > 0).cast("double").alias("_some")
    )
    # The sum of cosines is the node's unit vector times the sum of its neighbours' unit vectors.
    links = graph.neighbours().withColumn("weight", F.lit(1.0))
    near = propagate(links, unit, [*names, "_some"]).select("node_id", *[F.col(c).alias(f"s_{c}") for c in [*names, "_some"]])
    joined = unit.join(near, "node_id", "left").fillna(0.0)
    dot = total([F.col(c) * F.col(f"s_{c}") for c in names])
    return joined.select("node_id", safe_div(dot, F.col("s__some")).alias("graph_attention_attention_score"))


# --- L11, L12: polynomial filters ---------------------------------------------------------------------

def beta_wavelet_coefficients(d: int) -> list[list[float]]:
    """Coefficients of (x/2)^i (1 - x/2)^(d-i) / B(i+1, d+1-i) in powers of x, for i = 0..d."""
    out = []
    for i in range(d + 1):
        beta = math.gamma(i + 1) * math.gamma(d + 1 - i) / math.gamma(d + 2)
        poly = polynomial.polymul(polynomial.polypow([0, 0.5], i), polynomial.polypow([1, -0.5], d - i)) / beta
        out.append([float(c) for c in poly] + [0.0] * (d + 1 - len(poly)))
    return out


def directed_links(edges: DataFrame) -> DataFrame:
    """Messages from source to target with weight 1/sqrt(in-degrees), degrees at least one."""
    size = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    counted = edges.groupBy(F.col("dst").alias("node"), F.col("src").alias("nbr")).agg(F.count(F.lit(1)).alias("n"))
    mine = counted.join(size, "node")
    other = mine.join(size.withColumnsRenamed({"node": "nbr", "d": "dj"}), "nbr", "left")
    return other.select("node", "nbr", (F.col("n") / F.sqrt(F.col("d") * F.coalesce("dj", F.lit(1)))).alias("weight"))


def _powers(links: Links | DataFrame, rows: DataFrame, names: list[str], order: int, scale: float) -> DataFrame:
    """Columns ``p<k>_<name>`` = (scale L)^k name for k = 0..order."""
    rows = rows.select("node_id", *[F.col(c).alias(f"p0_{c}") for c in names])
    for k in range(1, order + 1):
        rows = laplacian(links, rows, {f"p{k}_{c}": f"p{k - 1}_{c}" for c in names})
        rows = cut_lineage(rows.withColumns({f"p{k}_{c}": F.col(f"p{k}_{c}") * scale for c in names}))
    return rows


def beta_wavelet(graph: FraudGraph, d: int = 2) -> DataFrame:
    """The d + 1 beta wavelet filters of every feature."""
    rows, names = _signals(graph)
    powers = _powers(pack_links(directed_links(graph.edges)), rows, names, d, 1.0)
    thetas = beta_wavelet_coefficients(d)
    return powers.select("node_id", *[
        total([F.lit(t) * F.col(f"p{k}_{c}") for k, t in enumerate(theta)]).alias(f"wavelet_{i}_{c}")
        for i, theta in enumerate(thetas) for c in names
    ])


def bernstein_coefficients(order: int) -> list[list[float]]:
    """Coefficients of C(n, k) t^k (1 - t)^(n-k) in powers of t, for k = 0..n."""
    out = []
    for k in range(order + 1):
        poly = polynomial.polymul([0.0] * k + [float(math.comb(order, k))], polynomial.polypow([1, -1], order - k))
        out.append([float(c) for c in poly] + [0.0] * (order + 1 - len(poly)))
    return out


def bernstein_basis(graph: FraudGraph, order: int = 3, weights: list[float] | None = None) -> DataFrame:
    """Bernstein polynomials of L/2, mixed with the given weights, or each basis on its own."""
    rows, names = _signals(graph)
    simple = graph.neighbours().where(F.col("node") != F.col("nbr"))
    powers = _powers(pack_links(symmetric_links(simple, 0.0)), rows, names, order, 0.5)
    basis = bernstein_coefficients(order)

    def mixed(c: str, coefficients: list[float]) -> Column:
        return total([F.lit(float(t)) * F.col(f"p{k}_{c}") for k, t in enumerate(coefficients)])

    if weights is None:
        return powers.select("node_id", *[
            mixed(c, b).alias(f"bernstein_{k}_{c}") for k, b in enumerate(basis) for c in names
        ])
    whole = [sum(w * b[i] for w, b in zip(weights, basis)) for i in range(order + 1)]
    return powers.select("node_id", *[mixed(c, whole).alias(f"bernstein_{c}") for c in names])


# --- L13, L14: heterophily --------------------------------------------------------------------------------

ACCURACY, SLACK = 10_000, 0.001  # of the sketched ranks, as a share of 1 and in shares of all rows


def edge_scores(graph: FraudGraph, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Inner product of (p - A p) at both ends of every edge; A is normalised by out- and in-degree."""
    edges = graph.edges
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("do"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("di"))
    counted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = counted.join(out, "src").join(into, "dst").select(
        F.col("dst").alias("node"), F.col("src").alias("nbr"), (F.col("n") / F.sqrt(F.col("do") * F.col("di"))).alias("weight")
    )
    rest = cut_lineage(laplacian(links, scores, {f"l_{c}": c for c in columns}).select("node_id", *[f"l_{c}" for c in columns]))
    a = rest.select(F.col("node_id").alias("src"), *[F.col(f"l_{c}").alias(f"a_{c}") for c in columns])
    b = rest.select(F.col("node_id").alias("dst"), *[F.col(f"l_{c}").alias(f"b_{c}") for c in columns])
    dot = total([F.col(f"a_{c}") * F.col(f"b_{c}") for c in columns])
    return edges.join(a, "src").join(b, "dst").select(*edges.columns, dot.alias("score"))


def heterophily_prune(graph: FraudGraph, scores: DataFrame, columns: list[str], ratio: float) -> DataFrame:
    """Edges without the ``ratio`` share of lowest scores.

    A sketch names two scores around the cut and the rows outside them are counted; only the rows between
    are put in order. If the cut isn't between them, all are.
    """
    graph = FraudGraph(graph.nodes, cut_lineage(graph.edges), graph.label_splits)
    scored = cut_lineage(edge_scores(graph, scores, columns))
    score, order = F.col("score"), ["score", "edge_id", "src", "dst", "edge_type", "ts"]
    shares = [min(max(ratio + d * SLACK, 0.0), 1.0) for d in (-1, 1)]
    low, high = scored.agg(F.percentile_approx("score", F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias("q")).first()[0] or (None, None)
    # In the order of the sort: null, numbers, NaN.
    under = F.lit(False) if low is None else score.isNull() | (score < low)
    over = F.lit(False) if low is None else F.coalesce(score > high, F.lit(False))
    n = scored.agg(F.count_if(under).alias("under"), F.count_if(~over).alias("upto")).first()
    cut = graph.edges.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio))).first()[0]
    if not n["under"] <= cut <= n["upto"]:
        placed = with_position(scored, [], order)
        return placed.where(F.col("pos") >= cut).select(*graph.edges.columns, "score")
    between = with_position(scored.where(~under & ~over), [], order)
    kept = scored.where(over).unionByName(between.where(F.col("pos") >= cut - n["under"]).drop("pos"))
    return kept.select(*graph.edges.columns, "score")


def heterophily_stats(graph: FraudGraph) -> DataFrame:
    """Share of edges between different labels: overall, from normal and from fraud nodes."""
    labels = graph.nodes.select("node_id", "label")
    rows = graph.edges.select("src", "dst").join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst")
    differ = (F.col("a") != F.col("b")).cast("double")
    return rows.agg(
        F.avg(differ).alias("heterophily"), F.avg(F.when(F.col("a") == 0, differ)).alias("heterophily_normal"),
        F.avg(F.when(F.col("a") == 1, differ)).alias("heterophily_anomaly"),
    )


# --- L15: personalised PageRank --------------------------------------------------------------------------

def _largest(rows: DataFrame, value: str, ties: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the largest values, equal ones by ``ties``; rows are read several times.

    A sketch names two values around the cut and the rows outside them are counted; only the rows between are put
    in order. If the cut isn't between them, all are.
    """
    down, x = rows.withColumn("_down", -F.col(value)), F.col(value)
    total = rows.count()
    if n >= total:
        return rows
    shares = [min(max(1 - n / total + d * SLACK, 0.0), 1.0) for d in (-1, 1)]
    low, high = rows.agg(F.percentile_approx(value, F.array(*[F.lit(s) for s in shares]), F.lit(ACCURACY)).alias("q")).first()[0]
    counts = rows.agg(F.count_if(x > high).alias("over"), F.count_if(x >= low).alias("upto")).first()
    if not counts["over"] <= n <= counts["upto"]:
        return with_position(down, [], ["_down", *ties]).where(F.col("pos") < n).select(*rows.columns)
    between = with_position(down.where((x >= low) & (x <= high)), [], ["_down", *ties])
    chosen = between.where(F.col("pos") < n - counts["over"]).select(*rows.columns)
    return rows.where(x > high).unionByName(chosen)


def ppr_augment(
    graph: FraudGraph, mean_degree: int = 8, alpha: float = 0.05, steps: int = 10, prune: float = 1e-3
) -> DataFrame:
    """Diffusion alpha sum (1 - alpha)^k T^k with self loops, the strongest pairs kept, columns normalised.

    Mass below ``prune`` is not pushed on, which bounds the pairs per source by 1/prune.
    """
    und = graph.neighbours()
    loops = graph.nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("nbr"))
    links = cut_lineage(symmetric_links(und.where(F.col("node") != F.col("nbr")).unionByName(loops), 0.0))
    steps_on = links.toDF("v", "w", "y")
    front = graph.nodes.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(1.0).alias("mass"))
    parts = [front.withColumn("mass", F.col("mass") * alpha)]
    for _ in range(steps):
        front = cut_lineage(path_masses(front.toDF("u", "v", "x"), steps_on, 1 - alpha, prune).toDF("start", "node", "mass"))
        parts.append(front.withColumn("mass", F.col("mass") * alpha))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    pairs = cut_lineage(union.groupBy("start", "node").agg(F.sum("mass").alias("mass")))
    # The pairs are all that is read from here on; the links and the steps can be deleted.
    del links, steps_on, front, parts, union
    kept = _largest(pairs, "mass", ["start", "node"], graph.nodes.count() * mean_degree)
    sums = kept.groupBy("node").agg(F.sum("mass").alias("all"))
    return kept.join(sums, "node").select(
        F.col("start").alias("src"), F.col("node").alias("dst"), (F.col("mass") / F.col("all")).alias("weight")
    )
