"""Centroid clustering, sharding and the prefix trie next to plain Python, on rows with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.llm import simplex_clusters
from ringsight.llm.prefix_trie import prefix_trie
from ringsight.llm.sharding import assign_shards, shard_of, write_shards
from ringsight.llm.simplex_clusters import apexes, cluster_vectors, pivots_of


def plain_clusters(rows, number, rounds, width):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in e]))
    name = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, name(r[0]) if r[0] is not None else "", r[1]))[:number]
    centroids = [list(v) for _, v in first]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((square(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[place(v)[1]].append(v)
        centroids = [[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else c for k, c in enumerate(centroids)]
    found = [(i, *place(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in found:
        inertia[k] += d
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), digest(k)) for i, d, k in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, cluster string")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_plain_code(spark, seed):
    rng = random.Random(seed)
    width, middle = 6, [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middle)]) for i in range(120)]
    rows += [(500, rows[0][1])] * 60 + [(None, rows[1][1]), (7, rows[2][1]), (7, rows[2][1])]
    rows += [(900, None), (901, [1.0]), (902, [*rows[0][1][:5], None]), (903, [*rows[0][1][:5], float("nan")]), (904, [float("inf")] * 6), (905, [])]
    rows += [(906, [0.0] * 6), (907, [-0.0] * 6), (908, [1000.0, 0.0, 0.0, 0.0, 0.0, -1000.0])]
    got = cluster_vectors(vectors(spark, rows).repartition(5), number=9, rounds=3, dimensions=width, pivots=4)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r.vec_id), *[r[n] for n in names]) for r in got.collect()) == plain_clusters(rows, 9, 3, width)
    assert got.where("n_compared < 1 or n_compared > 9").isEmpty()


def test_few_equal_and_no_vectors(spark):
    rows = [(i, [0.5, -0.25, 0.125]) for i in range(5)]
    got = cluster_vectors(vectors(spark, rows), number=9, dimensions=3).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 5
    assert cluster_vectors(vectors(spark, [(1, [1.0])]), dimensions=3).isEmpty()


def test_bounds_hold_and_save_comparisons(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 64)) * 100
    points = np.floor(middle[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 10).astype(np.int64)
    pivots, base = pivots_of(points[:40], 8)
    near = np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1)
    apex = apexes(near, base)
    real = np.sqrt(((points[:500, None] - points[None, 500:600]) ** 2).sum(axis=2))
    span = ((apex[:500, None, :-1] - apex[None, 500:600, :-1]) ** 2).sum(axis=2)
    low = np.sqrt(span + (apex[:500, None, -1] - apex[None, 500:600, -1]) ** 2)
    high = np.sqrt(span + (apex[:500, None, -1] + apex[None, 500:600, -1]) ** 2)
    assert (low <= real + 1e-3).all() and (real <= high + 1e-3).all()
    cents = points[:40]
    cluster, least, compared = simplex_clusters.nearest(points, near, cents, base, near[:40])
    square = ((points[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (cluster == square.argmin(axis=1)).all() and (least == square.min(axis=1)).all()
    assert compared.mean() < 12


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], "doc_id long, text string, lang string, shard string, n_chars long")


def test_shards_match_plain_code(spark):
    rows = [(i, f"text {i % 7} é") for i in range(400)] + [(None, None), (None, ""), (3, "a"), (3, "a")] + [(17, "same")] * 200
    docs = documents(spark, rows)
    weights = [1.0, 2.0, 0.0, 0.5]

    def won(key, ws):
        u = lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min((-math.log(u(s)) / w, s) for s, w in enumerate(ws) if w)[1]

    got = assign_shards(docs, weights, more=1.5).collect()
    assert len(got) == len(rows)
    keyed = Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    assert keyed == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for r in got:
        key = "null" if r.doc_id is None else r.doc_id
        assert (r.law, r.shard, r.grown_shard) == ("key", won(key, weights), won(key, [*weights, 1.5]))
        assert r.grown_shard in (r.shard, len(weights))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert assign_shards(docs.limit(0)).isEmpty()


def test_weights_and_moves(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    share = {r.s: r["count"] / 20_000 for r in ids.select(shard_of(F.col("doc_id"), [1, 3, 4]).alias("s")).groupBy("s").count().collect()}
    assert all(abs(share[s] - w) < 0.02 for s, w in enumerate([0.125, 0.375, 0.5]))
    both = ids.select(shard_of(F.col("doc_id"), [1.0] * 8).alias("a"), shard_of(F.col("doc_id"), [1.0] * 7).alias("b"))
    assert both.where("a <> b and a <> 7").isEmpty() and 0.1 < both.where("a = 7").count() / 20_000 < 0.15
    with pytest.raises(ValueError):
        shard_of(F.col("doc_id"), [0.0])


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = documents(spark, [(i, "t") for i in range(50)] + [(None, None)])
    write_shards(docs, str(tmp_path / "out"), [1.0] * 4, parts=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 51 and back.where(F.col("_shard") != shard_of(F.col("doc_id"), [1.0] * 4)).isEmpty()


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((t is not None, t or 0, tie, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + s[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, s in sorted(built.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
        ends[tuple(s)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    out = []
    for n, m in members.items():
        inside = [x for x in members if x[: len(n)] == n]
        saved = sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in inside if x)
        out.append((
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], sum(kids[x] == 0 for x in inside), saved,
            hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    given = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(given.repartition(7)).collect()), key=str)


def test_trie_matches_plain_code(spark):
    rng = random.Random(4)
    rows = []
    for c in range(100):
        start = rng.choice([("user", "hello there friend"), ("user", "hi"), (None, None)])
        turns = [start] + [(rng.choice(["user", "bot"]), rng.choice(["a b", "c", "", "d e f"])) for _ in range(rng.randint(0, 5))]
        rows += [(c, k if rng.random() > 0.05 or k else None, *t) for k, t in enumerate(turns)]
    rows += [(c, k, "user", "copied words here") for c in range(200, 300) for k in range(3)]  # one large group of copies
    rows += [(41, 90, "u", "end"), (5, 91, "u", "x"), (5, 91, "u", "x")]  # repeated rows
    rows += [(None, 0, "user", "no conversation"), (-7, 0, "u", "below zero"), (1234567, 0, "u", "alone")]
    rows += [(777, k, "u", f"turn {k}") for k in range(70)]  # far deeper than the others
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_turnless_and_empty(spark):
    # Conversations without a first one of their group lose their own first turns.
    rows = [(c, 0, "u", "only") for c in range(21, 40)]
    got = trie_rows(spark, rows)
    assert got == plain_trie(rows) and got[0][3] <= 19
    assert trie_rows(spark, [(None, 1, "u", "x")]) == []
