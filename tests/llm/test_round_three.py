"""Ball k-means, the filter audit and MinHash with tensored banding, beside plain loops."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from docgraph.llm import filter_audit, kmeans, minhash, queries


def kmeans_by_loops(rows, k, dim, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in hashed[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centres)), key=lambda j: (far(v, centres[j]), j))
    for _ in range(rounds):
        of = [nearest(v) for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    of = [nearest(v) for _, v in kept]
    d = [far(v, centres[c]) for (_, v), c in zip(kept, of)]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, x, sum(y for y, e in zip(d, of) if e == c), sum(d), name[c]) for (i, _), c, x in zip(kept, of, d)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, id string, v string, cluster string, distance string"


def some_vectors(n=400, dim=6, seed=1):
    r = random.Random(seed)
    hubs = [[r.uniform(-2, 2) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in r.choice(hubs)]) for i in range(n)]
    odd = [(n, None), (n + 1, []), (n + 2, [0.5] * (dim - 1)), (n + 3, [None] + [0.1] * (dim - 1)), (n + 4, [float("nan")] * dim), (n + 5, [float("-inf")] * dim), (None, [0.25] * dim)]
    return rows + odd + rows[:30] + [(n + 10 + i, rows[0][1]) for i in range(40)] + [(n + 60 + i, [0.0] * dim) for i in range(5)]


@pytest.mark.parametrize("k,rounds", [(12, 4), (1, 2), (600, 2), (3, 0)])
def test_clusters_equal_loops(spark, k, rounds):
    rows = some_vectors()
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z", "d") for i, v in rows], VECTORS).repartition(5)
    got = kmeans.cluster_embeddings(df, k=k, dim=6, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=str) == kmeans_by_loops(rows, k, 6, rounds)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert kmeans.cluster_embeddings(df).collect() == []
    only_odd = spark.createDataFrame([(1, None, 1, "", "", "", ""), (2, [1.0], 1, "", "", "", "")], VECTORS)
    out = kmeans.cluster_embeddings(only_odd)
    assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    huge = spark.createDataFrame([(1, [1e300, 0.0], 1, "", "", "", "")], VECTORS)
    with pytest.raises(ValueError):
        kmeans.cluster_embeddings(huge, dim=2)


def test_balls_compare_neighbours_only():
    r = np.random.default_rng(4)
    centres = r.integers(-4000, 4000, (40, 16))
    x = centres[r.integers(0, 40, 3000)] + r.integers(-300, 300, (3000, 16))
    first, distance, all_pairs = kmeans.Balls(centres).assign(x, None, None)
    assert all_pairs == 3000 * 40
    moved = centres + r.integers(-20, 20, centres.shape)
    moved[3] = centres[3]
    most = np.array([distance[first == j].max(initial=0) for j in range(40)])
    radius = np.sqrt(most) + np.sqrt(((moved - centres) ** 2).sum(1))
    got, d, compared = kmeans.Balls(moved, radius, (moved != centres).any(1)).assign(x, first, distance)
    want = kmeans.squared(x, moved)
    assert (got == want.argmin(1)).all() and (d == want.min(1)).all()
    assert compared < 3 * 3000  # one's own centre and few neighbours
    large = x * 5000  # beyond what doubles hold
    assert (kmeans.squared(large, moved * 5000) == want * 25_000_000).all()


@pytest.mark.parametrize("spread", [1, 2, 3])
def test_balls_with_ties(spread):
    r = np.random.default_rng(spread)
    x = r.integers(-spread, spread + 1, (500, 3))
    centres = r.integers(-spread, spread + 1, (20, 3))
    cluster, distance, _ = kmeans.Balls(centres).assign(x, None, None)
    for _ in range(4):
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else centres[j] for j in range(20)])
        radius = np.array([np.sqrt(distance[cluster == j].max(initial=0)) for j in range(20)]) + np.sqrt(((new - centres) ** 2).sum(1))
        cluster, distance, _ = kmeans.Balls(new, radius, (new != centres).any(1)).assign(x, cluster, distance)
        centres = new
        assert (cluster == kmeans.squared(x, centres).argmin(1)).all()


def audit_by_loops(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ")
        w = [x for x in w if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in docs)
        rows.append((s or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for n, f in enumerate(order):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                total[f] += len(gone)
                steps.append((part, "".join(order), n + 1, len(stay), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
                left = stay
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_equals_loops(spark, make):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(r.choice(words[: r.choice([40, 400])]) for _ in range(r.choice([50, 250]))) + r.choice(["", " #", " A" * 40]), r.choice("abc")) for i in range(60)]
    docs += [(100 + i, docs[i][1], r.choice(["a", None, ""])) for i in range(15)]
    docs += [(200, None, "a"), (201, "", None), (None, docs[0][1], "b"), (None, None, None), (5, docs[5][1], "c"), (202, "x y " * 90_000, "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(80)] + [(3, 1, 1), (None, 1, 1)]
    got = filter_audit.audit(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(x) for x in got.collect()) == audit_by_loops(docs, labels)


def test_audit_of_nothing(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, none).collect() == []
    assert filter_audit.audit(odd, none).count() == 600 * odd.selectExpr("coalesce(source, '')").distinct().count()


def sets_by_loops(texts, n=4):
    out = []
    for t in texts:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def near_by_loops(rows):
    sets, root = sets_by_loops([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def near_texts(seed, copies, change):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 90)))) for i in range(60)]
    base = [r.choice(words) for _ in range(120)]
    for i in range(copies):  # a chain of edits and a star of edits around one text
        w = list(base)
        for _ in range(r.randint(0, change)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((100 + i, " ".join(w)))
        if i % 3 == 0:
            base = w
    template = " ".join(r.choice(words) for _ in range(30))
    rows += [(500 + i, template + " " + " ".join(r.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(600, "One two"), (601, "one\tTWO "), (602, "one"), (603, "one two three"), (604, None), (605, ""), (606, " \n"), (607, ""), (600, "one two three four five"), (None, "one two"), (None, "alone here"), (608, rows[0][1].upper()), (1, rows[1][1])]
    return rows


@pytest.mark.parametrize("seed,copies,change", [(1, 60, 3), (2, 120, 6), (3, 40, 12)])
def test_near_copies_equal_loops(make, seed, copies, change):
    rows = near_texts(seed, copies, change)
    got = minhash.near_duplicates(make(rows).repartition(3)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    # 0.0006 of the pairs at exactly 0.8 may not meet; none of these do
    assert sorted((tuple(r) for r in got), key=str) == near_by_loops(rows)


def test_near_copies_odd(odd, empty, make):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == by[None].component_id == 1 and not by[2].kept and not by[None].kept
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[3].kept and by[4].kept
    assert by[7].n_shingles > 100_000
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and 2 not in {r.doc_id for r in kept.collect()}


def test_tables_are_pairs_of_half_keys():
    r = np.random.default_rng(0)
    flat, start = r.integers(0, 1 << 62, 500).astype(np.uint64), np.array([0, 200, 200, 500])
    x = minhash.half_keys(flat, start, 8, 2)
    assert x.shape == (3, 16) and not x[1].any()
    again = minhash.half_keys(np.r_[flat[:200][::-1], flat[:200]], np.array([0, 200, 400]), 8, 2)
    assert (again[0] == x[0]).all() and (again[1] == x[0]).all()  # of the set alone


@pytest.mark.parametrize("name,n", [("op11_ball_kmeans", 200), ("op13_minhash", 200)])
def test_queries_return_all_rows(spark, sf, name, n):
    assert queries.queries()[name](spark, sf).count() >= n


def test_query_equals_loops(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_minhash(spark, sf).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == near_by_loops(docs)
