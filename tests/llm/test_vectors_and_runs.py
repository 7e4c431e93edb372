"""Dimension-sharded rounds, word runs and learned partitions against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from marketweave.llm import ann, centroids, runs
from tests_llm_data import documents, prose

ODD = [None, [], [float("nan")] * 64, [None] * 64, [1.0] * 63, [float("inf")] * 64]


def table(spark, rows):
    """An embeddings table with extra columns whose names the operators use inside."""
    data = [(i, v, "x", 1, 2, 0.5, 7) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, x string, part int, cluster int, score double, rank int")


# --- centroid clustering


def lloyd(rows, k, rounds):
    """Rounds over Python's whole numbers, one vector after another."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, label) in zip(kept, near) if label == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    return kept, assign(), centres


@pytest.mark.parametrize("cells", [(7, 16), (2048, 64), (50, 24)])
def test_lloyd_equals_brute_force(spark, cells):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a third of the rows is one vector
    rows += [(i, (rng.normal(size=64) * 900).tolist()) for i in range(300, 310)] + [(5, rows[6][1]), (None, rows[7][1])]
    rows += [(900 + i, v) for i, v in enumerate(ODD)]
    out, centres = centroids.clusters(table(spark, rows), k=9, rounds=5, cell_rows=cells[0], block_columns=cells[1])
    kept, near, want = lloyd(rows, 9, 5)
    assert centres.tolist() == want
    key = lambda r: (-1 if r[0] is None else r[0], r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out.collect()), key=key) == sorted(((i, n, d) for (i, _), (d, n) in zip(kept, near)), key=key)


def test_lloyd_of_few_none_and_far_vectors(spark):
    assert centroids.cluster_report(table(spark, [])).collect() == []
    got = centroids.cluster_report(table(spark, [(1, [0.5] * 64), (2, [0.25] * 64), (3, ODD[2])])).collect()
    assert {r.vec_id for r in got} == {1, 2} and {(r.distance, r.cluster_inertia, r.inertia) for r in got} == {(0, 0, 0)}
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(",".join([str(n)] * 64).encode()).hexdigest() for n in (128, 64)}
    # whole numbers beyond the range where products in doubles are exact
    x, c = np.array([[centroids.LARGEST - 1, -centroids.LARGEST + 2]]), np.array([[-centroids.LARGEST + 1, 3]])
    assert centroids.partial_distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], c[0]))]]
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster_report(table(spark, [(1, [1e9] * 64)])).collect()


# --- word runs


def longest_lyndon(s):
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]


def all_runs(s, shortest, exponent):
    """Stretches of every period; those a smaller period covers are not runs of their own."""
    found = []
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, exponent * q, 2 * q) and not any(a <= i and i + size <= a + n for a, n, _ in found):
                found.append((i, size, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_grouping_yields_lyndon_arrays_and_all_runs():
    rng = random.Random(6)
    for _ in range(600):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 36))]
        if len(s) > 4 and rng.random() < 0.5:
            p, a = rng.randint(1, len(s) // 3 or 1), rng.randrange(len(s))
            s = [s[min(i, a + (i - a) % p) if i >= a else i] for i in range(len(s))]
        for ranks in (s, [-x for x in s]):
            assert runs.lyndon_lengths(ranks) == longest_lyndon(ranks)
        words = [b"%d" % x for x in s]
        for shortest, exponent in ((6, 4), (2, 2), (4, 3), (3, 2.5)):
            assert runs.word_runs(words, shortest, exponent) == all_runs(s, shortest, exponent)


def test_run_report_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 90)) for _ in range(150)]
    texts += ["a b " * 9 + "c", "x y " * 7, "z" + "\t \r\nz" * 6, "", None, " \x0b\n ", "one", "no no no no no no yes", " ".join(["ab"] * 30000)]
    rows = list(enumerate(texts)) + [(None, "q r " * 5), (3, texts[3]), (3, texts[3])]
    base = documents(spark, rows).selectExpr("*", "1 AS runs", "2 AS collapsed", "'t' AS n_words")
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in runs.run_report(base).collect()}
    want = set()
    turned = 0
    for i, text in rows:
        w = (text or "").encode().split()
        h = zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
            turned += 1
        found = all_runs(w, 6, 4) if len(w) < 5000 else [(0, len(w), 1)]
        gone = {j for a, n, q in found for j in range(a + q, a + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.add((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert turned > 8 and got == want
    assert runs.run_report(base.limit(0)).collect() == []


def test_runs_and_text_without_repetitions(spark):
    rows = spark.createDataFrame([("k", "so it goes on and on and on and on and on then")], "name string, body string")
    (r,) = runs.periodic_runs(rows, ("name",), "body").collect()
    assert (r.name, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == ("k", 13, [(3, 9, 2)], "so it goes on and then")


# --- learned partitions


def exact(rows, k, every):
    """All distances, row by row; as the contract says, without an index."""
    sound = [(i, np.array([np.float32(c) for c in v], dtype=float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in sound:
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in sound if j != i and len(v) == len(q))
            out[i] = near[:k]
    return out


def found_rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_learned_partitions_find_most_neighbours(spark):
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(40, 16)) * 2
    rows = [(i, (middles[i % 40] + rng.normal(size=16) * 0.6).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[20][1]) for i in range(1500)]  # a third of the rows is one vector
    got = found_rows(ann.approximate_neighbours(table(spark, rows), k=10, every=20, sample_rows=1600, part_rows=150, shard_rows=400, block_rows=64))
    want = exact(rows, 10, 20)
    assert got.keys() == want.keys() and all(len(got[i]) == 10 for i in want)
    hits = sum(len({round(s, 9) for s, _ in got[i]} & {round(s, 9) for s, _ in want[i]}) / len({round(s, 9) for s, _ in want[i]}) for i in want)
    assert hits / len(want) >= 0.9
    assert got[20] == want[20]  # ties go to the smaller id
    known = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(abs(s - np.sqrt(((known[i] - known[j]) ** 2).sum())) < 1e-12 for i in got for s, j in got[i])


def test_learned_partitions_visit_few_parts(spark):
    rng = np.random.default_rng(10)
    middles = rng.normal(size=(24, 8)) * 6
    rows = table(spark, [(i, (middles[i % 24] + rng.normal(size=8)).tolist()) for i in range(2400)])
    router = ann.learn(ann.sound_rows(rows), 8, 2400, 1600, 100, 8, 10, 0.95)
    assert len(router.offsets) == 24 and router.probes <= 6 and router.expected >= 0.95


def test_parts_are_balanced_and_cut_few_edges(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 6)) + 5 * rng.normal(size=(6, 6))[np.arange(600) % 6]
    near = ann.neighbour_graph(spark, x, 8)
    for i in (0, 77, 599):
        distance = ((x - x[i]) ** 2).sum(axis=1)
        assert set(near[i]) == set(np.argsort(distance)[1:9])
    label = ann.balanced_partition(x, near, 6)
    assert np.bincount(label).tolist() == [100] * 6
    crossing = lambda part: (part[near] != part[:, None]).mean()
    assert crossing(label) <= crossing(ann.halved(x, 6, 3))


def test_learned_partitions_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [1.0, 2.0, 3.0]), (501, [1.0, 2.0, 4.0]), (502, []),
            (7, [1.0, 0.0]), (8, [1.0, 0.0]), (0, [3.0, 3.0]), (None, [1.0, 1.0]), (600, [0.5, 0.5]), (600, [0.5, 0.5]), (9, [float("inf"), 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.approximate_neighbours(table(spark, rows)).collect()]
    assert {g for g in got if g[0] == 500} == {(500, 1, 501, 1.0)}
    assert {g[1:3] for g in got if g[0] == 600} == {(1, 7), (2, 8), (3, 0), (4, 0)} or {g[2] for g in got if g[0] == 600} == {7, 8, 0}
    assert {g[2] for g in got if g[0] == 0} == {7, 8, 600} and not any(g[0] in (100, 200, 300, 400) for g in got)
    assert ann.approximate_neighbours(table(spark, [])).collect() == []
    assert ann.approximate_neighbours(table(spark, [(0, [1.0])])).collect() == []
