"""The Jaccard join, runs of words and the trie of conversations against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from hammerlake.llm import jaccard, periodic, tries

SF = "/root/testdata/sf0.001"


def brute_components(rows):
    """(doc_id, size, smallest doc_id reachable) from sets of whole shingles, each pair with a common one compared."""
    sets, holders, up = [], defaultdict(list), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (_, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        common = defaultdict(int)
        for g in sets[k]:
            for other in holders[g]:
                common[other] += 1
            holders[g].append(k)
        for other, n in common.items():
            if 100 * n >= 80 * (len(sets[k]) + len(sets[other]) - n):
                up[find(k)] = find(other)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def edited(seed, count):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.choice([3, 5, 6, 10, 30, 80, 200]))] for _ in range(8)]
    for i in range(count):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = rng.choice([[], ["x" * rng.randint(1, 9)], ["zz%d" % rng.randrange(99)]])
            w = w or ["x"]
        yield i, " ".join(w)


@pytest.mark.parametrize("hot", [1024, 9])
def test_similar_documents(spark, monkeypatch, hot):
    """With small blocks too, so that most tiles are divided."""
    monkeypatch.setattr(jaccard, "HOT_TILE", hot)
    rows = [*edited(hot, 250), (900, None), (901, "\t "), (902, "A b"), (903, "a B"), (904, "a")]
    found = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == brute_components(rows)


def test_similar_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in jaccard.similar_documents(docs).collect()) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_bounds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, m = rng.integers(1, 60, 2)
        pool = rng.integers(0, 1 << 63, n + m).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(rng.choice(pool, m))
        common, sizes = len(np.intersect1d(a, b)), np.array([len(a), len(b)])
        maps = jaccard.folded([jaccard.signature(a), jaccard.signature(b)])
        linked = 100 * common >= 80 * (len(a) + len(b) - common)
        assert bool(jaccard.alike(np.array([common]), sizes[:1], sizes[1:])[0]) == linked
        assert not linked or jaccard.may_be_alike(sizes, maps, 0, np.array([1]))[0]
        # in any order of the elements, the first few of linked sets meet
        assert not linked or set(a[: jaccard.prefix_size(len(a))]) & set(b[: jaccard.prefix_size(len(b))])


def brute_runs(w, least, exponent):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.add((s, n, q))
    return out


def test_lyndon_runs():
    rng = random.Random(3)
    for _ in range(3000):
        n, k = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 20])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 5:
                a, p = rng.randrange(n), rng.randint(1, 8)
                for x in range(a, min(n, a + rng.randint(5, 70))):
                    w[x] = w[a + (x - a) % p]
        least, exponent = rng.choice([(24, 3), (6, 3), (4, 2), (9, 3)])
        want, numbers = brute_runs(w, least, exponent), np.array(w, np.int64)
        assert periodic.lyndon_runs(numbers, least, exponent) == want
        parts = periodic.suspects(numbers, least, exponent)
        assert {(s + a, n, q) for a, b in parts for s, n, q in periodic.lyndon_runs(numbers[a:b], least, exponent)} == want


def test_long_runs_are_read_once():
    assert periodic.lyndon_runs(np.zeros(200_000, np.int64)) == {(0, 200_000, 1)}
    assert periodic.lyndon_runs(np.tile(np.arange(5000), 20)) == {(0, 100_000, 5000)}


def brute_digest(i, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = sorted(brute_runs(w, 24, 3), key=lambda r: (r[0], r[2]))
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *numbers, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_runs_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000").select("doc_id", "text")
    odd = [(10**6 + k, t) for k, t in enumerate([None, "", "a " * 100, "a b " * 12, "x " + "a b c " * 30 + "y", " ".join(map(str, range(50))), "p q " * 30 + "r s t " * 40])]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = periodic.digest(periodic.find_runs(periodic.repeat_tails(rows)))
    want = sorted(brute_digest(r.doc_id, r.text) for r in rows.collect())
    assert sorted(tuple(r) for r in found.collect()) == want and sum(x[1] > 0 for x in want) > 10


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    for x in own.values():
        x.sort()
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(x[2:] for x in own.get(c - c % 5, [])[:h] + own[c][h:])
    nodes, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    for s in nodes:
        if s:
            children[s[:-1]] += 1
    for s, m in nodes.items():
        for d in range(len(s) + 1):
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
            leaves[s[:d]] += s not in children
    ends = lambda s, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if made[c] == s))).encode()).hexdigest()
    return sorted((min(m), len(s), min(nodes[s[:-1]]) if s else -1, len(m), children[s], leaves[s], saved[s], ends(s, m)) for s, m in nodes.items())


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_trie(spark, blocks):
    """Any number of blocks; with 40, nodes reach over many blocks and some blocks are empty."""
    rng, rows = random.Random(blocks), [(None, 1, "a", "b")]
    for c in rng.sample(range(160), 90):
        for t in range(rng.randint(1, 14)):
            if t == 0 or rng.random() < 0.9:
                rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "a", None]) if rng.random() < 0.2 else "user", rng.choice(["x", "yé", None, ""]) if rng.random() < 0.3 else "same"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = tries.prefix_trie(tries.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
        got = sorted(tuple(-1 if x is None else x for x in r) for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_trie(rows)


def test_odd_tables(spark):
    extra = "lang string, key string, n long, block int, tile long"
    none = spark.createDataFrame([], f"doc_id long, text string, {extra}")
    rows = spark.createDataFrame([(1, "a b", *[None] * 5), (1, "a b", *[None] * 5), (None, "a b", *[None] * 5), (None, None, *[None] * 5), (None, "only here", *[None] * 5), (2, "w " * 30000, *[None] * 5)], none.schema)
    for run in (jaccard.similar_documents, lambda d: periodic.digest(periodic.find_runs(d))):
        assert run(none).count() == 0 and run(rows).count() == 6
    assert sorted((r.doc_id, r.component_id) for r in jaccard.similar_documents(rows).collect() if r.n_shingles and r.doc_id) == [(1, 1), (1, 1), (2, 2)]
    assert {r.component_id for r in jaccard.similar_documents(rows).collect() if r.doc_id is None} == {None, 1}
    talk = spark.createDataFrame([], f"conv_id long, turn long, role string, text string, {extra}")
    assert tries.prefix_trie(tries.rebuilt(talk)).count() == 0
    same = spark.createDataFrame([(c, 0, "u", "hello", *[None] * 5) for c in (3, 3, 8)], talk.schema)
    assert {(r.depth, r.n_convs) for r in tries.prefix_trie(tries.rebuilt(same)).collect() if r.depth == 0} == {(0, 2)}
