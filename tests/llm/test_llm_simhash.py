import random

import numpy as np
import pytest
from cases import ROWS, documents, table
from xxhash import xxh64_intdigest

from quarrydf.llm import common, simhash
from quarrydf.llm.components import components


def print_of(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    counts = [0] * 64
    for p in parts:
        h = xxh64_intdigest(p, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows):
    """Sorted (id, fingerprint, smallest id reachable) of (id, text) rows."""
    prints = [print_of(t) for _, t in rows]
    a = np.array(prints, np.uint64)
    edges = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)]
    root = roots(len(rows), edges)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted([(d, f"{p:016x}", least.get(root[i])) for i, ((d, _), p) in enumerate(zip(rows, prints))], key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, simhash.op4_simhash(spark, sf).collect()), key=str) == brute(rows)


def test_awkward_rows(spark, tmp_path):
    folder = table(spark, tmp_path, documents=documents(spark, ["fp", "node", "component_id", "least_id"]))
    got = sorted(map(tuple, simhash.op4_simhash(spark, folder).collect()), key=str)
    assert got == brute([r[:2] for r in ROWS])
    assert {(2, "0" * 16, 2), (3, "0" * 16, 2), (4, "0" * 16, 2), (5, got[0][1], 1)} <= {*got, (5, got[0][1], 1)}
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("size,short,width", [(8192, 12, 3), (64, 12, 3), (16, 3, 3), (8192, 10**9, 3), (8192, 10**9, 1), (8192, 5, 2), (16, 3, 4)])
def test_lists_of_any_length_lose_no_link(spark, monkeypatch, size, short, width):
    """Fingerprints close to a few centres: long posting lists, cut into blocks where they exceed the size."""
    monkeypatch.setattr(simhash, "LIST", size)
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(3)
    found = set()
    for centre in rng.integers(0, 1 << 63, 6, dtype=np.uint64):
        for _ in range(80):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            found.add(x)
    prints = sorted(found)
    a = np.array(prints, np.uint64)
    want = roots(len(prints), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)])
    entries = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "node long").repartition(4)
    links = simhash.links(entries, 3, width).collect()
    place = {int(np.uint64(p).astype(np.int64)): i for i, p in enumerate(prints)}
    edges = [(place[r["u"]], place[r["v"]]) for r in links]
    assert all(int(np.bitwise_count(a[x] ^ a[y])) <= 3 for x, y in edges)
    assert roots(len(prints), edges) == want


def test_pairs_below_the_guaranteed_minimum_are_dropped(spark, monkeypatch):
    """With the verification out of the way, what is left are the pairs that share at least five positional bytes."""
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 3, (60, 8), dtype=np.uint8)
    nodes = sorted({int(x) for x in raw.view(">i8")[:, 0].astype(np.int64)})
    monkeypatch.setattr(simhash, "SHORT", 10**9)
    monkeypatch.setattr(simhash.F, "bit_count", lambda c: simhash.F.lit(0))
    same = lambda a, b: sum(x == y for x, y in zip((a & 2**64 - 1).to_bytes(8), (b & 2**64 - 1).to_bytes(8)))
    want = sorted((a, b) for a in nodes for b in nodes if a > b and same(a, b) >= 5)
    for width in (1, 2, 3):
        got = simhash.links(spark.createDataFrame([(x,) for x in nodes], "node long"), 3, width)
        assert sorted(map(tuple, got.collect())) == want and want
    with pytest.raises(ValueError):
        simhash.links(got, 3, 6)


@pytest.mark.parametrize("together, at_once", [(1 << 14, 1 << 17), (40, 15)])
def test_components_of_random_graphs(spark, monkeypatch, together, at_once):
    monkeypatch.setattr("quarrydf.llm.components.TOGETHER", together)
    monkeypatch.setattr("quarrydf.llm.components.AT_ONCE", at_once)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3)], "u long, v long")
    want = roots(6000, edges)
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert {r["node"]: r["root"] for r in components(df).collect()} == {n: want[n] for n in nodes}
    assert components(df.limit(0)).count() == 0


def near(rng, words, changes):
    out = list(words)
    for at in rng.sample(range(len(words)), changes):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_one_of_each(spark):
    rng = random.Random(4)
    rows, wanted = [], set()
    for g in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        base = 100 * g
        rows.append((base, " ".join(words)))
        wanted.add(base)
        rows.append((base + 1, " ".join(words).upper()))  # an exact copy but for case
        rows.append((base + 2, " ".join(near(rng, words, 3))))  # 0.9
        far = " ".join(near(rng, words, 45))  # below 0.4
        rows.append((base + 3, far))
        wanted.add(base + 3)
    rows += [(5000, None), (5001, ""), (5002, "  \n"), (None, "no id at all here"), (None, "no id at all here")]
    wanted |= {5000, None}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted(wanted, key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_names_of_its_own_may_be_taken(spark):
    names = ["key", "no_key", "digest", "copy", "row", "id", "node", "first", "ok", "fp", "n", "root"]
    df = documents(spark, names)
    with common.scratch(spark) as own:
        kept = simhash.one_of_each(df)
        assert kept.columns == df.columns and all(r[c] == "mine" for r in kept.collect() for c in names)
        assert len(own.paths) == 1
        assert len(simhash.near_duplicates(df).collect()) == len(ROWS) and len(own.paths) == 2


@pytest.mark.parametrize("size,short", [(8192, 12), (16, 3)])
def test_one_of_each_against_exact_similarity(spark, monkeypatch, size, short):
    """Scattered edits around 0.8, a hub whose copies are far from each other, and a passage that many texts share."""
    monkeypatch.setattr(simhash, "LIST", size)
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = random.Random(8)
    texts, passage = [], [f"p{i}" for i in range(80)]
    for length in [6, 9, 30, 60, 100, 200, 400] * 12:
        words = [f"w{rng.randrange(9000)}" for _ in range(length)]
        texts += [words, near(rng, words, max(1, round(length * rng.uniform(0.018, 0.03))))]
    hub = [f"h{rng.randrange(9000)}" for _ in range(200)]
    texts += [near(rng, hub, 4) for _ in range(40)] + [hub]
    texts += [passage + [f"q{rng.randrange(9000)}" for _ in range(rng.choice([5, 15, 25]))] for _ in range(40)]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    scores = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    assert sum(0.78 <= x < 0.8 for x in scores.values()) > 5 and sum(0.8 <= x < 0.86 for x in scores.values()) > 20
    root = roots(len(texts), [p for p, x in scores.items() if x >= 0.8])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(set(root))


def test_fingerprints_link_in_one_of_each(spark, monkeypatch):
    """With both other ways to pairs switched off, the SimHash links that pass the exact check decide alone."""
    rng, texts = random.Random(12), []
    for g in range(30):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([200, 400, 800]))]
        texts += [words, near(rng, words, 1), near(rng, words, 2), words + words[:2]]
        if g < 5:
            texts += [words + ["y"] + ["z"] * 60, near(rng, words, 60)]
    texts += [["s"] * k + [f"t{k}"] for k in range(30, 50)]  # all alike to SimHash, few at 0.8
    texts += [[w.upper() for w in texts[0]], [], []]
    rng.shuffle(texts)
    shingled = [{tuple(x.lower() for x in w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    prints = [print_of(" ".join(w)) for w in texts]
    pairs = {(i, j): (prints[i] ^ prints[j]).bit_count() for i in range(len(texts)) for j in range(i)}
    close = [p for p, bits in pairs.items() if bits <= 3]
    alike = [(i, j) for i, j in close if len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j])]
    assert len(alike) > 30 and len(close) > len(alike) and sum(pairs[p] > 0 for p in alike) > 20
    none = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(simhash, "chains", lambda entries: none)
    monkeypatch.setattr(simhash, "candidates", lambda posts, similarity: none)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(df).collect())
    assert kept == sorted(set(roots(len(texts), alike)))
    monkeypatch.undo()
    whole = [(i, j) for i, j in pairs if len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j])]
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(set(roots(len(texts), whole)))


def test_pairs_of_fingerprints(spark):
    """Nodes of one fingerprint, nodes of several, a group that many share: the pairs connect what all pairs within three bits connect."""
    rng = random.Random(6)
    marks = {(n, rng.choice([0, 1, 7, 15, -1, -2, 1 << 40, 1 << 62])) for n in range(60)} | {(100 + n, rng.getrandbits(63)) for n in range(40)}
    marks |= {(n, rng.getrandbits(62)) for n in range(0, 60, 7)}
    got = simhash.print_links(common.materialize(spark.createDataFrame(sorted(marks), "node long, fp long"), "marks"), 3).collect()
    bits = lambda a, b: ((a ^ b) & 2**64 - 1).bit_count()
    close = {(max(x, y), min(x, y)) for x, a in marks for y, b in marks if x != y and bits(a, b) <= 3}
    edges = [(r["v"], r["u"]) for r in got]
    assert len(edges) == len(set(edges)) and set(edges) <= close
    assert roots(140, edges) == roots(140, list(close))


def test_sketches_lose_no_pair_and_spare_large_groups(spark):
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(5, 4000)], rng.integers(0, 900))) for _ in range(60)]
    bits = [int.from_bytes(simhash.sketch(x)) for x in sets]
    assert all((a ^ b).bit_count() <= len(np.setxor1d(x, y)) for a, x in zip(bits, sets) for b, y in zip(bits, sets))
    # 200 sets of 100 that share 70 elements (0.54), and of these two that share 95 (0.9)
    group = [np.unique(np.r_[pool[:70], rng.integers(0, 1 << 63, 30, dtype=np.uint64)]) for _ in range(200)]
    group.append(np.unique(np.r_[group[0][:95], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
    rows = [(k, i, len(x), i, len(group), simhash.sketch(x)) for i, x in enumerate(group) for k in range(21)]
    posts = spark.createDataFrame(rows, "key long, node long, size int, root long, n long, sketch binary")
    got = {tuple(r) for r in simhash.candidates(posts, 0.8).collect()}
    assert (0, 200) in got and len(got) < 20
