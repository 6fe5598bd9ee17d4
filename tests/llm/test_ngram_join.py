import random
import re

import pytest

from corpuslens.llm import ngram_join as nj

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, n=5, percent=80):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall((text or "").encode().translate(LOWER))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, copies=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, base = [], [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(copies):  # near copies, some below the threshold
        words = list(base)
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    for i in range(120):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 5, 6, 30, 200]))]
        if i % 3 == 0:
            words = words[:12] + passage + words[12:20]
        rows.append((2000 + i, "\n".join(words)))
    rows += [(5001, None), (5002, ""), (5003, " \t\n"), (5004, rows[3][1].upper().replace(" ", "\x0b ")), (5005, "One two"), (5006, "one  TWO"), (5007, "x" * 5_000_000 + " end"), (5008, "one two three")]
    return rows


@pytest.mark.parametrize("kind", ["small", "blocks", "contracted"])
def test_components_equal_brute_force(spark, kind):
    rows = corpus(7)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, node string").repartition(5)
    more = {"small": {}, "blocks": {"unit_sets": 7, "pivots": 3}, "contracted": {"unit_sets": 40, "edges": 300}}[kind]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.near_components(docs, **more).collect()}
    assert got == brute(rows)


def test_hot_chains_are_salted(spark, monkeypatch):
    rows = corpus(11, copies=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(nj, "HOT", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.near_components(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(3, text), (3, text), (None, text), (None, "only this has no id at all"), (9, text.upper())], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in nj.near_components(docs).collect())
    assert got == [(0, 3, 0), (0, 4, 3), (3, 4, 3), (3, 4, 3), (9, 4, 3)]
    assert nj.near_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bound", [10**6, 8])
def test_components_of_paths_hubs_and_loops(spark, bound):
    rnd = random.Random(5)
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, 1000 + i) for i in range(80)]
    pairs = [(5000 + 2 * i, 5001 + 2 * i) for i in range(20)]
    edges = path + hub + pairs + [(300, 300), (301, 300), (-4, 7)]
    rnd.shuffle(edges)
    got = dict(map(tuple, nj.components(spark.createDataFrame(edges, "a long, b long").repartition(6), bound).collect()))
    root = {v: v for e in edges for v in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {v: got.get(v, v) for v in root} == root


def test_rows_that_share_an_id_but_not_a_text_are_not_joined(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(5, a), (9, a + " x"), (5, b), (3, b + " y"), (5, "alone " * 9)], "doc_id long, text string")
    for unit_sets in (1000, 1):
        got = sorted((r["doc_id"], r["component_id"]) for r in nj.near_components(docs, unit_sets=unit_sets, pivots=1).collect())
        assert got == [(3, 3), (5, 3), (5, 5), (5, 5), (9, 5)]


def test_the_tree_finds_what_pairs_find():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(30):
        base = rnd.integers(0, 60, 25)
        sets = [np.unique(np.where(rnd.random(25) < 0.15, rnd.integers(0, 60, 25), base)).astype(np.uint64) for _ in range(25)]
        got = nj.Trie(sets).components(70)
        want = np.arange(len(sets))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 70 * (len(a) + len(sets[j]) - both):
                    want[want == want[j]] = want[i]
        assert ((got[:, None] == got) == (want[:, None] == want)).all()


def test_large_clusters_fall_apart_by_an_order_of_their_own(spark, monkeypatch):
    """Few counters hold many n-grams each, as in a large corpus, so passages chain texts that share no more."""
    rnd = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(12)) for k in range(6)]
    rows = []
    for i in range(150):
        own = [f"t{i}x{j}" for j in range(rnd.randrange(20, 60))]
        rows.append((i, " ".join([*own, *rnd.sample(passages, 2)])))
    rows += [(500 + i, f"{t} more") for i, t in rows[:40]]
    met, joined = [], nj._large_links
    monkeypatch.setattr(nj, "_large_links", lambda large, *more: met.append(large.count()) or joined(large, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.near_components(docs, bits=4, unit_sets=20).collect()}
    assert got == brute(rows) and not met


def test_sizes_that_no_link_allows_are_not_chained(spark):
    """Sets of 10, 20, 40 and more n-grams share one, salted or not."""
    rows = [(g, salt, node, n) for g, salts in ((1, [0]), (2, [1, 2, 3])) for salt in salts for node, n in ((10 * g + salt, 10), (20 * g + salt, 20), (40 * g + salt, 40), (41 * g + salt, 50))]
    entries = spark.createDataFrame([(g, s, 1000 * g + node, n) for g, s, node, n in rows], nj.ENTRY).repartition(3)
    comp = dict(map(tuple, nj._clustered(entries, 80, 1, 100).collect()))
    groups = {}
    for node, c in comp.items():
        groups.setdefault(c, set()).add(node)
    assert {frozenset(x for x in g if 0 < x < 10_000) for g in groups.values()} >= {frozenset({1040, 1041})}
    assert comp[2081] == comp[2082] == comp[2083] == comp[2084] and comp[2021] == comp[2022] != comp[2041] == comp[2043] != comp[2081]


def test_spare_gives_arrows_memory_back(monkeypatch):
    import pyarrow as pa

    from corpuslens.llm import common

    class Pool:
        calls = 0

        def release_unused(self):
            self.calls += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batches = [pa.record_batch([pa.array([i])], names=["x"]) for i in range(3)]
    assert list(common.spare(iter(batches))) == batches and pool.calls >= 3


def test_a_worker_holds_nothing_of_a_task_that_has_ended(monkeypatch):
    import weakref

    import numpy as np
    import pyarrow as pa

    from corpuslens.llm import common

    class Table:
        def __init__(self):
            self.rows = np.zeros(1 << 20)

    held, alive = [], []

    def run(batches):
        table = Table()
        held.append(weakref.ref(table))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: alive.append(held[0]() is not None))
    batches = [pa.record_batch([pa.array([i])], names=["x"]) for i in range(3)]
    assert list(common.light(run)(iter(batches))) == batches
    assert alive[0] and not alive[-1]


def test_freed_blocks_between_others_go_back_to_the_system():
    import re
    import subprocess
    import sys
    from pathlib import Path

    said = (
        "import re, numpy as np\n"
        "from corpuslens.llm.common import give_back\n"
        "mb = lambda: int(re.search(r'RssAnon:\\s+(\\d+)', open('/proc/self/status').read())[1]) / 1024\n"
        "blocks = [np.ones(8_000) for _ in range(2_000)]\n"
        "kept = blocks[::10]\n"
        "del blocks\n"
        "before = mb()\n"
        "give_back()\n"
        "print(before - mb())\n"
    )
    out = subprocess.run([sys.executable, "-c", said], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=60, check=True).stdout
    assert re.match(r"[\d.]+$", out) and float(out) > 60
