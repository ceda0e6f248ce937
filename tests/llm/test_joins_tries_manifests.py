"""N-gram join, conversation trie and Merkle manifest against brute force, with odd rows of every kind."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quern.llm import merkle, ngramjoin, trie
from quern.llm.common import Work
from quern.llm.running import running

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, item string, key string, label string, at string, tree string, list string, place string, prefix string"


def docs_of(spark, rows):
    """Documents (doc_id, text, ...) with columns whose names the operators also use inside."""
    full = [(*r, *[None] * (5 - len(r)))[:5] for r in rows]
    return spark.createDataFrame([(*r, *["x"] * 9) for r in full], DOCS)


# -- n-gram join ------------------------------------------------------------------------------------


def shingles(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))) if words else frozenset()


def brute_components(rows):
    """doc_id, set size and component of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    above = list(range(len(rows)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                above[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = d if least[root(i)] is None else min(d, least[root(i)])
    return sorted(str((d, len(s), least[root(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def alike_texts(rng):
    words = ["alpha", "beta", "été", "δοκιμή", "x", "Omega", "日本", *(f"v{k}" for k in range(200))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(40)
    rows = []
    for base in [text(n) for n in (5, 30, 60, 120)] + [f"{shared} {text(8)}" for _ in range(3)]:
        for _ in range(12):  # near copies: most around nine tenths of similarity
            own = base.split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [f"{shared} {text(rng.randint(0, 30))}" for _ in range(20)] + [text(rng.randint(1, 4)) for _ in range(10)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(spark, monkeypatch, small):
    if small:  # few pivots, many salts, tables that are not broadcast
        for name, n in (("PIVOTS", 1), ("MORE", 2), ("MOST_PIVOTS", 2), ("MEMBERS", 3), ("ELEMENTS", 0)):
            monkeypatch.setattr(ngramjoin, name, n)
    rng = random.Random(small)
    rows = [*enumerate(alike_texts(rng)), (500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one\ttwo"), (3, "one two"), (None, "one two"), (None, "un autre"), (None, None)]
    rows += [(600, rows[5][1]), (5, rows[5][1]), (601, "w " * 3000), (602, " ".join(f"u{k}" for k in range(4000))), (603, " ".join(f"u{k}" for k in range(3950)))]
    found = ngramjoin.linked(docs_of(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == brute_components(rows)


def test_ngram_join_of_little(spark):
    assert ngramjoin.linked(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in ngramjoin.linked(docs_of(spark, [(7, None)])).collect()] == [(7, 0, 7)]


def test_prefixes_share_an_element():
    """Two sets at nine tenths have an element in common among the first of both, in any order of elements."""
    for n in range(1, 60):
        for m in range(n, n * 100 // 90 + 1):
            need = -(-90 * (n + m) // 190)
            p, q = int(ngramjoin.prefix_size(n)), int(ngramjoin.prefix_size(m))
            assert p + q > 0 and n - p + 1 <= need and m - q + 1 <= max(need, -(-90 * m // 100))


# -- conversation trie ---------------------------------------------------------------------------------


def brute_trie(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", sha256((r[3] or "").encode()).hexdigest())
    own = defaultdict(list)
    for r in sorted(rows, key=order):
        own[r[0]].append((r[2] or "", r[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        base = [] if c is None else own.get(c - c % 20, [])
        path = tuple([*base[:h], *turns[h:]])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    least = lambda p: min((c for c in members[p] if c is not None), default=None)

    def below(path):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode().split()) if path else 0
        leaves = 0 if children[path] else 1
        for x in children[path]:
            n, s = below(x)
            leaves, saved = leaves + n, saved + s
        return leaves, saved

    out = []
    for path in members:
        leaves, saved = below(path)
        ids = ",".join(map(str, sorted(c for c in ends[path] if c is not None)))
        out.append((least(path), len(path), least(path[:-1]) if path else None, len(members[path]), len(children[path]), leaves, saved, sha256(ids.encode()).hexdigest()))
    return sorted(map(str, out))


def conversations(rng):
    first = [("user", "hello  there"), ("assistant", "hi"), (None, "a b c"), ("user", None)]
    rows = []
    for c in [*range(0, 70), 100, 119, 140]:
        turns = [rng.choice(first) for _ in range(rng.choice([0, 1, 2, 2, 3, 5, 9]))]
        if c % 3 == 0:
            turns = [*first[:2], *turns]
        rows += [(c, k if rng.random() < 0.9 else None, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(400, k, "user", f"turn {k % 2}") for k in range(70)] + [(401, k, "user", f"turn {k % 2}") for k in range(66)]
    rows += [(402, 0, "user", "x " * 20_000), (403, 0, "user", ""), (404, 0, None, None), (None, 0, "user", "of none"), (None, 1, "user", "of none"), (405, 1, "a", "tie"), (405, 1, "a", "tie"), (405, 1, "b", "tie"), (405, 1, "a", "eit")]
    return rows


def conversations_of(spark, rows):
    names = ["conv", "node", "depth", "above", "next", "words", "base", "at", "place", "h"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], f"conv_id bigint, turn bigint, role string, text string, {', '.join(f'{n} string' for n in names)}")


def plain_trie(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = conversations(random.Random(3))
    random.Random(4).shuffle(rows)
    assert plain_trie(trie.trie(conversations_of(spark, rows).repartition(5))) == brute_trie(rows)


def test_trie_of_little(spark):
    assert trie.trie(conversations_of(spark, [])).count() == 0
    for rows in ([(7, 0, "user", "one")], [(None, None, None, None)], [(c, 0, "user", "same") for c in range(300)], [(21, 0, "a", "b"), (39, 0, "a", "b")]):
        assert plain_trie(trie.trie(conversations_of(spark, rows))) == brute_trie(rows)


# -- Merkle manifest ---------------------------------------------------------------------------------


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for d, t, lang, source, n in rows:
        leaf = leaf_of((d, source, lang, n, t))
        changed = leaf_of((d, source, lang, n, t and t.translate(lower))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        by[lang].append(((d is not None, d or 0, leaf), d, leaf, changed))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[0])
        trees[lang] = levels([x[2] for x in by[lang]])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (_, d, leaf, changed) in enumerate(by[lang]):
            proof, node = "", changed
            for tree, at in ((trees[lang], i), (top, k)):
                for level in tree[:-1]:
                    run = level[at - at % 8 : at - at % 8 + 8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    node = h(*run[: at % 8], node, *run[at % 8 + 1 :])
                    at //= 8
            out.append((d, leaf, trees[lang][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(map(str, out))


def plain_manifest(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "LEVELS", depth)
    monkeypatch.setattr(merkle, "BLOCK", 8**depth)
    rng = random.Random(depth)
    sizes = {"en": 530, "de": 65, "fr": 64, "é": 9, None: 8, "": 1, "zh": 2, "b": 1, "B": 1, "x": 7}
    rows = [(rng.randint(-50, 10**6), rng.choice(["Text A", "été Z", "", None, "x" * 500]), lang, rng.choice(["s1", None, ""]), rng.choice([1, None])) for lang, n in sizes.items() for _ in range(n)]
    rows += [(None, "Of None", "en", "s", 1), (None, None, None, None, None), rows[3], (rows[4][0], "Other", "en", "s", 2), (10**7, "Long " * 50_000, "de", "s", 5)]
    rng.shuffle(rows)
    assert plain_manifest(merkle.manifest(docs_of(spark, rows).repartition(6))) == brute_manifest(rows)


def test_manifest_of_little(spark):
    empty = merkle.manifest(docs_of(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    one = [(5, "A", "en", "s", 1)]
    assert plain_manifest(merkle.manifest(docs_of(spark, one))) == brute_manifest(one)


# -- places -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", ["1", "3", "7"])
def test_running(spark, partitions):
    rng = random.Random(int(partitions))
    rows = [(rng.choice("aaaaaab") if rng.random() < 0.9 else f"g{k}", rng.randint(0, 10**9), rng.randint(-5, 5)) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with Work(spark) as work:
            found = running(spark.createDataFrame(rows, "g string, o bigint, v bigint"), "g", [F.col("o")], work, ("v",)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted, seen = [], defaultdict(lambda: [0, 0])
    for g, o, v in sorted(rows):
        seen[g][1] += v
        wanted.append((g, o, seen[g][1], seen[g][0]))
        seen[g][0] += 1
    assert sorted(map(tuple, found)) == sorted(wanted)
