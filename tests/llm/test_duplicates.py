import random
import re

import numpy as np
import xxhash
from conftest import CLASHING

from sluice.llm import near_copies, simhash
from sluice.llm import cover_tree
from sluice.llm.cover_tree import embedding_links
from sluice.llm.runtime import components
from sluice.llm.simhash import drop_near_duplicates, fingerprint, keys_of, near_duplicates


def brute_fingerprint(text, words):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return bits - (1 << 64) if bits >> 63 else bits


def brute_components(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(n)]


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(1, 400))] for _ in range(25)]
    found = [None, "", " \n", "One", "one two three", "ONE two THREE", "É é"]
    for words in base:
        for edits in (0, 0, 1, 2, 4):
            own = list(words)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            found.append(" ".join(own))
    return found


def test_fingerprints_and_components_as_brute_force(docs, monkeypatch):
    own = texts()
    for block in (4096, 2):
        monkeypatch.setattr(simhash, "BLOCK", block)
        rows = {r.id: r for r in near_duplicates(docs(own, extra=CLASHING), words=4, bits=4, width=1).collect()}
        fps = [brute_fingerprint(t or "", 4) for t in own]
        assert [rows[i].fp0 for i in range(len(own))] == fps
        want = brute_components(len(own), lambda i, j: bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 4)
        assert [rows[i].component for i in range(len(own))] == want


def test_keys_find_five_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 300)
    for bits in range(1, 6):
        b = np.array([x ^ sum(1 << int(k) for k in rng.choice(64, bits, replace=False)) for x in a.view(np.uint64).tolist()], np.uint64)
        (k, r), (l, s) = keys_of(a), keys_of(b.view(np.int64))
        one = set(zip(k.tolist(), r.tolist(), strict=True))
        assert {y for x, y in zip(l.tolist(), s.tolist(), strict=True) if (x, y) in one} == set(range(300))


def test_near_copies_go_and_others_stay(docs):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    plain = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(30)]
    copies = [" ".join([*t.split()[:200], "changed", *t.split()[201:]]) for t in plain[:10]]
    kept = drop_near_duplicates(docs(plain + copies, extra=CLASHING))
    assert {r.doc_id for r in kept.collect()} == set(range(30))
    assert fingerprint("", 5, 2) == [0, 0]
    assert drop_near_duplicates(docs([])).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    rows = list(zip(order, order[1:], strict=False)) + [(500, 501), (501, 500), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(n)} | {500: 500, 501: 500}


def test_embedding_links_as_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    v = np.vstack([c + rng.normal(size=(n, 8)) * 0.13 for c, n in zip(centres, (1, 2, 5, 40, 3, 90, 1, 1, 7, 20, 2, 2), strict=True)]).astype(np.float32)
    v = np.vstack([v, v[:5], v[:3] * 2]).tolist()
    odd = [None, [0.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [float("inf")], [1.0] * 7 + [None], [], v[0][:3]]
    rows = [(i, x, 0, 1) for i, x in enumerate(v + odd)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id int")
    x = np.array(v)
    short = np.zeros(8)
    short[:3] = v[0][:3]
    x = np.vstack([x, short])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [*range(len(v)), len(rows) - 1]
    want = dict(zip(ids, near.sum(axis=1).tolist(), strict=True)) | {i: 0 for i in range(len(v), len(rows) - 1)}
    roots = brute_components(len(ids), lambda i, j: near[i, j])
    root = {i: ids[r] for i, r in zip(ids, roots, strict=True)} | {i: i for i in range(len(v), len(rows) - 1)}
    for block in (4096, 16):
        found = {r.id: r for r in embedding_links(own, block=block).collect()}
        assert {i: r.n_links for i, r in found.items()} == want
        assert {i: r.component for i, r in found.items()} == root
    assert embedding_links(own.where("false")).count() == 0
    assert embedding_links(own.where("embedding is null")).count() == 1


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_blocks_are_not_copied_for_each_pair(spark, monkeypatch):
    """Vectors that are all about equally far apart, so that every block meets every other one, and near and equal copies."""
    monkeypatch.setattr(cover_tree, "CELL_POINTS", 64)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(1200, 64))
    v = np.vstack([v, v[:250] + rng.normal(size=(250, 64)) * 0.2, v[:50] + rng.normal(size=(50, 64)) * 0.29]).astype(np.float32)
    v = np.vstack([v, v[40:60]])
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows = [(i, x, 0) for i, x in enumerate(v.tolist())]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).localCheckpoint()
    before = shuffled(spark)
    found = {r.id: r for r in embedding_links(own, block=32).collect()}
    assert shuffled(spark) - before < 4 * v.nbytes
    assert [found[i].n_links for i in range(len(v))] == near.sum(axis=1).tolist()
    assert [found[i].component for i in range(len(v))] == brute_components(len(v), lambda i, j: near[i, j])


def test_planes_between_cells_lose_no_link(monkeypatch):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(1500, 12))
    v = np.vstack([v, v[:700] + rng.normal(size=(700, 12)) * 0.25])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centres = v[:2]
    cell = (v @ centres.T).argmax(axis=1)
    sides = []
    for k in (0, 1):
        tree = cover_tree.build(v[cell == k], np.flatnonzero(cell == k), np.ones((cell == k).sum(), np.int64))
        sides.append(cover_tree.Side(tree, tree.points.astype(np.float32)))
    apart = np.linalg.norm(centres[0] - centres[1])
    beyond = [(x.centres @ (centres[k] - centres[1 - k])) / apart - x.reach for k, x in enumerate(sides)]
    a, b = (x.tree for x in sides)
    near = a.points @ b.points.T >= 0.95
    assert near.any()
    for rows, least in ((128, 1 << 17), (7, 1)):
        monkeypatch.setattr(cover_tree, "ROWS", rows)
        monkeypatch.setattr(cover_tree, "LEAST", least)
        links, joined = (np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)), cover_tree.Joined()
        cover_tree.walk(*sides, 0.95, False, *links, joined, None, tuple(beyond))
        assert links[0].tolist() == near.sum(axis=1).tolist() and links[1].tolist() == near.sum(axis=0).tolist()


def brute_set(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words, at, rng):
    """A copy with single words changed far apart, each of which changes five shingles."""
    own = list(words)
    for i in at:
        own[i] = f"new{rng.randrange(10**9)}"
    return own


def test_near_copies_are_those_of_exact_similarity(docs, monkeypatch):
    rng = random.Random(5)
    own = [None, "", "one two", "ONE  two", "one two three", "a b " * 300, "a b " * 500]
    for edits in [8, 9] * 40:  # of 404 words: 40 of 400 shingles make 0.818, 45 make 0.798
        words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
        own += [" ".join(words), " ".join(edited(words, range(20, 20 + 40 * edits, 40), rng))]
    base = [f"w{rng.randrange(10**6)}" for _ in range(404)]
    # A large group that no single text links: copies of a base that are mostly less than 0.8 like each other.
    own += [" ".join(edited(base, rng.sample(range(10, 390, 12), rng.choice((3, 5, 7))), rng)) for _ in range(60)]
    # Long texts that share 0.7 of their shingles are no copies.
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    own += [" ".join(words), " ".join([*words[:1647], *(f"x{i}" for i in range(353))])]
    sets = [brute_set(x) for x in own]
    want = brute_components(len(own), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert len(set(want)) > 50
    for stars, block in ((3, 1024), (0, 4)):
        monkeypatch.setattr(near_copies, "STARS", stars)
        monkeypatch.setattr(near_copies, "BLOCK", block)
        found = {r.id: r.component for r in near_copies.near_copies(docs(own, extra=CLASHING)).collect()}
        assert [found[i] for i in range(len(own))] == want


def test_bands_find_pairs_of_just_enough_similarity():
    rng = np.random.default_rng(9)
    sets = rng.integers(0, 2**63, (20_000, 120), np.uint64)
    a, b = sets[:, :90], np.concatenate([sets[:, :80], sets[:, 90:100]], axis=1)  # 80 of 100 in common
    keys = [near_copies.band_keys(np.array([near_copies.least_hashes(x) for x in side])) for side in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() > 0.9995


def test_walk_prunes_and_loses_nothing(monkeypatch):
    """Trees against brute force, down to single points, with the node pairs that were looked at and dropped."""
    rng = np.random.default_rng(5)
    for seed, (groups, size, width, noise) in enumerate([(40, 25, 16, 0.02), (8, 100, 64, 0.03), (300, 1, 64, 0), (2, 300, 4, 0.2)]):
        centres = rng.normal(size=(groups, width))
        v = np.repeat(centres, size, axis=0) + rng.normal(size=(groups * size, width)) * noise
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        half = len(v) // 2
        order = rng.permutation(len(v))
        weights = rng.integers(1, 4, len(v))
        trees = [cover_tree.build(v[x], x.astype(np.int64), weights[x]) for x in (order[:half], order[half:])]
        for at_once in (1, 1 << 14):
            monkeypatch.setattr(cover_tree, "AT_ONCE", at_once)
            for a, b, same in ((trees[0], trees[1], False), (trees[0], trees[0], True)):
                near = a.points @ b.points.T >= 0.95
                if same:
                    np.fill_diagonal(near, False)
                visits = cover_tree.Visits()
                links_a, links_b, pairs = cover_tree.dual(a, b, 0.95, same, visits)
                assert links_a.tolist() == (near @ b.weights).tolist() and links_b.tolist() == (a.weights @ near).tolist()
                linked = {int(x) for x in a.ids[near.any(axis=1)]} | {int(x) for x in b.ids[near.any(axis=0)]}
                assert {x for x, _ in pairs} == linked
                assert visits.seen > 0 and visits.pruned <= visits.seen
                if groups > 2 and size > 1:  # what lies apart is dropped before its points are met
                    assert visits.points < 0.5 * near.size and visits.pruned > 0


def test_bounds_leave_no_similar_pair_out():
    """Counts in bins bound what sets have in common, full bins as well; only unlinked rows of the right halves are paired."""
    import random

    import numpy as np

    from sluice.llm.near_copies import BINS, _bins, possible_pairs

    draw = random.Random(6)
    base = [draw.getrandbits(64) for _ in range(300)] + [draw.getrandbits(50) for _ in range(700)]
    sets = [np.unique(np.array(draw.sample(base, draw.choice([300, 700, 900, 950, 990])), np.uint64)).view(np.int64) for _ in range(40)]
    bins = np.frombuffer(b"".join(_bins(x) for x in sets), np.uint8).reshape(-1, BINS)
    assert bins.max() == 255
    n, node = np.array([len(x) for x in sets]), np.arange(40)
    root = np.array([i if i % 4 else 0 for i in range(40)])
    for half in (np.full(40, 2), node % 2):
        found = {tuple(sorted((a, int(b)))) for a, others in possible_pairs(half, node, n, root, bins, 0.8) for b in others}
        for i in range(40):
            for j in range(i):
                alike = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8
                apart = root[i] != root[j] and (half[0] == 2 or (i + j) % 2)
                assert not (alike and apart) or (j, i) in found
                assert apart or (j, i) not in found
    assert 0 < len(found) < 400


def test_near_copies_that_no_star_joins(docs, monkeypatch):
    """A chain in which only neighbours are similar, and texts that share bands with all of it but are similar to none."""
    import random

    from sluice.llm import near_copies as module

    monkeypatch.setattr(module, "BLOCK", 8)
    draw = random.Random(3)
    text = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(30):
        text = text.copy()
        text[4 * i % 120] = f"new{i}"
        texts.append(" ".join(text))
    for i in range(12):
        other = text.copy()
        for k in draw.sample(range(120), 9):
            other[k] = f"other{i}{k}"
        texts.append(" ".join(other))
    found = {r.id: r.component for r in module.near_copies(docs(texts)).collect()}
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    top = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) / len(a | b) >= 0.8:
                    top[i] = top[j] = min(top[i], top[j])
    assert found == dict(enumerate(top))


def test_near_copies_come_from_simhash_keys(docs):
    """The first pairs that are looked at come from SimHashes under Golay-code keys, not from MinHash bands."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(404)]
    own = [" ".join(words), " ".join(edited(words, [200], rng)), " ".join(edited(words, [100], rng)), "some other text of a few words"]
    found = near_copies._sketches(docs(own), 5, "doc_id", "text").select("id", "n", "fp0").withColumnRenamed("id", "node")
    assert [r.fp0 for r in found.orderBy("node").collect()] == [fingerprint(x, 5)[0] for x in own]
    pairs = {(r.a, r.b) for r in near_copies._print_pairs(found, 0.8).collect()}
    assert len(pairs) == 2 and all(a < b < 3 for a, b in pairs)


def test_components_are_found_again_only_for_new_links(spark, monkeypatch):
    """On sf0.01 bands bring pairs, but none of them is similar enough: SimHash keys have found all links (four searches before)."""
    from sluice.llm import near_copies

    calls, own = [], near_copies.components

    def counted(links):
        calls.append(links)
        return own(links)

    monkeypatch.setattr(near_copies, "components", counted)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = near_copies.near_copies(docs)
    assert len(calls) == 1
    assert found.where("component = id").count() == 922


def test_copies_with_one_key_are_paired_with_its_first():
    n = 50
    group, half, prints = np.repeat([4, 9], n), np.full(2 * n, 2), np.arange(2 * n) % n
    pairs = simhash._link(group, half, np.arange(2 * n), [prints], 14, simhash._Forest())
    assert {tuple(sorted(x)) for x in pairs} == {(0, i) for i in range(1, n)} | {(n, n + i) for i in range(1, n)}
    assert not simhash._link(group[:0], half[:0], group[:0], [prints[:0]], 14, simhash._Forest())


def test_near_copies_pair_texts_of_alike_sizes(docs):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    own = [" ".join(base), " ".join([*base[:40], "other", *base[41:]]), " ".join(base * 2), " ".join(base[:230])]
    prints = near_copies._sketches(docs(own), 5, "doc_id", "text").select("id", "n", "fp0").withColumnRenamed("id", "node")
    sizes = {r.node: r.n for r in prints.collect()}
    pairs = [(r.a, r.b) for r in near_copies._print_pairs(prints, 0.8).collect()]
    assert (0, 1) in pairs
    assert all(min(sizes[a], sizes[b]) / max(sizes[a], sizes[b]) >= 0.8 and a < b for a, b in pairs)


def test_stars_are_components_already(spark, monkeypatch):
    from sluice.llm import runtime

    rng = random.Random(6)
    links = [(i, rng.randrange(i)) for i in range(1, 200) if i % 7] + [(3, 3), (300, 301), (301, 300)]
    root = brute_components(302, lambda i, j: (i, j) in links or (j, i) in links)
    want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
    for few in (runtime.FEW_LINKS, 0):
        monkeypatch.setattr(runtime, "FEW_LINKS", few)
        found = components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, found.collect())) == sorted(want.items())
    made, written = [], runtime.written
    monkeypatch.setattr(runtime, "written", lambda df: made.append(df) or written(df))
    again = components(found.select(found.node.alias("a"), found.root.alias("b")))
    assert {r.node: r.root for r in again.collect()} == want
    assert len(made) == 1
