import contextlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from reelframe.llm import simhash
from reelframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def varied(seed=0, groups=12, copies=6):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"W{rng.randrange(500)}É" for _ in range(rng.choice([2, 3, 40, 300]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = "other"
            out.append(rng.choice([" ", "\n", "\t "]).join(own))
    return out + [None, "", " \x0b\x0c ", "a", "A", "a b \x1c c d"]


@pytest.mark.parametrize("text", varied()[::5] + [None, "", "a", "a B", "x " * 100_000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_print(text if len(text or "") < 10_000 else "x x x x")


def test_components_of_texts(spark, docs):
    rows = [(100 - i, t) for i, t in enumerate(varied())] + [(100, varied()[0])]
    got = simhash.near_duplicates(docs(rows, extra=["fp", "root"])).collect()
    prints = {}
    for i, t in rows:
        prints.setdefault(slow_print(t), []).append(i)
    found = slow_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for p, r in found.items():
        least[r] = min([least.get(r, 10**9), *prints[p]])
    want = sorted((i, f"{slow_print(t):016x}", least[found[slow_print(t)]]) for i, t in rows)
    assert sorted(tuple(r) for r in got) == want


def test_null_ids(spark, docs):
    got = simhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (None, "q")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


@pytest.mark.parametrize("hot", [1, 256])
def test_links_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(15):
        centre = rng.getrandbits(64)
        for _ in range(12):
            p = centre
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    nodes = sorted(simhash._signed(p) for p in prints)
    links = simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long"))
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(r["a"], r["b"]) for r in links.collect())
    root = {r["node"]: r["root"] for r in components(links).collect()}
    assert {n: root.get(n, n) for n in nodes} == slow_components(nodes, near)


def test_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(1000), 200)
    rows = [(names[i], names[i + 1]) for i in range(150)] + [(names[i], names[199]) for i in range(160, 199)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {n: min(names[:151]) for n in names[:151]} | {n: min(names[160:]) for n in names[160:]}
    assert got == want


def test_empty(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def near_copies(seed=5, size=200):
    """Unrelated texts; one in three has copies with up to one changed word in 100."""
    rng = random.Random(seed)
    rows, group = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for c in range(1 if g % 3 else 4):
            own = list(words)
            for at in rng.sample(range(size), 0 if c == 0 else rng.randrange(3)):
                own[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
            group[len(rows) - 1] = g
    return rows, group


def test_keep_one_keeps_the_first_of_each_group(spark, docs):
    rows, group = near_copies()
    kept = [r["doc_id"] for r in simhash.keep_one(docs(rows, extra=["root", "w0"])).collect()]
    first = {g: min(i for i in group if group[i] == g) for g in group.values()}
    assert sorted(kept) == sorted(first.values())


def test_keep_one_in_a_hot_block(spark, docs, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rows, group = near_copies(seed=9)
    kept = [r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()]
    assert sorted(kept) == sorted({g: min(i for i in group if group[i] == g) for g in group.values()}.values())


def test_keep_one_odd_rows(spark, docs):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "q r s t u v"), (3, "q r s t u v"), (2, "k"), (2, "l"), (None, None), (9, ""), (1, "q r s t u v")]
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs(rows)).collect()), key=str)
    assert got == sorted([(None, "a b c d e f"), (1, "q r s t u v"), (2, "k"), (2, "l"), (9, "")], key=str)


def test_distance_follows_similarity():
    rng = random.Random(0)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = [f"v{i}" if i % 50 == 0 else w for i, w in enumerate(words)]
    a, b = (simhash.wide_fingerprint(" ".join(x).encode()) for x in (words, other))
    c = simhash.wide_fingerprint(" ".join(reversed(words)).encode())
    differ = lambda x, y: int(np.unpackbits((x ^ y).view(np.uint8)).sum())
    assert differ(a, b) <= simhash.WIDE_DISTANCE < 90 < differ(a, c)


def test_forest_keeps_all_connections():
    rng = random.Random(11)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(300)]
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in part], "b": [b for _, b in part]}) for part in (pairs[:100], pairs[100:])]
    kept = [(a, b) for x in simhash._forest(iter(batches)) for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)]
    nodes = sorted({n for p in pairs for n in p})
    linked = lambda links: slow_components(nodes, lambda a, b: (a, b) in links or (b, a) in links)
    assert linked(set(kept)) == linked(set(pairs)) and len(kept) < len(nodes)


def test_keep_one_keeps_what_is_no_near_copy(spark, docs):
    """Ten words that differ in the last only: 5 of 7 shingles are common, 0.714."""
    rng = random.Random(3)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(10)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "other"]))]
    assert simhash.keep_one(docs(rows)).count() == len(rows)


def five_words(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_groups(rows):
    sets = {i: five_words(t) for i, t in rows}
    found = slow_components([i for i, _ in rows], lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    return sorted(set(found.values()))


@pytest.mark.parametrize("others", [0, 1500])
@pytest.mark.parametrize("size", [8, 10, 60])
def test_isolated_pairs(spark, docs, size, others):
    """Texts and the same with more words at the end: 4 of 5, 6 of 7 and 56 of 70 shingles; in tables of any size."""
    rng = random.Random(size)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for _ in range(40):
        first = text(size)
        rows += [(len(rows), first), (len(rows) + 1, f"{first} {text(14 if size == 60 else 1)}")]
    rows += [(len(rows) + i, text(30)) for i in range(others)]
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect())
    assert kept == [i for i, _ in rows if i >= 80 or i % 2 == 0]


@pytest.mark.parametrize("bucket", [2, 64])
def test_template_group_as_by_all_pairs(spark, docs, monkeypatch, bucket):
    """Texts of one template with 1 to 3 of 40 words changed: some pairs are close, many aren't."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(160):
        own = list(words)
        for at in rng.sample(range(40), rng.choice([1, 2, 2, 3, 3, 3])):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()) == slow_groups(rows)


@pytest.mark.parametrize("sizes", [(0, 0), (1, 1), (250, 260), (300, 257), (1000, 1030), (5000, 4100)])
def test_long_sketches_never_differ_more_than_the_sets(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    a, b = (np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in sizes)
    b = np.unique(np.concatenate([a[: len(b) // 2], b[len(b) // 2 :]]))
    row = [(simhash.long_sketch(a).tolist(), simhash.long_sketch(b).tolist())]
    df = spark.createDataFrame(row, "llong array<long>, rlong array<long>").selectExpr("*", "least(size(llong), size(rlong)) as n")
    bits = 64 * df.first()["n"]
    want = np.unpackbits((simhash._sketch(a, bits) ^ simhash._sketch(b, bits)).view(np.uint8)).sum()
    got = df.selectExpr(simhash._DIFFER).first()[0]
    assert got == want <= len(np.setxor1d(a, b))


def test_tables_of_steps_are_deleted(spark, docs, tmp_path, monkeypatch):
    from reelframe.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    rows, _ = near_copies(size=40)
    kept = simhash.keep_one(docs(rows))
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert kept.count() and left == {"simhash-classes", "simhash-single", "simhash-unclear"}


def test_stage_links_by_fingerprints_first(spark, monkeypatch):
    """Near copies within two bits are linked by their fingerprints alone, those beyond by the sets, unlike ones not at all."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(10 + i, " ".join([*w[:-1], "end"])) for i, w in enumerate(base)]
    found = []
    monkeypatch.setattr(simhash, "print_links", lambda nodes, *rest, own=simhash.print_links: found.append((nodes, own(nodes, *rest))) or found[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "scratch", lambda spark: contextlib.nullcontext())
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == list(range(6))
    nodes, linked = found[0]
    prints = {r["least_id"]: r["fp"] for r in nodes.collect()}
    for i, text in rows:
        assert prints[i] == simhash.set_fingerprint(simhash.shingle_set(text.encode()))
    near = [i for i in range(6) if ((prints[i] ^ prints[10 + i]) & (2**64 - 1)).bit_count() <= simhash.DISTANCE]
    assert near and linked.count() == len(near)


def test_passages_that_a_sample_misses_make_no_pairs(spark, docs, monkeypatch):
    """Long texts with one passage, in none of the sampled shingles: their prefixes leave it out, so no pair but the close one is compared."""
    rng = random.Random(12)
    passage, words = [f"p{i}" for i in range(60)], lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(words(700) + passage + words(700))) for i in range(24)]
    rows.append((24, rows[3][1].replace(rows[3][1].split()[5], "other")))
    compared = []
    monkeypatch.setattr(simhash, "COMMON", 10**9)
    monkeypatch.setattr(simhash, "verified", lambda pairs, *rest, own=simhash.verified: compared.append(pairs.count()) or own(pairs, *rest))
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()) == list(range(24))
    assert sum(compared) < 60  # all 300 pairs otherwise


def test_places_rule_out_no_first_block(spark):
    """Of two sets in one order, the places of the first common element allow every pair of similarity 0.8, and few others."""
    rng, rows = random.Random(13), []
    for _ in range(300):
        n = rng.choice([1, 5, 40, 300])
        a = set(range(n))
        b = set(rng.sample(sorted(a), n - rng.randrange(1 + n // 4))) | {1000 + i for i in range(rng.randrange(1 + n // 6))}
        order = {x: rng.random() for x in a | b}
        x, y = sorted(a, key=order.get), sorted(b, key=order.get)
        if a & b:
            first = min(a & b, key=order.get)
            rows.append((len(x), x.index(first), len(y), y.index(first), len(a & b) / len(a | b)))
    df = spark.createDataFrame(rows, "lsize long, lplace int, rsize long, rplace int, similarity double")
    got = df.select("similarity", simhash._may_be_first("l", "r").alias("kept")).collect()
    assert all(r["kept"] for r in got if 5 * r["similarity"] >= 4 - 1e-9) and not all(r["kept"] for r in got)
