"""Operators on documents: against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ratiospark.llm import decontamination, exact_dedup, line_dedup, mixing, sharding, simhash
from ratiospark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(11)
VOCAB = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus():
    base = [prose(rng.randint(1, 80)) for _ in range(60)]
    texts = base + [rng.choice(base) for _ in range(25)] + [t.replace(" ", "\n ", 2) for t in base[:15]] + [base[0]] * 40
    texts += [None, "", " \t\n", None, "é", prose(60_000), "A b C d", "a B c D", "one", "one two three"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None, "ü", "z"]), 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], rows[3], (None, "no id", "en", "a", 0), (None, base[0], "en", "a", 0)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clash(docs):
    """Extra columns with the names that operators use within."""
    names = ["t", "norm", "h", "salt", "prefix", "key", "size", "shard", "_id", "fp", "row", "line", "_k1", "_sk", "_key", "_cell", "block", "target", "component_id", "s", "_n", "doc", "k", "_gone", "_hash", "source_size", "budget", "start", "chosen", "last", "words", "coarse"]
    return docs.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted(map(str, df.collect()))


# exact dedup


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], members[0][2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, m in enumerate(members)]
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [None, 3, 1])
def test_exact_dedup(docs, clash, hot):
    for df in (docs, clash) if hot is None else (docs,):
        assert sorted(str(tuple(r)) for r in exact_dedup.exact_dedup(df, hot_rows=hot).collect()) == brute_exact(ROWS)


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# sharding


@pytest.mark.parametrize("units", [20_000, 15])
def test_sharding(docs, units):
    got = sharding.pack_shards(docs, n_shards=5, units_per_task=units).collect()
    assert len(got) == len(ROWS)
    want = sorted((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), len(WORDS.findall(t or ""))) for d, t, *_ in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.tokens) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text_crc32, r.size].add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 1  # base[0] alone holds over half a shard's rows


def test_sharding_against_a_sequential_packer(spark):
    """Groups of equal texts in falling order of their largest share, each where the dot product with the residual capacity is highest."""
    r = random.Random(6)
    texts = [prose(r.randint(1, 90)) for _ in range(150)] + [None, ""]
    rows = [(i, r.choice(texts)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.shard for x in sharding.pack_shards(df, n_shards=5).collect()}
    hashes = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    groups = collections.defaultdict(lambda: np.zeros(3))
    key = lambda i, t: (hashes[i], zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
    for i, t in rows:
        groups[key(i, t)] += [len((t or "").encode()) + 8, len(WORDS.findall(t or "")), 1]
    share = sum(groups.values()) / 5
    units = sorted(groups, key=lambda k: (-max(groups[k] / share), k))
    left, home, turn = np.ones((5, 3)), {}, units[0][0] % 5
    for k in units:
        v = groups[k] * (1 / share)
        s = int((left @ v).argmax())
        left[s] -= v
        home[k] = (s + turn) % 5
    assert got == {i: home[key(i, t)] for i, t in rows}


def test_shards_are_near_equal(spark):
    df = spark.createDataFrame([(i, prose(rng.randint(20, 60))) for i in range(1500)], "doc_id long, text string")
    sizes = collections.Counter()
    for r in sharding.pack_shards(df, n_shards=6, units_per_task=200).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_shard_documents(docs, clash, empty):
    out = sharding.shard_documents(docs, n_shards=5)
    assert out.columns == [*docs.columns, "shard"] and rows_of(out.drop("shard")) == rows_of(docs)
    other = sharding.shard_documents(clash, n_shards=5)
    assert set(other.columns) == set(clash.columns) and dict(other.dtypes)["shard"] == "int"
    assert rows_of(other.select(*[c for c in clash.columns if c != "shard"])) == rows_of(clash.drop("shard"))
    by_group = sharding.pack_shards(docs, n_shards=3, group_col="source").collect()
    assert len(by_group) == len(ROWS)
    assert sharding.pack_shards(empty).count() == 0 and sharding.shard_documents(empty).count() == 0


# mixing


def brute_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in over}


def test_mixing(docs, clash, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes, (5, 2, 1), 3)
    taken, largest = collections.Counter(), collections.Counter()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] + 1 for s in sizes)
    assert rows_of(mixing.mix(docs)) == rows_of(mixing.mix(clash)) == sorted(map(str, got))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    repeats = collections.Counter((r.doc_id, r.text) for r in out.collect())
    wanted = collections.Counter()
    for r in got:
        wanted[r.doc_id] += r.repeats
    by_id = collections.Counter()
    for (d, _), n in repeats.items():
        by_id[d] += n
    assert by_id == +wanted
    other = mixing.mix_documents(clash)
    assert other.columns == clash.columns and rows_of(other.select(docs.columns)) == rows_of(out) and other.filter("target <> 'x' OR _key <> 'x'").count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_mixing_takes_smallest_keys(spark):
    """One source of known order: whole rows by rising key up to the budget, the one on the edge if that is nearer."""
    df = spark.createDataFrame([(i, "x " * (1 + i % 7), "s") for i in range(500)] + [(1000 + i, "y " * 9, "t") for i in range(400)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, weights=(1, 3), weight=F.lit(1.0)).collect()}
    target = next(r.target for r in got.values() if r.source == "s")
    h = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()}
    key = lambda d: -np.log((((h[d] % (1 << 64)) >> 11) + 0.5) / 2**53)
    chosen, total = set(), 0
    for d in sorted((d for d in got if d < 1000), key=key):
        size = 1 + d % 7
        if 2 * (total + size) - size >= 2 * target:
            break
        total += size
        chosen.add(d)
    assert {d for d, r in got.items() if d < 1000 and r.taken} == chosen


# SimHash


def brute_print(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return prints, [least.get(root(i)) for i in range(len(rows))]


def test_places_of_the_index_cover_every_four():
    from itertools import combinations

    for size in (2, 3, 4):
        chosen = simhash.covering(size)
        assert all(any(set(c) <= set(four) for c in chosen) for four in combinations(range(8), 4))
        assert len(chosen) <= {2: 8, 3: 28, 4: 70}[size]


def test_count_filter_leaves_few_candidates():
    """Pairs that share a posting, those that the tally keeps, and those that the bits verify."""
    r = np.random.default_rng(2)
    prints = r.integers(-(2**63), 2**63 - 1, 30_000)
    prints = np.unique(np.concatenate([prints, prints[:500] ^ 5]))
    met = kept = good = 0
    for c in simhash.covering(2):
        key = prints & simhash._mask(c)
        order = np.argsort(key, kind="stable")
        a, b = prints[order][:-1], prints[order][1:]
        same = key[order][:-1] == key[order][1:]
        a, b = a[same], b[same]
        met, kept, good = met + len(a), kept + (simhash.tally(a, b) >= 4).sum(), good + len(simhash.near(a, b))
    print("candidates", met, "after the count filter", kept, "verified", good)
    assert met > 20 * kept >= 20 * good > 0


@pytest.mark.parametrize("full", [0, simhash.FULL, 1 << 62])
def test_near_links_with_more_places(spark, full):
    r = np.random.default_rng(9)
    prints = r.integers(-(2**63), 2**63 - 1, 150)
    flips = [prints[i] ^ np.bitwise_or.reduce(np.int64(1) << r.choice(62, k, replace=False).astype(np.int64)) for i in range(150) for k in (3, 4, 5)]
    prints = np.unique(np.concatenate([prints, flips, r.integers(0, 1 << 14, 400)]))
    want = {(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if int(a ^ b).bit_count() <= 4}
    links = simhash.near_links(spark.createDataFrame([(int(p),) for p in prints], "fp long"), full=full, posting=50)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    for a, b in want:
        assert got[a] == got[b]
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} <= want


@pytest.mark.parametrize("posting", [simhash.POSTING, 2])
def test_simhash(docs, posting):
    prints, comps = brute_components(ROWS)
    want = sorted(str((d, format(p, "016x"), c)) for (d, *_), p, c in zip(ROWS, prints, comps, strict=True))
    got = simhash.near_duplicates(docs, posting=posting)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got.collect()) == want


def test_near_links_of_dense_and_chained_prints(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:5]:
        for _ in range(60):
            b ^= sum(1 << k for k in r.sample(range(64), r.randint(1, 4)))
            prints.add(b)
    for i in range(64):
        prints.add(base[9] ^ 1 << i)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                parent[root(p)] = root(q)
    want = collections.defaultdict(set)
    for p, s in zip(prints, signed, strict=True):
        want[root(p)].add(s)
    want = sorted(sorted(c) for c in want.values() if len(c) > 1)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for posting in (4096, 3):
        got = collections.defaultdict(set)
        for r in components(simhash.near_links(df, posting)).collect():
            got[r.root].add(r.node)
        assert sorted(sorted(c) for c in got.values()) == want and all(min(c) == k for k, c in got.items())


def test_components_of_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_drop_near_duplicates(docs, clash, empty):
    _, comps = brute_components(ROWS)
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(map(str, kept)) == sorted(map(str, set(comps)))
    assert simhash.drop_near_duplicates(clash).columns == clash.columns and simhash.drop_near_duplicates(clash).count() == len(kept)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def near_corpus(seed):
    """Texts with 0 to 12 words replaced, so that similarities lie on both sides of 0.8, copies, and one passage in many texts."""
    r, texts = random.Random(seed), [None, "", "one", "one two", "ONE two", "one two three four five"]
    word = lambda: f"n{r.randrange(5000)}"
    passage = [word() for _ in range(12)]
    for _ in range(40):
        base = [word() for _ in range(r.choice([3, 6, 30, 100, 300]))] + passage * (r.random() < 0.5)
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    base = [word() for _ in range(150)]
    for _ in range(60):  # a dense group
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[50], texts[50].upper(), texts[60] + "\n", base[0] + " x " * 40, base[0] + " x " * 80]
    r.shuffle(texts)
    return list(enumerate(texts))


def brute_similar(rows):
    grams = []
    for _, t in rows:
        w = WORDS.findall((t or "").lower())
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    prints, parent, fresh = [brute_print(t) for _, t in rows], list(range(len(rows))), 0

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 4
            if near or grams[i] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
                fresh += not near
    return {root(i) for i in range(len(rows))}, fresh


@pytest.mark.parametrize("seed", [1, 2])
def test_drop_similar_documents(spark, empty, seed):
    rows = near_corpus(seed)
    want, fresh = brute_similar(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(0), "node": F.lit("x")})
    out = simhash.drop_near_duplicates(df, similar=True)
    assert fresh > 100 and out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert simhash.drop_near_duplicates(df).count() > len(want)
    assert simhash.drop_near_duplicates(empty, similar=True).count() == 0


def test_near_dedup_stage_drops_similar_documents(spark):
    import corpus_pipeline

    words = [f"s{i}" for i in range(200)]
    near = [f"x{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join([*words[:100], *[f"t{i}" for i in range(100)]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert (brute_print(rows[0][1]) ^ brute_print(rows[1][1])).bit_count() > 4
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 3]


def test_pairs_that_no_first_decides():
    """Of a posting whose first member is like none, all others still meet."""
    import pyarrow as pa

    from ratiospark.llm import shingles

    cols = {"w": [1, 1, 1, 2, 2, 3], "node": [7, 8, 9, 7, 8, 9], "n": [100] * 6, "at": [0] * 6, "root": [7, 8, 9, 7, 7, 9]}
    cols |= {s: [0] * 6 for s in shingles._SIGNS}  # equal signatures: no pair is ruled out
    batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})
    for parts in ([batch], [batch.slice(i, 1) for i in range(6)], [batch.slice(0, 2), batch.slice(2)]):
        found = pa.Table.from_batches(list(shingles._apart(iter(parts)))).to_pylist()
        assert sorted((p["a"], p["b"]) for p in found) == [(7, 8), (7, 9), (8, 9)]


# decontamination


def test_seeds_find_two_substitutions_in_thirteen():
    from itertools import combinations

    for n, bad in ((13, 2), (15, 3)):
        for wrong in combinations(range(n), bad):
            assert any(all(c == "0" or p + k not in wrong for k, c in enumerate(s)) for s in decontamination.SEEDS for p in range(n - len(s) + 1))


def test_longest_range():
    r = random.Random(1)
    for _ in range(800):
        e = np.array([r.random() < r.choice([0.5, 0.8, 0.9]) for _ in range(r.randint(1, 25))])
        n = len(e)
        want = max(j - i for i in range(n + 1) for j in range(i, n + 1) if sum(e[i:j]) * 5 >= 4 * (j - i))
        i, j = decontamination.longest(e)
        assert j - i == want and sum(e[i:j]) * 5 >= 4 * (j - i)


def contamination(spark):
    item = [f"q{i}" for i in range(30)]
    swapped = ["other" if k % 6 == 5 else w for k, w in enumerate(item)]
    far = ["other" if k % 3 == 2 else w for k, w in enumerate(item)]
    fill = prose(50)
    rows = [(1, f"{fill} {' '.join(item)} {fill}"), (2, f"{fill} {' '.join(swapped).upper()}!"), (3, f"{' '.join(far)} {fill}"), (4, " ".join(item[:12])), (5, " ".join(item[5:20])), (6, None), (7, ""), (None, " ".join(item)), (1, f"{fill} {' '.join(item)} {fill}"), (8, fill * 300 + " " + ", ".join(item)), (9, "short item of six words only here")]
    bench = [(10, " ".join(item)), (11, "short item of six words only"), (12, "too short"), (13, None), (14, " ".join(item))]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("block", [decontamination.BLOCK_WORDS, 8])
def test_decontamination(spark, block):
    docs, bench = contamination(spark)
    got = sorted(str((r.doc_id, r.item_id)) for r in decontamination.contaminated(docs, bench, block_words=block).collect())
    assert got == sorted([str((d, i)) for d in (1, 1, 2, 5, 8, None) for i in (10, 14)] + ["(9, 11)"])
    left = decontamination.drop_contaminated(docs.withColumn("index", F.lit(1)), bench, block_words=block)
    assert left.columns == ["doc_id", "text", "index"] and sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7]
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def brute_overlaps(index, text):
    """All diagonals and all ranges."""
    words, out = decontamination.tokens(text), []
    for name, x in sorted(index):
        item, best = decontamination.tokens(x), None
        for shift in range(-len(item) + 1, len(words)):
            a, b = max(0, -shift), min(len(item), len(words) - shift)
            equal = [item[k] == words[k + shift] for k in range(a, b)]
            sums = [0, *itertools.accumulate(equal)]
            for i in range(len(equal)):
                for j in range(i + min(len(item), 13), len(equal) + 1):
                    if 5 * (sums[j] - sums[i]) >= 4 * (j - i) and (best is None or (j - i, -(a + i + shift), -(a + i)) > (best[3], -best[1], -best[2])):
                        best = (name, a + i + shift, a + i, j - i, sums[j] - sums[i])
        if best:
            out.append(best)
    return out


@pytest.mark.parametrize("long_item", [512, 20])
def test_contaminated_against_brute_force(spark, monkeypatch, long_item):
    """The query's operator against every diagonal and every range: one seed is touched by no more than two of thirteen words, so that items
    and texts with few substitutions are found all."""
    monkeypatch.setattr(decontamination, "LONG_ITEM", long_item)
    monkeypatch.setattr(decontamination, "CELLS", 500)
    r = random.Random(7)
    bench = [(k, " ".join(f"b{r.randrange(60)}" for _ in range(r.choice([2, 5, 9, 14, 25, 40])))) for k in range(25)] + [(90, "aa " * 30), (91, "aa bb " * 12)]
    rows = []
    for d in range(120):
        words = [f"f{r.randrange(40)}" for _ in range(r.randrange(30))]
        for _ in range(r.randrange(3)):
            x = r.choice(bench)[1].split()
            a = r.randrange(len(x))
            x = x[a : a + r.randrange(3, 40)]
            for _ in range(len(x) // 15):
                x[r.randrange(len(x))] = "zz"
            words += x + [f"f{r.randrange(40)}" for _ in range(r.randrange(9))]
        rows.append((d, " ".join(words)))
    rows += [(200, "aa " * 75), (201, "aa bb " * 40), (202, "bb aa " * 9 + "aa " * 20), (203, None)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = [(d, *o) for d, t in rows for o in brute_overlaps(bench, t)]
    assert sorted(tuple(x)[:6] for x in got) == sorted(want) and len(want) > 40


def test_repeated_words_take_little_time_and_memory():
    """A million equal words against an item of 200 of them."""
    import time
    import tracemalloc

    index = decontamination.SeedIndex.of([(1, "word " * 200), (2, "word other " * 100)])
    text = "word " * 1_000_000
    tracemalloc.start()
    began = time.process_time()
    assert index.overlaps(text) == [(1, 0, 0, 200, 200)]
    assert time.process_time() - began < 30 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert index.overlaps("word other " * 3000) == [(2, 0, 0, 200, 200)]


# line dedup


def line_corpus(seed):
    r, pool, rows = random.Random(seed), [], []
    for d in range(150):
        lines = []
        for _ in range(r.randint(0, 6)):
            if pool and r.random() < 0.5:
                w = list(r.choice(pool))
                for _ in range(r.randint(0, 4)):
                    if w and r.random() < 0.6:
                        w[r.randrange(len(w))] = r.choice(VOCAB)
            else:
                w = [r.choice(VOCAB) for _ in range(r.choice([0, 1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 200]))]
            pool.append(w)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines) if r.random() < 0.97 else None))
    return rows


def brute_lines(rows):
    lines = sorted(((d, j, frozenset(x.split())) for d, t in rows if t for j, x in enumerate(t.split("\n")) if x.split()), key=lambda x: x[:2])
    return {(d, j) for i, (d, j, x) in enumerate(lines) if any(5 * len(x & y) >= 4 * len(x | y) for _, _, y in lines[:i])}


@pytest.mark.parametrize("first", [2, 1])
def test_line_dedup(spark, first):
    rows = line_corpus(first)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "doc": F.lit(2), "t": F.lit("x")})
    got = line_dedup.line_matches(df, first=first).collect()
    texts = {d: (t or "").split("\n") for d, t in rows}
    assert {(r.doc_id, r.line_no) for r in got} == brute_lines(rows) and len(got) == len(brute_lines(rows))
    for r in got:
        x, y = set(texts[r.doc_id][r.line_no].split()), set(texts[r.first_doc_id][r.first_line_no].split())
        assert (r.first_doc_id, r.first_line_no) < (r.doc_id, r.line_no) and r.similarity == pytest.approx(len(x & y) / len(x | y)) and r.similarity >= 0.8


def test_dense_lines(spark):
    words = [f"v{i}" for i in range(30)]
    rows = [(i, " ".join([*words[:29], f"u{i}"])) for i in range(300)]
    got = line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == set(range(1, 300))


def test_very_long_line_and_largest_id(spark):
    """Lines of 60,000 words, which outgrow the bitmap, and an id of 2^63 - 1, beside rows with null ids and without."""
    r = random.Random(12)
    long = [f"l{r.randrange(10**6)}" for _ in range(60_000)]
    near, far = [*long[:55_000], *[f"m{i}" for i in range(2_000)]], [*long[:30_000], *[f"k{i}" for i in range(30_000)]]
    last = 2**63 - 1
    rows = [(1, " ".join(long)), (2, " ".join(far)), (last, "\n".join(["a b c d e f", " ".join(near)])), (5, "a b c d e f"), (6, "x " * 100_000)]
    want = brute_lines(rows)
    assert want == {(last, 0), (last, 1)}
    got = line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.line_no) for x in got} == want
    more = line_dedup.line_matches(spark.createDataFrame([*rows, (None, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted(str((x.doc_id, x.line_no)) for x in more) == ["(None, 0)", "(None, 0)", "(None, 1)"] or sorted(str((x.doc_id, x.line_no)) for x in more) == ["(None, 0)", "(None, 1)"]


def test_word_in_very_many_unlike_lines(spark):
    """One word in all of 20,000 lines of few words, so that it stands in many prefixes; and some lines that are alike."""
    r = random.Random(13)
    rows = [(i, f"common u{r.randrange(10**9)} v{r.randrange(10**9)} common w{r.randrange(40)}") for i in range(20_000)] + [(30_000 + i, f"common a{i} b{i} c{i} d{i}") for i in range(50)] + [(40_000 + i, f"d{i} c{i} b{i} common a{i}") for i in range(50)]
    got = line_dedup.line_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == {40_000 + i for i in range(50)}


def test_drop_lines(spark, empty):
    rows = [(1, "a b c\nkeep me\n\na b c"), (2, "c b a\nnew line here"), (3, None), (None, "keep me\nx"), (2, "c b a\nnew line here"), (4, "")]
    out = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(0)))
    assert out.columns == ["doc_id", "text", "_gone"] or "text" in out.columns
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(map(str, [(1, "a b c\nkeep me\n"), (2, "new line here"), (2, "new line here"), (3, None), (None, "x"), (4, "")]))
    assert line_dedup.line_matches(empty).count() == 0 and line_dedup.drop_lines(empty).count() == 0


def test_signatures_rule_pairs_out_before_whole_sets_meet(spark):
    import numpy as np

    from ratiospark.llm import shingles

    base = np.random.default_rng(3).integers(-(2**62), 2**62, 400).tolist()
    sets = spark.createDataFrame([(1, base[:100]), (2, base[5:105]), (3, base[99:199]), (4, base[300:310])], "node long, words array<long>")
    signs = sets.mapInArrow(shingles._signatures, "node long, size int, " + ", ".join(f"{x} long" for x in shingles._SIGNS))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4)], "a long, b long")
    assert [tuple(r) for r in shingles._near(pairs, signs).collect()] == [(1, 2)]
