"""Removal of repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from ratiospark.llm import suffix_dedup

rng = random.Random(5)
SCHEMA = "doc_id long, text string"


def brute(rows, size=50):
    last = 2**63 - 1
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            least[s] = min(least.get(s, last), last if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < (last if i is None else i):
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def words(n):
    return " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "é", "consectetur", "adipiscing", "a", "日本"]) + str(rng.randint(0, 99)) for _ in range(n))


def corpus():
    passages = [words(rng.randint(8, 60)) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else words(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(30)]  # copies
    rows += [(240 + i, rows[9][1].replace("lorem", "LOREM", 1)) for i in range(10)]
    rows += [(260, None), (261, ""), (262, "x" * 49), (263, "x" * 50), (264, "y" + "x" * 50), (265, "x" * 3000), (266, "ab" * 2000), (267, "ab" * 70), (268, "\0" * 120), (269, "\0" * 60 + "q")]
    rows += [(270, words(4000) + rows[3][1] + words(10)), (3, rows[3][1]), (3, rows[3][1] + "z"), (None, rows[11][1]), (None, "unseen " + rows[12][1]), (-5, rows[13][1][10:150]), (2**63 - 1, rows[14][1] + " last")]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


def found(df, **more):
    return sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in suffix_dedup.remove_repeats(df, **more).collect())


@pytest.mark.parametrize(("chunk", "hot", "slab"), [(1 << 20, 20_000, 1 << 20), (3000, 20_000, 1 << 20), (3000, 3, 700), (20_000, 1, 4096)])
def test_against_brute_force(spark, monkeypatch, chunk, hot, slab):
    monkeypatch.setattr(suffix_dedup, "SLAB", slab)
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("x") for n in ("t", "chunk", "r", "n", "keys", "docs", "found")})
    assert found(df.repartition(5), chunk_bytes=chunk, hot_docs=hot) == brute(ROWS)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None), (2, "")], SCHEMA)) == brute([(1, None), (2, "")])


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_suffix_order(letters):
    """The least document of each string, over few letters, so that equal strings begin at all residues."""
    g = np.random.default_rng(letters)
    motif = g.integers(0, letters, 90).astype(np.uint8)
    parts, docs = [], []
    for k in range(60):
        a = g.integers(0, 40)
        x = np.concatenate([g.integers(0, letters, g.integers(0, 30)).astype(np.uint8), motif[a:], g.integers(0, letters, g.integers(0, 9)).astype(np.uint8)])
        parts.append(x)
        docs.append(int(g.integers(-9, 9)))
    sizes = np.array([len(x) for x in parts])
    got = suffix_dedup.least_docs(np.concatenate(parts), sizes, np.array(docs))
    least = {}
    for x, d in zip(parts, docs, strict=True):
        for k in range(len(x) - 49):
            s = x[k : k + 50].tobytes()
            least[s] = min(least.get(s, d), d)
    assert got.tolist() == [least[x[k : k + 50].tobytes()] for x in parts for k in range(len(x) - 49)]


def test_names_of_many_bits():
    """Tuples too long for 64 bits are ordered all the same."""
    g = np.random.default_rng(0)
    keys = [g.integers(0, 3, 500) * (1 << 40) for _ in range(3)]
    order, fresh = suffix_dedup._named(*keys)
    rows = list(zip(*[k[order].tolist() for k in keys], strict=True))
    assert rows == sorted(rows) and fresh.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(500)]


def test_equal_segments_are_sorted_once(monkeypatch):
    """Equal segments of several chunks are sorted as one, and not at all if no other segment has their anchor."""
    copies, passage = [words(60) for _ in range(20)], words(30)
    rows = [(3 * i + k, t) for k in range(3) for i, t in enumerate(copies)]
    rows += [(100 + i, words(20) + " " + passage + " " + words(20)) for i in range(9)]
    chunks = [pa.table({"doc_id": pa.array([i for i, _ in part], pa.int64()), "t": pa.array([t.encode() for _, t in part], pa.binary())}) for part in (rows[k::3] for k in range(3))]
    calls, least_docs = [], suffix_dedup.least_docs

    def counted(text, sizes, docs):
        ends = np.cumsum(sizes)
        calls.extend(text[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True))
        return least_docs(text, sizes, docs)

    monkeypatch.setattr(suffix_dedup, "least_docs", counted)
    ids = [(pa.scalar(k),) for k in range(3)]
    told = suffix_dedup._tell(pa.concat_tables([suffix_dedup._ask(1)(i, c) for i, c in zip(ids, chunks, strict=True)]))
    own = [told.filter(pc.equal(told["chunk"], k)) for k in range(3)]
    dealt = pa.concat_tables([suffix_dedup._deal(1, 20_000)(i, c, t) for i, c, t in zip(ids, chunks, own, strict=True)])
    found = suffix_dedup._find(dealt)
    out = []
    for k, (i, c, t) in enumerate(zip(ids, chunks, own, strict=True)):
        answers = pa.concat_tables([t, found.filter(pc.equal(found["chunk"], k))], promote_options="default")
        out += [(str(r["doc_id"]), *list(r.values())[1:]) for r in suffix_dedup._remove(1, 20_000)(i, c, answers).to_pylist()]
    assert sorted(out) == brute(rows)
    assert len(calls) == len(set(calls))
    assert 0 < sum(map(len, calls)) < pc.sum(dealt["n_bytes"]).as_py() / 4
