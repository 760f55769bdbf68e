import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from ratiospark.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        docs, before = stage(spark, docs, SF), docs
        assert docs.columns == (before.columns if name != "sharding" else [*before.columns, "shard"])
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == docs.count() > 0
    assert corpus_pipeline.sharding(spark, corpus_pipeline.mixing(spark, before.limit(0), SF), SF).count() == 0


def small_tables(spark, folder):
    """Documents with toxic ones, near-duplicates, copies, benchmark passages, nulls, empty texts, repeated rows and clashing columns."""
    r = random.Random(8)
    prose = lambda n, word="w": " ".join(f"{word}{r.randrange(900)}" for _ in range(n))
    toxic = lambda: prose(15) + " " + " ".join(r.choice(["vile", "foul", "nasty", "rotten"]) for _ in range(12)) + " " + prose(5)
    item = prose(25, "q")
    rows = [(i, prose(r.randint(30, 60)), r.choice(["a", "b", None])) for i in range(150)]
    kinds = {"toxic": list(range(200, 240)), "leak": [300, 301], "near": [], "copy": [400, 401, 402]}
    rows += [(i, toxic(), "a") for i in kinds["toxic"]]
    rows += [(300, f"{prose(20)} {item} {prose(9)}", "b"), (301, f"{item.upper()}", "a")]
    for i in range(5):
        words = rows[i][1].split()
        rows.append((320 + i, " ".join([*words, "tail"]), "b"))
        kinds["near"].append((i, 320 + i))
    rows += [(i, rows[20][1], "a") for i in kinds["copy"]]
    rows += [(500, None, "a"), (501, "", "b"), (None, prose(40), "a"), (None, prose(41), None), rows[30], rows[30]]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("lang", "shard", "t", "fp", "node", "words", "__size")})
    docs.write.parquet(f"{folder}/documents.parquet")
    labelled = [(i, r.randrange(2), int(i in kinds["toxic"])) for i, *_ in rows if i is not None and i < 240 and i % 4]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, rows, kinds, item


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's decisions, on its own input, against plain Python."""
    import corpus_pipeline
    from tests.llm.test_documents import brute_components, brute_overlaps, brute_targets

    docs, rows, kinds, item = small_tables(spark, tmp_path)
    folder, seen = str(tmp_path), {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{tmp_path}/at-{name}")
        at = spark.read.parquet(f"{tmp_path}/at-{name}")
        assert sorted(at.columns) == sorted(docs.columns)
        seen[name] = sorted(((x.doc_id, x.text, x.source) for x in at.collect()), key=str)
    ids = lambda name: collections.Counter(x[0] for x in seen[name])
    assert ids("toxicity") == collections.Counter(i for i, *_ in rows if i not in kinds["toxic"])

    left = seen["toxicity"]
    _, prints = brute_components([(k, t) for k, (_, t, _) in enumerate(left)])
    links = [(k, c) for k, c in enumerate(prints)] + brute_pairs(left)
    root = list(range(len(left)))
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(left):
        least.setdefault(find(k), []).append((i is None, i or 0))
    assert ids("near_dedup") == collections.Counter(None if none else i for none, i in map(min, least.values()))
    assert all(a in ids("near_dedup") and b not in ids("near_dedup") for a, b in kinds["near"])

    clean = [x for x in seen["near_dedup"] if not brute_overlaps([(1, item)], x[1])]
    assert seen["decontamination"] == clean and not {300, 301} & set(ids("decontamination"))
    sizes = collections.Counter()
    for _, t, s in clean:
        sizes[s] += len((t or "").split())
    want, taken, largest = brute_targets(sizes, (5, 2, 1), 3), collections.Counter(), max(len((t or "").split()) for _, t, _ in clean)
    for _, t, s in seen["mixing"]:
        taken[s] += len((t or "").split())
    assert set(seen["mixing"]) <= set(clean) and all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert seen["sharding"] == seen["mixing"] and {x.shard for x in at.collect()} <= set(range(24))

    again = corpus_pipeline.run(spark, folder)
    assert sorted(((x.doc_id, x.text, x.source) for x in again.collect()), key=str) == seen["sharding"]


def brute_pairs(rows):
    """Pairs of rows whose sets of 5-word shingles have a similarity of 0.8 or more."""
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, *_ = small_tables(spark, tmp_path / "full")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
