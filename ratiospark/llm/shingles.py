"""Similar documents: an exact set-similarity join of word shingles with prefix, length and position filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, written
from .components import components
from .line_dedup import repeated_keys
from .words import mix

#: Words of a shingle. The least Jaccard similarity is 4/5; filters and verification state it in whole numbers.
WORDS = 5
#: Shingles are counted in so many cells, which gives the order of rarity; a table of this size is broadcast.
CELLS = 1 << 16
#: Documents that a worker takes at once.
PORTION = 500
#: Bits of a set's signature, in longs of 64: the parity of its shingles in each of so many cells.
SIGNATURE = 512
_SIGNS = [f"s{k}" for k in range(SIGNATURE // 64)]
_U = np.uint64
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], _U)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, of the whole text if it has fewer words; words and case as for fingerprints."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.array([], _U)
    words = np.fromiter(map(xxhash.xxh64_intdigest, tokens), _U, len(tokens))
    n, h = max(1, len(words) - WORDS + 1), np.zeros(max(1, len(words) - WORDS + 1), _U)
    for k in range(min(WORDS, len(words))):
        h += words[k : k + n] * _MIX[k]
    return np.unique(h)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of PORTION rows, which bounds the workers' memory."""
    for batch in batches:
        for k in range(0, batch.num_rows, PORTION):
            yield batch.slice(k, PORTION)


def shingle_sets(docs: DataFrame, fingerprint: Callable[[str | None], int]) -> DataFrame:
    """docs (doc_id, text_hash, t) -> (doc_id, text_hash, fp, words): fingerprints as signed longs and distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            texts = batch.column("t").to_pylist()
            prints, sets = np.array([fingerprint(t) for t in texts], _U).view(np.int64), [shingles(t) for t in texts]
            ends = np.cumsum([0, *map(len, sets)])
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints), words], ["doc_id", "text_hash", "fp", "words"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long, words array<long>")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        counts += np.bincount(batch.column("words").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], ["cell", "n"])


def _rarity(sets: DataFrame) -> np.ndarray:
    """Place of each cell in the order of rising counts over all shingles of all documents."""
    # CELLS rows at most; written first, as whole sets go to Python in smaller batches then
    cells = written(sets.mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "shingle-cells").toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    place = np.empty(CELLS, _U)
    place[np.lexsort((np.arange(CELLS), counts))] = np.arange(CELLS, dtype=_U)
    return place


def _picked(bitmap_of, bit: bool):
    """(node, words) of the nodes whose bit in the bitmap is as given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = bitmap_of()
        for batch in batches:
            at = np.mod(batch.column("node").to_numpy(), 64 * len(bitmap))
            yield batch.filter(pa.array(((bitmap[at >> 6] >> (at & 63).astype(_U)) & _U(1)).astype(bool) == bit))

    return run


def _prefixes(place_of):
    """(node, words) -> (w, node, n, at): the rarest shingles of each set, of which a similar set must share one, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = place_of()
        for batch in _portions(batches):
            words = batch.column("words")
            n = np.asarray(words.value_lengths()).astype(np.int64)
            h = words.flatten().to_numpy().view(_U)
            token = (place[(h & _U(CELLS - 1)).astype(np.int64)] << _U(48)) | (h >> _U(16))
            doc = np.repeat(np.arange(len(n)), n)
            order = np.argsort(token)
            narrow = doc[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64)  # numpy sorts 16 bits by radix
            token = token[order[np.argsort(narrow, kind="stable")]]
            at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < (n - -(-4 * n // 5) + 1)[doc]
            doc = doc[keep]
            cols = [token[keep].view(np.int64), batch.column("node").to_numpy()[doc], n[doc].astype(np.int32), at[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w", "node", "n", "at"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Whole runs of equal w of two rows or more, from batches in the order of w; for each row its run's start and end."""
    held: list[pa.RecordBatch] = []

    def closed(batches):
        cols = {k: np.concatenate([b.column(k).to_numpy() for b in batches]) for k in batches[0].schema.names}
        fresh = np.flatnonzero(np.concatenate([[True], cols["w"][1:] != cols["w"][:-1]]))
        size = np.diff(np.append(fresh, len(cols["w"])))
        keep, size = np.repeat(size > 1, size), size[size > 1]
        ends = np.cumsum(size)
        return {k: v[keep] for k, v in cols.items()}, np.repeat(ends - size, size), np.repeat(ends, size)

    for batch in batches:
        if not batch.num_rows:
            continue
        w = batch.column("w").to_numpy()
        cut = int(np.searchsorted(w, w[-1], "left"))
        if cut or held and held[-1].column("w")[-1].as_py() != w[0]:
            yield closed([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield closed(held)


def _fit(n, m, room_n, room_m):
    """Whether sets of n and m shingles, which have so many from the first one shared on, may have the similarity."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.minimum(room_n, room_m) >= (4 * (n + m) + 8) // 9)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of more than one set, and the first of each if the filters let the two be similar."""
    for cols, start, _ in _runs(batches):
        n, room, node = cols["n"].astype(np.int64), cols["n"].astype(np.int64) - cols["at"], cols["node"]
        first = np.where(_fit(n, n[start], room, room[start]), node[start], node)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cols["w"], node, cols["n"], cols["at"], first)], ["w", "node", "n", "at", "first"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, words) -> (node, size, s0, s1, ...): each shingle flips one bit, so sets differ in at least as many shingles as signatures in bits."""
    for batch in _portions(batches):
        words = batch.column("words")
        n = np.asarray(words.value_lengths()).astype(np.int64)
        bit = (mix(words.flatten().to_numpy().view(_U), 0x8CB92BA72F3D8DD7) >> _U(40)).astype(np.int64) % SIGNATURE
        odd = np.bincount(np.repeat(np.arange(len(n)), n) * SIGNATURE + bit, minlength=len(n) * SIGNATURE) & 1
        signs = np.packbits(odd.astype(np.uint8).reshape(len(n), -1), axis=1, bitorder="little").view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n.astype(np.int32)), *[pa.array(np.ascontiguousarray(x)) for x in signs.T]], ["node", "size", *_SIGNS])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one posting in different components that pass the filters of length, place and signature. All rows meet their k-th next
    together."""
    for cols, start, end in _runs(batches):
        n, node, root = cols["n"].astype(np.int64), cols["node"], cols["root"]
        room, signs = n - cols["at"], np.stack([cols[x] for x in _SIGNS], axis=1).view(_U)
        mixed = np.zeros(len(n) + 1, bool)
        mixed[start[root != root[start]]] = True
        here, k, found = np.flatnonzero(mixed[start]), 1, [np.empty((0, 2), np.int64)]
        while len(here := here[here + k < end[here]]):
            i = here[(root[here] != root[here + k]) & _fit(n[here], n[here + k], room[here], room[here + k])]
            size = n[i] + n[i + k]
            i = i[np.bitwise_count(signs[i] ^ signs[i + k]).sum(axis=1) <= size - 2 * ((4 * size + 8) // 9)]
            k += 1
            found.append(np.sort(np.stack([node[i], node[i + k - 1]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _near(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes whose signatures leave the similarity open."""
    ends = [signs.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), *[F.col(s).alias(f"{x}_{s}") for s in _SIGNS]) for x in ("a", "b")]
    size, bits = F.col("a_size") + F.col("b_size"), F.lit(0)
    for s in _SIGNS:
        bits = bits + F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}")))
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    return both.filter(bits <= size - 2 * F.call_function("div", 4 * size + 8, F.lit(9))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs of nodes whose whole sets have the similarity. Sets are looked up in a bitmap of the pairs' nodes."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key1")).distinct()
    bitmap = pairs.sparkSession.sparkContext.broadcast(repeated_keys(ends))
    some = sets.mapInArrow(_picked(lambda: bitmap.value, True), "node long, words array<long>").dropDuplicates(["node"])
    both = pairs.join(some.toDF("a", "a_words"), "a").join(some.toDF("b", "b_words"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("a_words", "b_words")).alias("shared"), (F.size("a_words") + F.size("b_words")).alias("size"))
    return written(both.filter("9 * shared >= 4 * size").select("a", "b"), "shingle-links")


def linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (fp, words: shingle sets), links (a, b) of fps -> (node, root): components of the fps, joined by links and by sets with a
    Jaccard similarity of 4/5 or more.

    Sets are ordered by rarity and index their prefixes. Each is compared with one other of each posting at first, which joins a
    dense group in about as many pairs as it has members; then all pairs of a posting that are still in different components
    are compared, so that every similar pair is joined. A signature of each set spares most pairs the comparison of whole sets. Equal sets are compared once. Documents without words have no set."""
    spark = rows.sparkSession
    n = partitions(spark)
    sets = rows.select("node", "words")
    groups = written(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.max("fp").alias("most"), F.count(F.lit(1)).alias("times")), "shingle-groups")
    place = spark.sparkContext.broadcast(_rarity(sets))
    bitmap = spark.sparkContext.broadcast(repeated_keys(groups.filter("times > 1").select(F.col("node").alias("key1"))))
    entries, words = "w long, node long, n int, at int", "node long, words array<long>"
    prefixes = _prefixes(lambda: place.value)
    once = sets.mapInArrow(lambda batches: prefixes(_picked(lambda: bitmap.value, False)(batches)), entries)  # one worker a task
    again = sets.mapInArrow(_picked(lambda: bitmap.value, True), words).dropDuplicates(["node"]).mapInArrow(prefixes, entries)
    postings = once.unionByName(again)
    # two orders, so that a group's members meet different firsts
    postings = postings.repartition(n, "w").sortWithinPartitions("w", F.xxhash64(F.col("w").bitwiseAND(1), "node"))
    shared = written(postings.mapInArrow(_shared, "w long, node long, n int, at int, first long"), "shingle-postings")
    pairs = written(shared.filter("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct(), "shingle-pairs")
    signs = written(sets.mapInArrow(_signatures, "node long, size int, " + ", ".join(f"{x} long" for x in _SIGNS)).dropDuplicates(["node"]), "shingle-signs")
    near = written(_near(pairs, signs), "shingle-near")
    discard(pairs)
    prints = groups.select("node", "fp")
    named = lambda p: p.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = rows.select("node", "fp").join(groups.filter("fp <> most AND times > 1").select("node", F.col("fp").alias("b")), "node").select(F.col("fp").alias("a"), "b")
    roots = written(components(links.unionByName(named(_verified(near, sets))).unionByName(equal)), "shingle-roots")
    placed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    placed = written(shared.select("w", "node", "n", "at").join(placed, "node"), "shingle-placed")
    discard(shared)
    mixed = placed.groupBy("w").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("w")
    open_ = written(placed.join(mixed, "w", "left_semi"), "shingle-open")
    discard(placed)
    apart = open_.join(signs.drop("size"), "node").repartition(n, "w").sortWithinPartitions("w").mapInArrow(_apart, "a long, b long")
    apart = written(apart.distinct().join(near, ["a", "b"], "left_anti"), "shingle-apart")
    for table in (open_, signs):
        discard(table)
    if apart.isEmpty():
        return roots
    more = named(_verified(apart, sets)).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = written(components(more), "shingle-roots")
    for table in (near, apart, groups):
        discard(table)
    return found
