"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from .common import discard, partitions, table, written
from .components import components
from .shingles import linked, shingle_sets

#: Bit patterns of the 256 byte values, least significant bit first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
BYTES, BITS = 8, 64
MAX_BITS = 4
#: A posting with more fingerprints is indexed once more by further places.
POSTING = 4096
#: Postings up to this length are compared all with all in common steps; longer ones grow a spanning forest each.
SHORT = 24
#: Members a posting has on average at most; beyond it the index takes one more place.
FULL = 64

def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats counted: a bit is 1 if it is set in over half of their hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and ASCII white space alone
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(1, len(tokens) - words + 1)
    last = ends[-1:] if len(tokens) < words else ends[words - 1 :]
    starts, stops = [0, *ends[: n - 1].tolist()], (last - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    by_byte = hashes.view(np.uint8).reshape(-1, BYTES)
    if len(hashes) < 48:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # how often each byte value stands at each place, times its bits
        counts = np.bincount((by_byte + np.arange(BYTES, dtype=np.int64) * 256).ravel(), minlength=BYTES * 256).reshape(BYTES, 256)
        ones = (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(text: Column) -> Column:
    """The 64 bits as a signed long."""
    return _fingerprints(text)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes each pair shares."""
    return ((a ^ b).view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)


def near(a: np.ndarray, b: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Places of the pairs that pass the count filter, as fingerprints within `most` bits share at least 8 - most positional bytes,
    and whose bits then verify it."""
    some = np.flatnonzero(tally(a, b) >= BYTES - most)
    return some[np.bitwise_count((a[some] ^ b[some]).view(np.uint64)) <= most]


def forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints with at most `most` differing bits. Each one found is compared with
    those not yet reached, so that a dense group costs few comparisons and gives a link less than it has members."""
    rest, links = np.asarray(prints, np.int64), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            at = near(rest, np.full(len(rest), x), most)
            if len(at):
                found = rest[at]
                links += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = np.delete(rest, at)
    return links


def covering(size: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the eight places, chosen greedily, of which one lies within any four places: fingerprints that share four
    positional bytes share all bytes of one of these."""
    open_, chosen = set(combinations(range(BYTES), BYTES - MAX_BITS)), []
    while open_:
        best = max(combinations(range(BYTES), size), key=lambda c: sum(set(c) <= set(x) for x in open_))
        chosen.append(best)
        open_ = {x for x in open_ if not set(best) <= set(x)}
    return chosen


def _mask(places: tuple[int, ...], width: int = 8) -> int:
    """A pattern that keeps the places of `width` bits, as a signed long."""
    m = sum(((1 << width) - 1) << (width * i) for i in places)
    return m - (1 << 64) if m >= 1 << 63 else m


def _parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns mask, key, fp of whole postings, many at a time, from batches in their order; a posting that goes past limit comes in
    parts and with True, so that memory doesn't grow with it."""
    held, over = [np.array([], np.int64)] * 3, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("mask", "key", "fp"), strict=True)]
        if over is not None:  # what follows of a long posting
            end = int(np.argmin(np.append((cols[0] == over[0]) & (cols[1] == over[1]), False)))
            if end:
                yield [c[:end] for c in cols], True
            cols = [c[end:] for c in cols]
            if not len(cols[0]):
                held = cols
                continue
            over = None
        last = len(cols[0]) - int(np.argmin(np.append(((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]))[::-1], False)))
        if last:
            yield [c[:last] for c in cols], False
        held = [c[last:] for c in cols]
        if len(held[0]) > limit:
            yield held, True
            over, held = (held[0][0], held[1][0]), [np.array([], np.int64)] * 3
    if len(held[0]):
        yield held, False


LINKS = "a long, b long, mask long"


def _search(limit: int):
    """(mask, key, fp) in the order of postings -> LINKS: links within postings, with mask 0; of postings with more than limit
    members a row for each member, with the posting's mask."""

    def out(a, b, mask):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mask, pa.int64())], ["a", "b", "mask"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mask, key, fp), over in _parts(batches, limit):
            fresh = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            size = np.diff(np.append(fresh, len(fp)))
            long = np.repeat((size > limit) | over, size)
            if long.any():
                yield out(fp[long], fp[long], mask[long])
            links = [np.empty((0, 2), np.int64)]
            for k in np.flatnonzero((size > SHORT) & (size <= limit) & (not over)):
                links.append(np.array(forest(fp[fresh[k] : fresh[k] + size[k]], MAX_BITS), np.int64).reshape(-1, 2))
            end = np.repeat(np.append(fresh, len(fp))[1:], size)
            here, k = np.flatnonzero(np.repeat((size > 1) & (size <= min(SHORT, limit)) & (not over), size)), 1
            while len(here := here[here + k < end[here]]):  # every member meets its k-th next
                at = here[near(fp[here], fp[here + k])]
                links.append(np.stack([fp[at], fp[at + k]], axis=1))
                k += 1
            found = np.unique(np.concatenate(links), axis=0)
            if len(found):
                yield out(found[:, 0], found[:, 1], np.zeros(len(found), np.int64))

    return search


def _looked_up(keyed: DataFrame, rows: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """keyed (fp, mask, key), about so many rows -> links (a, b), and the members (fp, mask) of postings longer than limit."""
    n = partitions(keyed.sparkSession)
    # those that would fill a task of their own go on at once: at most one for each task
    hot = F.broadcast(written(keyed.groupBy("mask", "key").count().filter(F.col("count") > max(limit, rows // n)).select("mask", "key"), "simhash-hot"))
    rest = keyed.join(hot, ["mask", "key"], "left_anti").select("mask", "key", "fp").repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
    found = written(rest.mapInArrow(_search(limit), LINKS), "simhash-links")
    long = found.filter("mask <> 0").select(F.col("a").alias("fp"), "mask").unionByName(keyed.join(hot, ["mask", "key"], "left_semi").select("fp", "mask"))
    return found.filter("mask = 0").select("a", "b"), written(long, "simhash-long")


def near_links(prints: DataFrame, posting: int = POSTING, full: int = FULL) -> DataFrame:
    """prints (fp: distinct longs) -> (a, b): links that join what any chain of pairs within MAX_BITS bits joins.

    Two fingerprints within 4 bits differ in at most 4 of their 8 bytes, so they share at least 4 positional bytes. The inverted index
    has postings for sets of positional bytes, two places to a set, or more if postings would have over `full` members on average; the sets
    are chosen so that any four places hold one of them. For each pair that meets in a posting the shared positional bytes
    are tallied, pairs with at least 4 are kept, and those are verified by their bits. Postings longer than `posting` are indexed once
    more, by four bytes that contain theirs, and if they are still too long by 12 of the 16 half-bytes, which leaves 2^16
    fingerprints at most. Postings with more than a task's share of all rows go there without meeting in a task."""
    count = prints.count()
    size = next((s for s in (2, 3) if count >> (8 * s) < full), 4)
    keyed = lambda p, masks: p.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    first = covering(size)
    links, long = _looked_up(keyed(prints, F.array(*[F.lit(_mask(c)) for c in first])), count * len(first), posting)
    four = list(combinations(range(BYTES), BYTES - MAX_BITS))
    halves = [_mask(c, 4) for c in combinations(range(2 * BYTES), 2 * BYTES - MAX_BITS)]
    # of the half-bytes' patterns those that contain the posting's own places: 70 for each
    steps = [({_mask(c): [_mask(x) for x in four if set(c) <= set(x)] for c in first}, posting), ({_mask(c): [h for h in halves if h & _mask(c) == _mask(c)] for c in four}, 1 << 16)]
    for choice, limit in steps[1:] if size == 4 else steps:
        if long.isEmpty():
            break
        masks = F.element_at(F.create_map(*[x for m, inner in choice.items() for x in (F.lit(m), F.array(*[F.lit(i) for i in inner]))]), F.col("mask"))
        finer = written(keyed(long.select("fp", masks.alias("masks")), F.col("masks")).select("fp", "mask", "key").distinct(), "simhash-finer")
        more, long = _looked_up(finer, finer.count(), limit)
        links = links.unionByName(more)
    return links


def _named(docs: DataFrame, id_col: str, text_col: str, posting: int, similar: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp) and classes (fp, root, component_id); a fingerprint's root is that of its component."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), (F.col(text_col) if similar else fingerprints(F.col(text_col))).alias("t" if similar else "fp"))
    whole = written(shingle_sets(rows, fingerprint).withColumn("node", F.xxhash64("words")) if similar else rows, "simhash-rows")
    rows = written(whole.select("doc_id", "text_hash", "fp"), "simhash-rows") if similar else whole
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    links = near_links(classes.select("fp"), posting)
    roots = written(linked(whole, links) if similar else components(links), "simhash-roots")
    if similar:
        discard(whole)
    reach = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = reach.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, reach.select("fp", "root").join(ids, "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (16 hex digits), component_id.

    Fingerprints within 4 bits are linked; component_id is the smallest doc_id that links reach. Copies share one fingerprint,
    of which the index holds one. Null and empty texts have fingerprint 0 and link like others. Rows with a null id link too;
    a component of null ids alone has a null component_id. Repeated ids are rows like others. An empty table gives no rows."""
    rows, named = _named(docs, id_col, text_col, posting)
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING, similar: bool = False) -> DataFrame:
    """docs with one row of each component, that with the smallest id (null last, then smallest text hash); columns unchanged.

    similar: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more are linked too."""
    rows, named = _named(docs, id_col, text_col, posting, similar)
    rows = written(rows.join(named.select("fp", "root"), "fp").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times")), "simhash-keys")
    first = written(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")), "simhash-first")
    gone = rows.join(first, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    gone = gone.select(F.col("doc_id").alias("__rs_id"), F.col("text_hash").alias("__rs_hash"))
    mine = (docs[id_col].cast("long").eqNullSafe(F.col("__rs_id"))) & (F.xxhash64(docs[text_col]) == F.col("__rs_hash"))
    kept = docs.join(gone, mine, "left_anti")
    if rows.filter("times > 1").isEmpty():
        return kept
    return kept.withColumns({"__rs_id": F.col(id_col).cast("long"), "__rs_hash": F.xxhash64(text_col)}).dropDuplicates(["__rs_id", "__rs_hash"]).drop("__rs_id", "__rs_hash")


def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
