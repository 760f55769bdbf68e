"""Line deduplication: an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import discard, partitions, table, written
from .words import Lanes, bounds, portions
from .words import mix as _mix

SIMILARITY = 0.8
#: Words are counted in so many cells, which gives the order of rarity; a table of this size is broadcast.
CELLS = 1 << 16
#: Earlier candidates that a line gets from one posting at first; lines for which they don't decide get all in a second round.
FIRST = 32
#: Least bits of a bitmap of keys, such as the one that tells lines without an equal one, which need not be grouped.
BITMAP = 1 << 24
#: Most bits of a bitmap of keys, and of that of the lines whose sets are verified (16 MB).
PLACES = 1 << 27
#: Sorts last, for rows without an id.
NO_ID = np.iinfo(np.int64).max
_POSTINGS = 1 << 18
#: Lines whose postings make up one bucket on average, which is what a task holds at once.
BUCKET_LINES = 50_000
_FIELDS = (("token", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("at", "<i4"), ("bits1", "<u8"), ("bits2", "<u8"))
_U = np.uint64


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for data, begins, _ in portions(batch.column("t")):
            h = Lanes(data).hashes(*bounds(data, begins))
            total += np.bincount((h & _U(CELLS - 1)).astype(np.int64), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["cell", "n"])


def rarity(docs: DataFrame) -> np.ndarray:
    """Place of each cell in the order of rising counts over all words of all documents."""
    cells = docs.mapInArrow(_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS rows at most
    counts = np.zeros(CELLS, np.int64)
    for r in cells:
        counts[r["cell"]] = r["n"]
    place = np.empty(CELLS, _U)
    place[np.lexsort((np.arange(CELLS), counts))] = np.arange(CELLS, dtype=_U)
    return place


def word_sets(texts: pa.Array, place: np.ndarray, wanted: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row and number of every line that has words (and that wanted(row, number) picks), the start of its words, and the distinct
    words of the lines, the rarest first.

    A word is its 64-bit hash turned so that numbers rise from rare to frequent. Of lines that aren't wanted no word is looked at."""
    for data, begins, first in portions(texts):
        breaks = np.unique(np.concatenate([begins[begins < len(data)], np.flatnonzero(data[:-1] == 10) + 1]))
        row = np.searchsorted(begins, breaks, "right") - 1  # of empty texts at one place the last, which is the one with bytes
        number = np.arange(len(breaks)) - np.searchsorted(breaks, begins[row])
        if wanted is not None:
            size = np.diff(np.append(breaks, len(data)))
            pick = wanted(row + first, number)
            row, number, size = row[pick], number[pick], size[pick]
            if not len(row):
                continue
            data, _ = _chunks(data, breaks[pick], size)
            begins = breaks = np.cumsum(size) - size
        starts, ends = bounds(data, begins)
        if not len(starts):
            continue
        h = Lanes(data).hashes(starts, ends)
        line = np.repeat(np.arange(len(breaks)), np.diff(np.append(np.searchsorted(starts, breaks), len(starts))))
        token = (place[(h & _U(CELLS - 1)).astype(np.int64)] << _U(48)) | (h >> _U(16))
        order = np.argsort(token)
        narrow = line[order].astype(np.uint16 if len(breaks) < 1 << 16 else np.int64)  # numpy sorts 16 bits by radix
        order = order[np.argsort(narrow, kind="stable")]
        token, line = token[order], line[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
        token, line = token[fresh], line[fresh]
        if not len(line):
            continue
        starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        mine = line[starts]
        yield row[mine] + first, number[mine].astype(np.int32), starts, token


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(k)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _chunks(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first lengths[i] values from starts[i] on, end to end, and the place of each in its part."""
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return values[np.repeat(starts, lengths) + at], at


def prefix_lengths(n: np.ndarray) -> np.ndarray:
    """Words of which a similar set must share one: all but the least overlap with a set of the least size, plus one. Sets of
    under four words are similar to equal ones alone, which are found by their key."""
    return np.where(n < 4, 0, n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1)


def features(starts: np.ndarray, token: np.ndarray) -> dict[str, np.ndarray]:
    """Of each set: n, the bitmap's two halves and the number of words in its prefix; the prefixes' words and their places."""
    n = np.diff(np.append(starts, len(token)))
    where = _mix(token, 0xC2B2AE3D27D4EB4F)
    bit, second = _U(1) << (where & _U(63)), (where & _U(64)).astype(bool)
    bits1, bits2 = (np.bitwise_xor.reduceat(np.where(second == k, bit, _U(0)), starts) for k in (False, True))
    prefix = prefix_lengths(n)
    words, at = _chunks(token, starts, prefix)
    return {"n": n.astype(np.int32), "bits1": bits1, "bits2": bits2, "prefix": prefix, "words": words, "at": at}


LINES = "doc long, row long, line int, key1 long, key2 long, n int, bits1 long, bits2 long, prefix binary"


def _lines(place_of: Callable[[], np.ndarray]):
    """(doc, row, t) -> LINES: a row for each line with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = place_of()
        for batch in batches:
            for row, number, starts, token in word_sets(batch.column("t"), place):
                key1, key2 = (np.add.reduceat(_mix(token, k), starts) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
                f = features(starts, token)
                offsets = np.concatenate([[0], np.cumsum(8 * f["prefix"])]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(f["words"].astype("<u8").tobytes())])
                take = pa.array(row)
                cols = [batch.column("doc").take(take), batch.column("row").take(take), pa.array(number), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array(f["n"]), pa.array(f["bits1"].view(np.int64)), pa.array(f["bits2"].view(np.int64)), blob]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in LINES.split(", ")])

    return run


def repeated_keys(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bits of key1 set, of 16 to 32 bits a key, BITMAP at least and PLACES at most; rows of words of 64 bits reach the driver,
    PLACES / 64 at most. Past some eight million keys it fills up and spares less; no key is ever without its bit."""
    bits = min(PLACES, max(BITMAP, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.col("key1"), F.lit(bits))
    words = keys.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(key1, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return bitmap.view(_U)


def _is_marked(batch: pa.RecordBatch, bitmap: np.ndarray) -> np.ndarray:
    """Of which lines the key's bit is set; no other line has the set of one of which it isn't."""
    place = np.mod(batch.column("key1").to_numpy(), 64 * len(bitmap))
    return ((bitmap[place >> 6] >> (place & 63).astype(_U)) & _U(1)).astype(bool)


def _marked(bitmap_of: Callable[[], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_is_marked(batch, bitmap_of())))

    return run


def _pack(cols: dict[str, np.ndarray]) -> bytes:
    """Columns by planes of bytes, so that the shuffle's compression finds the zeros."""
    return b"".join(np.ascontiguousarray(cols[k].astype(d)).view(np.uint8).reshape(-1, np.dtype(d).itemsize).T.tobytes() for k, d in _FIELDS)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n, at, cols = len(blob) // sum(np.dtype(d).itemsize for _, d in _FIELDS), 0, {}
    for k, d in _FIELDS:
        size = np.dtype(d).itemsize
        cols[k] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(d).ravel()
        at += n * size
    return cols


BLOBS = "bucket int, blob binary"


class _Buckets:
    """Gathers postings and gives them as blobs, one for each bucket of words; n is negative for lines that look for no partner."""

    def __init__(self, n_buckets: int):
        self.n_buckets, self.held, self.size = n_buckets, [], 0

    def add(self, token, doc, line, n, at, bits1, bits2, times) -> Iterator[pa.RecordBatch]:
        """token and at: of each posting; the others of each line, which has so many postings."""
        many = lambda x: np.repeat(x, times)
        self.held.append({"token": token, "doc": many(doc), "line": many(line), "n": many(n), "at": at, "bits1": many(bits1), "bits2": many(bits2)})
        self.size += len(token)
        if self.size >= _POSTINGS:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            cols = {k: np.concatenate([h[k] for h in self.held]) for k, _ in _FIELDS}
            bucket = (cols["token"] % _U(self.n_buckets)).astype(np.int64)
            order = np.lexsort((cols["token"], bucket))
            full, edges = np.unique(bucket[order], return_index=True)
            blobs = [_pack({k: v[places] for k, v in cols.items()}) for places in np.split(order, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
        self.held, self.size = [], 0


def _postings(n_buckets: int, bitmap_of: Callable[[], np.ndarray] | None = None):
    """LINES -> BLOBS: of the lines that aren't marked if a bitmap is given; all look for partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(n_buckets)
        for batch in batches:
            if bitmap_of is not None:
                batch = batch.filter(pa.array(~_is_marked(batch, bitmap_of())))
            n = batch.column("n").to_numpy()
            times = prefix_lengths(n)
            flat = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), "<u8")
            _, at = _chunks(flat, np.cumsum(times) - times, times)
            get = lambda c: batch.column(c).to_numpy()  # noqa: E731,B023
            yield from buckets.add(flat, get("doc"), get("line"), n, at, get("bits1").view(_U), get("bits2").view(_U), times)
        yield from buckets.out()

    return run


def _index(n_buckets: int, tokens_of: Callable[[], np.ndarray]):
    """LINES -> BLOBS: postings of the words in a bitmap, of lines that look for no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, buckets = tokens_of(), _Buckets(n_buckets)
        for batch in batches:
            n = batch.column("n").to_numpy()
            times = prefix_lengths(n)
            flat = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), "<u8")
            _, at = _chunks(flat, np.cumsum(times) - times, times)
            bit = np.mod(flat.view(np.int64), 64 * len(tokens))
            keep = ((tokens[bit >> 6] >> (bit & 63).astype(_U)) & _U(1)).astype(bool)
            times = np.bincount(np.repeat(np.arange(len(n)), times)[keep], minlength=len(n))
            get = lambda c: batch.column(c).to_numpy()  # noqa: E731,B023
            yield from buckets.add(flat[keep], get("doc"), get("line"), -n, at[keep], get("bits1").view(_U), get("bits2").view(_U), times)
        yield from buckets.out()

    return run


def _probes(n_buckets: int):
    """(doc, line, words) -> BLOBS: postings of lines that look for partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(n_buckets)
        for batch in batches:
            words = batch.column("words")
            sizes = np.asarray(words.value_lengths()).astype(np.int64)
            f = features(np.cumsum(sizes) - sizes, words.flatten().to_numpy().view(_U))
            yield from buckets.add(f["words"], batch.column("doc").to_numpy(), batch.column("line").to_numpy(), f["n"], f["at"], f["bits1"], f["bits2"], f["prefix"])
        yield from buckets.out()

    return run


def candidates(cols: dict[str, np.ndarray], first: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (earlier, later) of entries that share a word and pass the filters, and later ones that got `first` and may have more.

    Length: a set needs 0.8 of the other's size. Position: at the first word that two sets share, the words from there on must
    suffice for the least overlap. Bits: each word flips one of 128 bits, so differing bits can't outnumber differing words.
    All runs of equal words advance together: every entry that still seeks is compared with the k-th one of its run, so that a
    group of near copies is settled by its first member."""
    token, n = cols["token"], np.abs(cols["n"])
    room, bits1, bits2 = n - cols["at"], cols["bits1"], cols["bits2"]
    got, early, late = np.zeros(len(token), np.int32), [np.array([], np.int64)], [np.array([], np.int64)]
    fresh = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.array([], np.int64)
    start = np.repeat(fresh, np.diff(np.append(fresh, len(token))))
    seek = np.flatnonzero((cols["n"] > 0) & (start < np.arange(len(token))))
    other = start[seek]
    least, most = -(-4 * n[seek] // 5), 5 * n[seek] // 4
    while len(seek):
        m = n[other]
        fine = np.flatnonzero((m >= least) & (m <= most))
        a, b = other[fine], seek[fine]
        size = n[a] + n[b]
        need = (4 * size + 8) // 9
        ok = np.minimum(room[a], room[b]) >= need
        a, b, spare = a[ok], b[ok], (size - 2 * need)[ok]
        ok = np.bitwise_count(bits1[a] ^ bits1[b]).astype(np.int32) + np.bitwise_count(bits2[a] ^ bits2[b]) <= spare
        a, b = a[ok], b[ok]
        early.append(a)
        late.append(b)
        other = other + 1
        go_on = other < seek
        if first is not None:
            got[b] += 1  # each b stands here once
            go_on &= got[seek] < first
        seek, other, least, most = seek[go_on], other[go_on], least[go_on], most[go_on]
    return np.concatenate(early), np.concatenate(late), np.flatnonzero(got >= first) if first is not None else np.array([], np.int64)


PAIRS = "a_doc long, a_line int, b_doc long, b_line int, capped boolean"


def _pairs(first: int | None):
    """(bucket, blob) in the buckets' order -> PAIRS; holds one bucket."""

    def of(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_unpack(b) for b in blobs]
        cols = {k: np.concatenate([p[k] for p in parts]) for k, _ in _FIELDS}
        order = np.argsort(cols["token"])
        token = cols["token"][order]
        same = token[1:] == token[:-1]  # words of one posting alone have no partner
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        order = order[np.lexsort((cols["line"][order], cols["doc"][order], cols["token"][order]))]
        cols = {k: v[order] for k, v in cols.items()}
        a, b, capped = candidates(cols, first)
        full = np.zeros(len(order), bool)
        full[capped] = True
        pair = np.stack([cols["doc"][a], cols["line"][a], cols["doc"][b], cols["line"][b], full[b]], axis=1) if len(a) else np.empty((0, 5), np.int64)
        pair = np.unique(pair, axis=0)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(pair[:, k].astype(bool) if t == pa.bool_() else pair[:, k], t) for k, t in enumerate(kinds)], [c.split()[0] for c in PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != here and blobs:
                    yield of(blobs)
                    blobs = []
                here = bucket
                blobs.append(blob)
        if blobs:
            yield of(blobs)

    return run


def _place_bits(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(_U) ^ (line.astype(_U) << _U(40)), 0x9E3779B97F4A7C15) & _U(bits - 1)).astype(np.int64)


def _places(bits: int):
    """(doc, line) -> (w, b): bits of a bitmap of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(_place_bits(batch.column("doc").to_numpy(), batch.column("line").to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((_U(1) << (place & 63).astype(_U)).view(np.int64))], ["w", "b"])

    return run


def _sets(place_of: Callable[[], np.ndarray], wanted_of: Callable[[], np.ndarray]):
    """(doc, row, t) -> (doc, row, line, words): the word sets of the lines whose place is set in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, wanted = place_of(), wanted_of()
        for batch in batches:
            docs = batch.column("doc").to_numpy()

            def picked(row, number, docs=docs):
                bit = _place_bits(docs[row], number, 64 * len(wanted))
                return ((wanted[bit >> 6] >> (bit & 63).astype(_U)) & _U(1)).astype(bool)

            for row, number, starts, token in word_sets(batch.column("t"), place, lambda r, k: picked(r, k)):  # noqa: B023
                ends = pa.array(np.append(starts, len(token)), pa.int32())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("row").take(take), pa.array(number), pa.ListArray.from_arrays(ends, pa.array(token.view(np.int64)))], ["doc", "row", "line", "words"])

    return run


def _found(blobs: DataFrame, first: int | None) -> DataFrame:
    """BLOBS -> PAIRS, each once."""
    n = partitions(blobs.sparkSession)
    pairs = blobs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_pairs(first), PAIRS)
    pairs = pairs.filter("a_doc < b_doc OR a_doc = b_doc AND a_line < b_line")  # a repeated id's lines may have one place
    return written(pairs.groupBy("a_doc", "a_line", "b_doc", "b_line").agg(F.max("capped").alias("capped")), "line-pairs")


def _word_sets(pairs: DataFrame, base: DataFrame, place_of) -> DataFrame:
    """The word sets of the pairs' lines (doc, row, line, words), and of some more: texts are read again and looked up in a bitmap
    of the lines' places, of 16 bits a line and at most PLACES, rather than shuffled. Full bitmaps give more sets than needed."""
    spark = base.sparkSession
    bits = min(PLACES, max(BITMAP, 1 << (32 * pairs.count()).bit_length()))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")), F.struct(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")))).alias("e")).select("e.*")
    words = ends.mapInArrow(_places(bits), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # PLACES / 64 rows at most
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    wanted = spark.sparkContext.broadcast(bitmap.view(_U))
    return written(base.mapInArrow(_sets(place_of, lambda: wanted.value), "doc long, row long, line int, words array<long>"), "line-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """b_doc, b_row, b_line, a: the earliest of the pairs' lines that is similar, and the similarity."""
    side = lambda p: sets.select(*[F.col(c).alias(f"{p}_{c}") for c in ("doc", "row", "line", "words")])
    both = pairs.join(side("b"), ["b_doc", "b_line"]).join(side("a"), ["a_doc", "a_line"])
    shared = F.size(F.array_intersect("a_words", "b_words"))
    both = both.select("a_doc", "a_line", "b_doc", "b_row", "b_line", (shared / (F.size("a_words") + F.size("b_words") - shared)).alias("similarity"))
    good = both.filter(F.col("similarity") >= SIMILARITY - 1e-12)
    return written(good.groupBy("b_doc", "b_row", "b_line").agg(F.min(F.struct("a_doc", "a_line", "similarity")).alias("a")), "line-matches")


_LATER = ["b_doc", "b_line"]


def _near(lines: DataFrame, marked: DataFrame, bitmap_of, base: DataFrame, place_of, first: int) -> DataFrame:
    """Near matches of distinct lines: those that aren't marked, and of the marked ones the first of each set."""
    n = max(partitions(base.sparkSession), lines.count() // BUCKET_LINES)
    cols = ["doc", "line", "n", "bits1", "bits2", "prefix"]
    heads = marked.filter("n >= 4").groupBy("key1", "key2").agg(F.min(F.struct(*cols)).alias("h")).select("h.*")
    pairs = _found(lines.filter("n >= 4").select("key1", *cols).mapInArrow(_postings(n, bitmap_of), BLOBS).unionByName(heads.mapInArrow(_postings(n), BLOBS)), first)
    sets = _word_sets(pairs, base, place_of)
    # the earliest candidate of a line decides about most; the others are looked at where it doesn't
    earliest = written(pairs.groupBy(*_LATER).agg(F.min(F.struct("a_doc", "a_line")).alias("a")).select(*_LATER, "a.a_doc", "a.a_line"), "line-earliest")
    matches = _verified(earliest, sets)
    rest = pairs.join(matches.select(*_LATER).distinct(), _LATER, "left_anti").join(earliest, [*_LATER, "a_doc", "a_line"], "left_anti")
    matches = matches.unionByName(_verified(rest.drop("capped"), sets))
    open_ = pairs.filter("capped").select(*_LATER).distinct().join(matches.select(*_LATER).distinct(), _LATER, "left_anti")
    open_ = written(open_.select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")), "line-open")
    if open_.isEmpty():
        return matches
    # lines that got enough candidates, none of them similar: all lines with a word of their prefixes are looked at
    probes = written(sets.join(open_, ["doc", "line"]).select("doc", "line", "words"), "line-probes")
    size = F.size("words")
    prefix = F.slice("words", 1, size - F.ceil(size * SIMILARITY - 1e-9).cast("int") + 1)
    tokens = base.sparkSession.sparkContext.broadcast(repeated_keys(probes.select(F.explode(prefix).alias("key1")).distinct()))
    all_ = lines.filter("n >= 4").select(cols).mapInArrow(_index(n, lambda: tokens.value), BLOBS)
    pairs = _found(all_.unionByName(probes.mapInArrow(_probes(n), BLOBS)), None).drop("capped")
    return matches.unionByName(_verified(pairs, _word_sets(pairs, base, place_of)))


def line_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST) -> DataFrame:
    """One row per line that an earlier line makes redundant: doc_id, text_hash, line_no, first_doc_id, first_line_no, similarity.

    A line is what stands between \\n; its set holds the words between ASCII white space. A line goes if an earlier one, in the
    order of (doc_id, line number), has a Jaccard similarity of SIMILARITY or more, whether that one stays or not. Equal sets meet
    by a 128-bit key. For the others words are ordered by rarity over all documents, and each set indexes its prefix, the
    shortest part of which a similar set must share a word; length, position and a bitmap prune, and the pairs left are verified
    on whole sets. A line is given the first candidates of a posting, and all of them if those don't decide about it, so that
    a dense group of near copies costs about as many pairs as it has lines.

    The join reports one witness a line, not all links between similar lines. It is an earlier similar line, but not always the
    earliest: that may be hidden where a posting has more than `first` candidates before it and another posting gives a match.

    Lines without words stay. Null and empty texts have none. Rows with a null id come last (beside such rows an id of
    2^63 - 1 counts as null). Rows that agree in id are ordered by
    line number alone: of two such lines with one number neither makes the other redundant. An empty table gives no rows."""
    nameless = bool(docs.agg(F.max(F.col(id_col).isNull())).first()[0])
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(rarity(base.select("t")))
    place_of = lambda: shared.value
    lines = written(base.mapInArrow(_lines(place_of), LINES), "lines")
    groups = lines.groupBy("key1", "key2").agg(F.min(F.struct("doc", "line")).alias("a"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    groups = written(groups, "line-groups")
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_keys(groups))
    bitmap_of = lambda: bitmap.value
    marked = written(lines.mapInArrow(_marked(bitmap_of), lines.schema), "line-marked")
    equal = marked.select("doc", "row", "line", "key1", "key2").join(groups, ["key1", "key2"]).filter((F.col("doc") != F.col("a.doc")) | (F.col("line") != F.col("a.line")))
    equal = equal.select("doc", "row", "line", F.col("a.doc").alias("a_doc"), F.col("a.line").alias("a_line"), F.lit(1.0).alias("similarity"))
    near = _near(lines, marked, bitmap_of, base, place_of, first)
    discard(lines)
    near = near.select(F.col("b_doc").alias("doc"), F.col("b_row").alias("row"), F.col("b_line").alias("line"), "a.a_doc", "a.a_line", "a.similarity")
    # a repeated row's line may be in both parts
    found = equal.unionByName(near).groupBy("doc", "row", "line").agg(F.min(F.struct("a_doc", "a_line", "similarity")).alias("a"))
    given = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)) if nameless else F.col(c)
    return found.select(given("doc").alias("doc_id"), F.col("row").alias("text_hash"), F.col("line").alias("line_no"), given("a.a_doc").alias("first_doc_id"), F.col("a.a_line").alias("first_line_no"), F.col("a.similarity").alias("similarity"))


@arrow_udf(StringType())
def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines of these numbers."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if numbers:
            numbers = set(numbers)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in numbers)
        out.append(text)
    return pa.array(out, pa.string())


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the redundant lines (see line_matches, also for ids, ties and repeated rows) cut from their texts; other columns and
    rows stay. Null and empty texts stay as they are; an empty table gives no rows."""
    gone = line_matches(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__rs_id"), F.col("text_hash").alias("__rs_row")).agg(F.collect_set("line_no").alias("__rs_gone"))
    mine = docs[id_col].cast("long").eqNullSafe(gone["__rs_id"]) & (F.xxhash64(docs[text_col]) == gone["__rs_row"])
    joined = docs.join(gone, mine, "left")
    return joined.withColumn(text_col, _without(F.col(text_col), F.col("__rs_gone"))).select(docs.columns)


def op8(spark, sf_dir):
    return line_matches(table(spark, sf_dir, "documents")).drop("text_hash")
