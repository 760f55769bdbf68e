"""Removal of byte strings that stand in an earlier document, by difference-cover suffix sorting.

Any two equal strings of LENGTH bytes hold the same anchor: their GRAM bytes with the least hash. So documents' strings are dealt to
tasks by anchor, and equal strings meet. Each task sorts the suffixes of the distinct segments dealt to it by the difference-cover method."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, table
from .words import mix

#: Fixed value of the contract: bytes of a string whose second occurrence goes.
LENGTH = 50
#: Bytes of an anchor; one begins in the first REACH + 1 bytes of every string.
GRAM = 20
REACH = LENGTH - GRAM
#: Bytes of text in a chunk, the unit that is dealt out and answered.
CHUNK = 8 << 20
#: Bytes whose suffixes are sorted at once. Longer strings of one anchor are sorted together all the same.
SLAB = 1 << 20
#: Strings whose anchors are computed at once, in a processor's cache.
PIECE = 1 << 15
#: Documents with one anchor beyond which its strings are dealt one by one, by their ends too, so that no task gets all of them.
HOT_DOCS = 20_000
#: Bytes of a character of the difference cover: three names of three characters reach over a string's 50 bytes.
CHAR = 6

_U = np.uint64
_LAST = np.iinfo(np.int64).max


def anchors(text: np.ndarray) -> np.ndarray:
    """text: bytes -> for each string of LENGTH bytes, by its start, the least hash of the grams in it."""
    n = len(text) - LENGTH + 1
    if n <= 0:
        return np.array([], _U)
    found = np.empty(n, _U)
    for at in range(0, n, PIECE):
        part = text[at : at + PIECE + LENGTH - 1].astype(_U) + _U(1)
        h, step, spare = part, 1, None
        size = GRAM
        while size:  # hashes of 1, 2, 4, ... bytes; those of GRAM's binary digits are joined
            if size & 1:
                spare = (h, step) if spare is None else (_joined(spare[0], h, spare[1]), spare[1] + step)
            size >>= 1
            if size:
                h, step = _joined(h, h, step), 2 * step
        low, width = mix(spare[0], 0xD6E8FEB86659FD93), 1
        while 2 * width <= REACH + 1:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        rest = REACH + 1 - width
        found[at : at + PIECE] = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return found


def _joined(a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of strings that begin with a's and go on, `apart` bytes later, with b's."""
    n = min(len(a), len(b) - apart)
    x = a[:n] * _U(0x9E3779B97F4A7C15)
    x += b[apart : apart + n]
    x ^= x >> _U(29)
    return x


def _named(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tuples of keys (whole numbers from 0), and whether each in that order differs from the one before."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) <= 64:
        packed = keys[0].astype(_U)
        for k, b in zip(keys[1:], bits[1:], strict=True):
            packed = (packed << _U(b)) | k.astype(_U)
        order = np.argsort(packed)
        return order, _fresh(packed[order])
    order = np.lexsort(keys[::-1])
    return order, np.logical_or.reduce([_fresh(k[order]) for k in keys])


def _fresh(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def least_docs(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """text: segments of so many bytes (LENGTH at least) one after another, of documents docs -> for each of the strings of LENGTH bytes
    in them, in order, the least document that has it.

    The difference cover {1, 2} modulo 3, over characters of CHAR bytes: triples of characters are sorted and named at two of three places;
    triples of those names reach over 54 bytes, so that one recursion decides all strings there. Names of 44 and 38 bytes come from the
    same order. A string at the third place is its first one or two characters and the name of the rest, and is merged with the others
    in the two lists in which both have such a form. Every two places share one list, and in each neighbours are compared."""
    n, starts = len(text), np.cumsum(sizes) - sizes
    places = np.arange(n)
    padded = np.concatenate([text, np.zeros(12 * CHAR, np.uint8)]).astype(_U)
    char = np.zeros(n + 11 * CHAR, _U)
    for k in range(CHAR):
        char |= padded[k : k + len(char)] << _U(8 * (CHAR - 1 - k))
    distinct, c = np.unique(char, return_inverse=True)
    pair = (distinct >> _U(8 * (CHAR - 2))).astype(np.int64)  # the first two bytes of each character
    residue = places // CHAR % 3
    sampled = np.flatnonzero(residue)
    order, fresh = _named(c[sampled], c[sampled + CHAR], c[sampled + 2 * CHAR])
    name = np.zeros(n + 9 * CHAR, np.int64)
    name[sampled[order]] = np.cumsum(fresh)
    strings = sizes - LENGTH + 1
    w = _runs(starts, strings)
    sampled = _runs(starts, strings + 2 * CHAR)  # a string's start, or the rest of it behind one or two characters
    sampled = sampled[residue[sampled] > 0]
    order, _ = _named(name[sampled], name[sampled + 3 * CHAR], name[sampled + 6 * CHAR])
    at = sampled[order]
    head = _fresh(name[at]) | _fresh(name[at + 3 * CHAR])
    third, fourth, fifth = c[at + 6 * CHAR], c[at + 7 * CHAR], c[at + 8 * CHAR]
    rank = {}  # names of the first 50, 44 and 38 bytes
    for size, differs in (
        (50, _fresh(third) | _fresh(fourth) | _fresh(pair[fifth])),
        (44, _fresh(third) | _fresh(pair[fourth])),
        (38, _fresh(pair[third])),
    ):
        rank[size] = np.zeros(n + 3 * CHAR, np.int64)
        rank[size][at] = np.cumsum(head | differs)
    owner, best = np.repeat(docs, strings), np.full(len(w), _LAST)
    for left_out, keys in (
        (0, lambda w: (rank[50][w],)),
        (2, lambda w: (c[w], rank[44][w + CHAR])),
        (1, lambda w: (c[w], c[w + CHAR], rank[38][w + 2 * CHAR])),
    ):
        here = np.flatnonzero(residue[w] != left_out)
        if not len(here):
            continue
        order, fresh = _named(*keys(w[here]))
        here = here[order]
        first = np.flatnonzero(fresh)
        best[here] = np.minimum(best[here], np.minimum.reduceat(owner[here], first)[np.cumsum(fresh) - 1])
    return best


# chunks of documents


def _rows(docs: pa.Table) -> list[tuple[int, bool, bytes]]:
    """Documents of a chunk in the order of their ids (null: the largest), with whether the id is null."""
    return sorted((_LAST if i is None else i, i is None, t) for i, t in zip(docs.column("doc_id").to_pylist(), docs.column("t").to_pylist(), strict=True))


def _texts(rows: list[tuple[int, bool, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' bytes one after another, their sizes and ids."""
    return np.frombuffer(b"".join(t for *_, t in rows), np.uint8), np.array([len(t) for *_, t in rows], np.int64), np.array([i for i, *_ in rows], np.int64)


def _within(sizes: np.ndarray, n: int) -> np.ndarray:
    """Whether the string that begins at each byte ends in the same document."""
    inside = np.ones(max(0, n), bool)
    for k in range(1, LENGTH):
        cut = np.cumsum(sizes)[:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return inside


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes() or b"\0", codec="zstd", asbytes=True)


def _opened(b: bytes, kind, size: int) -> np.ndarray:
    raw = pa.decompress(b, max(1, size * np.dtype(kind).itemsize), codec="zstd", asbytes=True)
    return np.frombuffer(raw, kind, size)


def _by_range(keys: np.ndarray, n_ranges: int) -> Iterator[tuple[int, np.ndarray]]:
    """Ranges that occur and the places of their keys, in order."""
    r = (mix(keys, 0xA0761D6478BD642F) >> _U(11)).astype(np.int64) % n_ranges
    order = np.argsort(r, kind="stable")
    cuts = np.flatnonzero(_fresh(r[order]))
    for places in np.split(order, cuts[1:]) if len(order) else ():
        yield int(r[places[0]]), places


ASKED = "r long, chunk long, n int, keys binary, docs binary"


def _ask(n_ranges: int):
    """Chunks -> for each range its anchors and in how many documents each stands."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
        text, sizes, _ = _texts(_rows(docs))
        h = anchors(text)
        inside = _within(sizes, len(h))
        doc = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
        h, doc = h[inside], doc[inside]
        once = _fresh(h) | _fresh(doc)
        h, doc = h[once], doc[once]
        order = np.argsort(h, kind="stable")  # documents stay in order
        h, doc = h[order], doc[order]
        new = _fresh(h) | _fresh(doc)
        found, times = np.unique(h[new], return_counts=True)
        rows = [(r, key[0].as_py(), len(p), _packed(np.diff(found[p], prepend=_U(0))), _packed(times[p].astype(np.int32))) for r, p in _by_range(found, n_ranges)]
        return _table(rows, ASKED)

    return run


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], [name for name, _ in fields])


TOLD = "chunk long, n int, keys binary, docs binary"


def _tell(asked: pa.Table) -> pa.Table:
    """A range's anchors of all chunks -> to each chunk those of its anchors that stand in two documents or more, and in how many."""
    rows = asked.to_pylist()
    keys = [np.cumsum(_opened(r["keys"], _U, r["n"])) for r in rows]
    docs = [_opened(r["docs"], np.int32, r["n"]) for r in rows]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(docs))
    out, k = [], 0
    for r, own in zip(rows, keys, strict=True):
        times = total[at[k : k + len(own)]]
        k += len(own)
        some = times > 1
        if some.any():
            out.append((r["chunk"], int(some.sum()), _packed(own[some]), _packed(np.minimum(times[some], np.iinfo(np.int32).max).astype(np.int32))))
    return _table(out, TOLD)


class _Segments:
    """Segments of a chunk: runs of strings in one document with one repeated anchor. spans: (document, first string, strings) of each;
    which: number of its distinct segment. Distinct ones are keyed by anchor (a hot one's by its ends too) and have their least document.
    Documents must come in the order of their ids."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, repeated: np.ndarray, hot: np.ndarray):
        h = anchors(text)
        n = len(h)
        run = np.flatnonzero(_fresh(h))  # one anchor is looked up once
        long = np.diff(np.append(run, n))
        some = np.repeat(_among(h[run], repeated), long) & _within(sizes, n)
        doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
        w = np.flatnonzero(some)
        cut = np.concatenate([np.ones(min(1, len(w)), bool), (np.diff(w) > 1) | (h[w[1:]] != h[w[:-1]]) | (doc[w[1:]] != doc[w[:-1]])])
        alone = np.repeat(_among(h[run], hot), long) if len(hot) else None
        if alone is not None:
            cut |= alone[w]
        first = np.flatnonzero(cut)
        self.start, self.count = w[first], np.diff(np.append(first, len(w)))
        self.doc = ids[doc[self.start]] if len(w) else np.array([], np.int64)
        raw, known = text.tobytes(), {}
        ends = self.start + self.count + LENGTH - 1
        # equal bytes have equal anchors, and the first of them the least document
        which = [known.setdefault(raw[a:b], len(known)) for a, b in zip(self.start.tolist(), ends.tolist(), strict=True)]
        self.which, self.texts = np.array(which, np.int64), list(known)
        first = np.unique(self.which, return_index=True)[1]
        self.docs, self.keys = self.doc[first], h[self.start[first]]
        if alone is not None:
            lone = np.flatnonzero(alone[self.start[first]])
            s = self.start[first][lone]
            for k in (*range(8), *range(LENGTH - 8, LENGTH)):
                self.keys[lone] = mix(self.keys[lone] + text[s + k].astype(_U), 0xC2B2AE3D27D4EB4F)


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


DEALT = "r long, chunk long, n int, n_bytes long, keys binary, sizes binary, docs binary, texts binary"


def _repeated(told: pa.Table, hot_docs: int) -> tuple[np.ndarray, np.ndarray]:
    rows = told.to_pylist()
    keys = np.concatenate([np.array([], _U), *[_opened(r["keys"], _U, r["n"]) for r in rows]])
    docs = np.concatenate([np.array([], np.int32), *[_opened(r["docs"], np.int32, r["n"]) for r in rows]])
    return np.sort(keys), np.sort(keys[docs > hot_docs])


def _deal(n_ranges: int, hot_docs: int):
    """A chunk and its repeated anchors -> for each range the distinct segments."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _table([], DEALT)
        s = _Segments(*_texts(_rows(docs)), *_repeated(told, hot_docs))
        rows = []
        for r, p in _by_range(s.keys, n_ranges):
            parts = [s.texts[k] for k in p.tolist()]
            whole = b"".join(parts)
            rows.append((r, key[0].as_py(), len(p), len(whole), _packed(s.keys[p]), _packed(np.array([len(x) for x in parts], np.int32)), _packed(s.docs[p]), pa.compress(whole, codec="zstd", asbytes=True)))
        return _table(rows, DEALT)

    return run


FOUND = "chunk long, r long, n int, found binary"


def _find(dealt: pa.Table) -> pa.Table:
    """A range's segments of all chunks -> to each chunk the least document of each string in its segments, in its order.

    Equal segments of all chunks count once, with their least document. A segment that then has its anchor to itself shares no string with
    others, so only segments of an anchor with two or more are sorted."""
    rows = dealt.to_pylist()
    sizes = [_opened(r["sizes"], np.int32, r["n"]).astype(np.int64) for r in rows]
    known, which = {}, []
    for r, size in zip(rows, sizes, strict=True):
        raw, ends = _opened(r["texts"], np.uint8, r["n_bytes"]).tobytes(), np.cumsum(size)
        which.append(np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)], np.int64))
    every = np.concatenate(which)
    docs = np.full(len(known), _LAST)
    np.minimum.at(docs, every, np.concatenate([_opened(r["docs"], np.int64, r["n"]) for r in rows]))
    first = np.unique(every, return_index=True)[1]
    keys, lengths = np.concatenate([_opened(r["keys"], _U, r["n"]) for r in rows])[first], np.concatenate(sizes)[first]
    text = np.frombuffer(b"".join(known), np.uint8)
    del known
    starts, strings = np.cumsum(lengths) - lengths, lengths - LENGTH + 1
    answer, best = np.cumsum(strings) - strings, np.repeat(docs, strings)
    order = np.argsort(keys, kind="stable")
    fresh = _fresh(keys[order])
    order = order[~(fresh & np.append(fresh[1:], True))]
    fresh, filled, at = _fresh(keys[order]), np.cumsum(lengths[order]), 0
    cuts = np.append(np.flatnonzero(fresh), len(order))
    while at < len(order):  # whole anchors, of about SLAB bytes
        reach = np.searchsorted(filled, filled[at] + SLAB, "right")
        end = int(max(cuts[np.searchsorted(cuts, reach, "right") - 1], cuts[np.searchsorted(cuts, at, "right")]))
        some = order[at:end]
        best[_runs(answer[some], strings[some])] = least_docs(text[_runs(starts[some], lengths[some])], lengths[some], docs[some])
        at = end
    out = []
    for r, w in zip(rows, which, strict=True):
        found = best[_runs(answer[w], strings[w])]
        out.append((r["chunk"], r["r"], len(found), _packed(found)))
    return _table(out, FOUND)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(n_ranges: int, hot_docs: int):
    """A chunk, its repeated anchors and what was found -> one row for each document."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], REMOVED)
        given = _rows(docs)
        text, sizes, ids = _texts(given)
        gone = np.zeros(len(text), bool)
        told = answers.filter(pc.is_valid(answers.column("keys")))
        if told.num_rows:
            s = _Segments(text, sizes, ids, *_repeated(told, hot_docs))
            found = {r["r"]: _opened(r["found"], np.int64, r["n"]) for r in answers.filter(pc.is_valid(answers.column("found"))).to_pylist()}
            strings = np.array([len(t) - LENGTH + 1 for t in s.texts], np.int64)
            at, parts, filled = np.empty(len(strings), np.int64), [], 0
            for r, p in _by_range(s.keys, n_ranges):
                at[p] = filled + np.cumsum(strings[p]) - strings[p]
                parts.append(found[r])
                filled += len(found[r])
            best = np.concatenate(parts) if parts else np.array([], np.int64)
            earlier = best[_runs(at[s.which], s.count)] < np.repeat(s.doc, s.count)
            w = _runs(s.start, s.count)[earlier]
            cover = np.zeros(len(text) + 1, np.int32)
            cover[w] += 1  # a string begins at each place once
            cover[w + LENGTH] -= 1
            gone = np.cumsum(cover)[:-1] > 0
        ends, rows = np.cumsum(sizes), []
        for b, (i, null, t) in zip(ends.tolist(), given, strict=True):
            n = len(t)
            mask = gone[b - n : b]
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            rows.append((None if null else i, n, int(mask.sum()), spans, hashlib.sha256(text[b - n : b][~mask].tobytes()).hexdigest()))
        return _table(rows, REMOVED)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, hot_docs: int = HOT_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, of the text without each byte covered by a string of
    LENGTH bytes that also starts in a document with a smaller id. All strings of all texts are judged.

    Documents are dealt in chunks by their id. Chunks state their anchors and learn which of them stand in other documents too (a filter
    without loss: every repeated string has a repeated anchor). Then the distinct segments around these are dealt by anchor, suffixes
    are sorted (least_docs), and each chunk learns the least document of its strings. An anchor of over hot_docs documents has its
    strings dealt by their ends as well. Equal segments of a chunk are sent once, so a passage in every document costs a row a chunk.

    Null and empty texts, and those under LENGTH bytes, keep all they have. A null id is larger than any other but 2^63 - 1, beside which it stands;
    rows of one id do not remove each other's strings. Repeated rows give a row each; other columns are ignored; an empty table gives
    no rows. Texts are dealt whole, so a chunk has the largest document's size at least."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("t")), F.lit(n)).cast("long")).repartition(max(partitions(spark), min(n, 4 * partitions(spark))), "chunk")
    told = dealt.groupBy("chunk").applyInArrow(_ask(n), ASKED).groupBy("r").applyInArrow(_tell, TOLD)
    found = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_deal(n, hot_docs), DEALT).groupBy("r").applyInArrow(_find, FOUND)
    answers = told.select("chunk", F.lit(None).cast("long").alias("r"), "n", "keys", "docs", F.lit(None).cast("binary").alias("found"))
    answers = answers.unionByName(found.select("chunk", "r", "n", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("docs"), "found"))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(n, hot_docs), REMOVED)


def op12(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
