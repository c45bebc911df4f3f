"""Removal of repeated 50-byte strings by blockwise suffix sorting with a difference cover.

Only the first WIDTH bytes of a suffix count, so suffixes are told apart by a sample of positions whose ranks are computed
first. A cover by residues would sample about a third of all positions of a corpus. This one is chosen by content: of the
GRAM-byte strings in each WIDTH bytes, the one with the least hash. It samples about one position in sixteen and has the
property that a difference cover is used for: two equal suffixes reach a sampled position after the same number of bytes.

1. ``_sample``: each document's cover positions, by bucket of the string there; a bucket keeps those that at least two
   documents share. Other suffixes are unique.
2. ``_pieces``: the bytes around each position that is left, dealt into buckets again.
   What a batch can settle by itself is dealt evenly and doesn't meet in a bucket: a string that two documents of the batch
   share, and all but the least document of equal pieces. So a frequent passage sends a row or two from each batch.
3. ``_bucket``: one bucket at a time is sorted. The ranks of what follows the cover positions and of what precedes them, with
   the lengths of common prefixes, resolve every tie: two suffixes that start o bytes before their cover positions are equal
   if the ranks agree to o bytes back and to WIDTH - o bytes ahead. Of equal suffixes, the smallest doc_id is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.shipping import ship

WIDTH, GRAM = 50, 20
OFFSETS = WIDTH - GRAM + 1
PIECE = OFFSETS - 1 + WIDTH
#: Bytes of text whose cover positions share a bucket in step 1; step 2 has FINER times as many buckets.
BUCKET_BYTES, LEAST_BUCKETS, FINER = 32 << 20, 12, 2
#: Bytes that are hashed at a time; a longer text is cut into overlapping parts.
BUFFER = 2 << 20
#: Bytes of pieces that are dealt out at a time, and how hard zstd presses them.
PIECES, LEVEL = 48 << 20, 6
#: A null doc_id counts as larger than any other.
NULL_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _B
    return h ^ h >> np.uint64(29)


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each position but the last few."""
    h, power, size, parts = raw.astype(np.uint64) + np.uint64(1), _A, 1, []
    while size <= GRAM:
        if GRAM & size:
            parts.append((size, h, power))
        h, power, size = h[:-size] * power + h[size:], np.uint64(int(power) ** 2 % (1 << 64)), 2 * size
    n, at, out = len(raw) - GRAM + 1, 0, np.zeros(len(raw) - GRAM + 1, np.uint64)
    for size, h, power in parts:
        out = out * power + h[at : at + n]
        at += size
    return _mixed(out)


def cover(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each cover position, the first and last suffix start that reach it, and its hash."""
    none = np.zeros(0, np.int64)
    if len(raw) < WIDTH:
        return none, none, none, none.astype(np.uint64)
    hashes = _grams(raw)
    low = np.uint64((1 << 24) - 1)
    key = hashes & ~low | np.arange(len(hashes), dtype=np.uint64)
    for step in (1, 2, 4, 8, OFFSETS - 16):  # least of 2, 4, 8, 16 and then OFFSETS keys in a row; the first of equal ones
        key = np.minimum(key[:-step], key[step:])
    starts = np.arange(len(raw) - WIDTH + 1)
    inside = starts + WIDTH <= ends[np.searchsorted(ends, starts, side="right")]
    starts, at = starts[inside], (key[inside] & low).astype(np.int64)
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return at[new], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], hashes[at[new]]


def _buffers(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, documents) of texts laid end to end; documents holds (doc_id, key, start of the part in its text)."""
    parts, heads, size = [], [], 0
    for doc, key, text in rows:
        for at in range(0, max(1, len(text) - WIDTH + 1), BUFFER):
            part = text[at : at + BUFFER + WIDTH - 1]
            if size and size + len(part) > 2 * BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(heads, np.int64)
                parts, heads, size = [], [], 0
            parts.append(part)
            heads.append((doc, key, at))
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), np.array(heads, np.int64)


def _rows(batch: pa.RecordBatch) -> list[tuple[int, int, bytes]]:
    ids, keys, texts = (batch.column(k).to_pylist() for k in range(3))
    return [(NULL_ID if d is None else d, k, t or b"") for d, k, t in zip(ids, keys, texts, strict=True)]


def _packed(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A cover position with how far before it its first and last suffixes start, in one number."""
    return at << 10 | (at - first) << 5 | (at - last)


def _sample(buckets: int):
    """Rows (bucket, data) of cover positions. Where two documents of a buffer share a string, its positions are settled, and
    two witnesses, without a position, go to its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ends, heads in _buffers(_rows(batch)):
                at, first, last, h = cover(raw, ends)
                if not len(at):
                    continue
                which = np.searchsorted(ends, at, side="right")
                base = np.r_[0, ends][which]
                packed = _packed(at - base + heads[which, 2], first - base + heads[which, 2], last - base + heads[which, 2])
                docs = heads[which, :2]
                order = np.lexsort((docs[:, 0], h))
                starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
                sizes = np.diff(np.r_[starts, len(h)])
                least, most = order[starts], order[starts + sizes - 1]
                several = docs[least, 0] < docs[most, 0]
                settled = np.sort(order[np.repeat(several, sizes)])  # in order of places, which compresses well
                witnesses = np.r_[least[several], most[several]]
                alone = np.r_[np.sort(order[np.repeat(~several, sizes)]), witnesses]
                where = packed[alone]
                where[len(alone) - len(witnesses) :] = -1
                bucket = (h[alone] % np.uint64(buckets)).astype(np.int64)
                short = (h[alone] // np.uint64(buckets)).astype(np.uint32)
                blobs = [(k, 0, _put(docs[alone[i]], where[i], short[i])) for k, i in _parts(bucket)]
                if len(settled):
                    blobs += [(k, 1, _put(docs[settled[i]], packed[settled[i]])) for k, i in _parts(_spread(docs[settled], buckets))]
                yield _dealt(blobs)

    return run


def _spread(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets for settled rows: by groups of documents, so that their data stay together."""
    return (_mixed((docs[:, 0] >> 6).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and where."""
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(bucket) else np.zeros(0, np.int64)
    return zip(bucket[order[starts]].tolist(), np.split(order, starts[1:]), strict=True) if len(bucket) else iter(())


def _dealt(rows) -> pa.RecordBatch:
    """Rows (bucket, data) of (bucket, whether data is settled, data); data is compressed."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    rows = [(k, press.compress(bytes([settled]) + data)) for k, settled, data in rows]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["bucket", "data"])


def _put(docs: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of rows as bytes, with each document (doc_id, key) of theirs once."""
    new = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]).any(1)])
    if len(new) > len(docs) // 2:
        used, index = np.unique(docs, axis=0, return_inverse=True)
    else:
        used, index = docs[new], np.cumsum(np.bincount(new, minlength=len(docs))) - 1
    # Of 8-byte numbers, bytes of the same weight stand together, which compresses well.
    apart = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if x.dtype == np.int64 else x
    parts = (np.array([len(used), len(docs)], np.int64), np.ascontiguousarray(used), apart(index.astype(np.int64)), *(apart(np.ascontiguousarray(c)) for c in columns))
    return b"".join(x.tobytes() for x in parts)


def _got(data: bytes | memoryview, *kinds: tuple[type, int]) -> list[np.ndarray]:
    """doc_id, key and the columns that _put() was given; kinds has the type and the width in items of each."""
    n_docs, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
    docs = np.frombuffer(data, np.int64, 2 * n_docs, 16).reshape(-1, 2)
    at, out = 16 + 16 * n_docs, []
    for kind, width in ((np.int64, 1), *kinds):
        size = n * width * np.dtype(kind).itemsize
        if kind is np.int64:
            out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(8, n).T).view(np.int64).ravel())
        else:
            column = np.frombuffer(data, kind, n * width, at)
            out.append(column.reshape(n, width) if width > 1 else column)
        at += size
    return [docs[out[0], 0], docs[out[0], 1], *out[1:]]


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, memoryview]]]:
    """Of one bucket after another, from rows (bucket, data) that are sorted by bucket: whether data is settled, and data."""
    press = zstandard.ZstdDecompressor()
    rows = ((b, d) for batch in batches for b, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
    for _, own in groupby(rows, key=lambda x: x[0]):
        yield ((raw[0], memoryview(raw)[1:]) for raw in (press.decompress(d.as_buffer()) for _, d in own))


#: What a document's data lists of its hits: cover positions and which suffixes, see _bucket.
HIT = np.dtype([("at", "<i8"), ("mask", "<u4")])


def _hits(at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), HIT)
    out["at"], out["mask"] = at, mask
    return out


def _by_document(doc: np.ndarray, key: np.ndarray, column: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, data): the column's items of each document, as bytes."""
    order = np.lexsort((key, doc))
    doc, key, raw, width = doc[order], key[order], column[order].tobytes(), column.itemsize
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(doc)]
    for at in range(0, len(starts), 20_000):
        s, e = starts[at : at + 20_000], ends[at : at + 20_000]
        data = [raw[i:j] for i, j in zip((s * width).tolist(), (e * width).tolist(), strict=True)]
        ids = pa.array(doc[s], mask=doc[s] == NULL_ID)
        yield pa.RecordBatch.from_arrays([ids, pa.array(key[s]), pa.array(data, pa.binary())], ["doc_id", "key", "data"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cover positions whose string at least two doc_ids share."""
    for rows in _in_buckets(batches):
        data = []
        for settled, d in rows:
            if settled:
                yield from _by_document(*_got(d, (np.int64, 1)))
            else:
                data.append(_got(d, (np.int64, 1), (np.uint32, 1)))
        if not data:
            continue
        doc, key, packed, h = (np.concatenate(x) for x in zip(*data, strict=True))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        sorted_docs = doc[order]
        several = np.minimum.reduceat(sorted_docs, starts) < np.maximum.reduceat(sorted_docs, starts)
        left = order[np.repeat(several, sizes)]
        left = left[packed[left] >= 0]
        yield from _by_document(doc[left], key[left], packed[left])


def _pieces(buckets: int):
    """From documents with their packed cover positions: rows (bucket, data) with the bytes around each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = np.arange(-(OFFSETS - 1), WIDTH)
        weights = np.cumprod(np.r_[np.uint64(1), np.full(GRAM - 1, _A)].astype(np.uint64))
        for batch in batches:
            made: list[tuple[np.ndarray, ...]] = []
            size = 0

            def flush():
                around, doc, key, packed = (np.concatenate(x) for x in zip(*made, strict=True))
                h = _mixed(((around[:, OFFSETS - 1 : OFFSETS - 1 + GRAM].astype(np.uint64) + np.uint64(1)) * weights).sum(1, dtype=np.uint64))
                whole, content = _contents(around, packed)
                docs = np.c_[doc, key]
                least = np.full(len(whole), NULL_ID)
                np.minimum.at(least, content, doc)
                settled = np.flatnonzero(least[content] < doc)
                left = np.flatnonzero(least[content] == doc)
                bucket = (h[left] % np.uint64(buckets)).astype(np.int64)
                own = [(k, 0, _gathered(docs[left[i]], packed[left[i]], content[left[i]], whole)) for k, i in _parts(bucket)]
                far, near = packed[settled] >> 5 & 31, packed[settled] & 31
                mask = ((2 << far) - (1 << near)).astype(np.uint32)
                own += [(k, 1, _put(docs[settled[i]], packed[settled[i]] >> 10, mask[i])) for k, i in _parts(_spread(docs[settled], buckets))]
                return _dealt(own)

            for (doc, key, text), lists in zip(_rows(batch), batch.column(3), strict=True):
                packed = np.frombuffer(b"".join(lists.as_py()), np.int64)
                raw = np.frombuffer(bytes(OFFSETS) + text + bytes(WIDTH), np.uint8)
                for i in range(0, len(packed), 100_000):
                    p = packed[i : i + 100_000]
                    around = raw[(p >> 10)[:, None] + (reach + OFFSETS)[None, :]]
                    # Bytes that no suffix of this position has are left out.
                    around = np.where((reach[None, :] >= -(p >> 5 & 31)[:, None]) & (reach[None, :] < (WIDTH - (p & 31))[:, None]), around, 0).astype(np.uint8)
                    made.append((around, np.full(len(p), doc), np.full(len(p), key), p))
                    size += around.size
                    if size > PIECES:
                        yield flush()
                        made.clear()
                        size = 0
            if made:
                yield flush()

    return run


def _contents(around: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pieces, with how far before them suffixes start, and which of them each row has."""
    whole = np.zeros((len(around), -(-(PIECE + 2) // 8) * 8), np.uint8)
    whole[:, :PIECE], whole[:, PIECE], whole[:, PIECE + 1] = around, packed >> 5 & 31, packed & 31
    h = np.zeros(len(around), np.uint64)
    for word in whole.view(np.uint64).T:
        h = _mixed(h * _A + word)
    _, first, content = np.unique(h, return_index=True, return_inverse=True)
    if (whole[first[content]] != whole).any():  # different pieces of one hash: each row keeps its own
        return whole[:, : PIECE + 2], np.arange(len(around))
    return whole[first, : PIECE + 2], content


def _gathered(docs: np.ndarray, packed: np.ndarray, content: np.ndarray, whole: np.ndarray) -> bytes:
    """Rows and each of their pieces once."""
    used, content = np.unique(content, return_inverse=True)
    rows = _put(docs, packed, content.astype(np.uint32))
    return len(rows).to_bytes(8, "little") + rows + whole[used].tobytes()


def _opened(data: list[memoryview]) -> tuple[np.ndarray, ...]:
    """doc_id, key, cover position and piece of each row, and the pieces with how far before them suffixes start."""
    columns, pieces, n = [], [], 0
    for d in data:
        size = int.from_bytes(bytes(d[:8]), "little")
        doc, key, packed, content = _got(d[8 : 8 + size], (np.int64, 1), (np.uint32, 1))
        columns.append((doc, key, packed >> 10, content.astype(np.int64) + n))
        pieces.append(np.frombuffer(d, np.uint8, offset=8 + size).reshape(-1, PIECE + 2))
        n += len(pieces[-1])
    return (*(np.concatenate(x) for x in zip(*columns, strict=True)), np.concatenate(pieces))


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row of bytes, and how many bytes the row of a rank shares with the one before."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    order = np.lexsort(words.view(">u8").astype(np.uint64).T[::-1])
    common = np.zeros(n, np.int64)
    for at in range(1, n, 100_000):
        a, b = rows[order[at - 1 : at + 99_999 if at + 99_999 < n else n - 1]], rows[order[at : at + 100_000]]
        differ = np.c_[a != b, np.ones(len(a), bool)]
        common[at : at + len(a)] = differ.argmax(1)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, common


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, cover positions and which of the suffixes that reach them occur under a smaller doc_id: bit o is that
    of the suffix o bytes before."""
    for rows in _in_buckets(batches):
        data = []
        for settled, d in rows:
            if settled:
                doc, key, at, mask = _got(d, (np.int64, 1), (np.uint32, 1))
                yield from _by_document(doc, key, _hits(at, mask))
            else:
                data.append(d)
        if not data:
            continue
        doc, key, at, content, pieces = _opened(data)
        del data
        order = np.argsort(content, kind="stable")
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.r_[True, np.diff(content[order]) > 0]))
        ahead, shared_ahead = _sorted(pieces[:, OFFSETS - 1 : PIECE])
        back, shared_back = _sorted(pieces[:, : OFFSETS - 1][:, ::-1])
        far, near = pieces[:, PIECE], pieces[:, PIECE + 1]
        mask = np.zeros(len(doc), np.uint32)
        for o in range(OFFSETS):
            own = np.flatnonzero((near <= o) & (o <= far))
            if not len(own):
                continue
            group = np.cumsum(shared_ahead < WIDTH - o)[ahead[own]] * len(pieces) + np.cumsum(shared_back < o)[back[own]]
            order = np.argsort(group)
            starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
            found = np.full(len(pieces), NULL_ID)
            found[own[order]] = np.repeat(np.minimum.reduceat(least[own[order]], starts), np.diff(np.r_[starts, len(own)]))
            mask |= (found[content] < doc).astype(np.uint32) << np.uint32(o)
        hit = mask > 0
        yield from _by_document(doc[hit], key[hit], _hits(at[hit], mask[hit]))


def removed(texts: list[bytes], data: list[list[bytes] | None]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Each text with the maximal runs (start, end) of its bytes that the suffixes of _bucket cover."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]) + 1, at + 1
        while end < len(texts) and size + len(texts[end]) < BUFFER:
            size, end = size + len(texts[end]) + 1, end + 1
        lists = [b"".join(d or ()) for d in data[at:end]]
        bases = np.cumsum([0, *(len(t) + 1 for t in texts[at:end])])
        hits = np.frombuffer(b"".join(lists), HIT)
        place, mask = hits["at"] + np.repeat(bases[:-1], [len(x) // HIT.itemsize for x in lists]), hits["mask"]
        starts = np.zeros(bases[-1], bool)
        for o in range(OFFSETS):
            starts[place[mask >> np.uint32(o) & np.uint32(1) > 0] - o] = True
        s = np.flatnonzero(starts)
        # Texts are a byte apart, so no run goes on in the next one.
        new = np.flatnonzero(np.r_[True, np.diff(s) > WIDTH]) if len(s) else np.zeros(0, np.int64)
        begins, ends = s[new], (s[np.r_[new[1:], len(s)] - 1] if len(s) else s) + WIDTH
        owner = np.searchsorted(begins, bases)
        for k in range(end - at):
            i, j, base = owner[k], owner[k + 1], int(bases[k])
            yield texts[at + k], [(a - base, b - base) for a, b in zip(begins[i:j].tolist(), ends[i:j].tolist(), strict=True)]
        at = end


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]) if runs else text


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are one; a null text is empty. No key is null, as Spark can see, so that both joins
    of marked() can read one shuffle of the documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).alias("key"), text.cast("binary").alias("text"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text, data) of each row of docs (doc_id, text): data lists what removed() takes.

    Repeated rows are marked alike; a null doc_id counts as larger than any other, and rows that share an id never remove
    bytes from each other.
    """
    ship(docs.sparkSession)
    keyed = _keyed(docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    schema = "bucket long, data binary"
    by_doc = "doc_id long, key long, data binary"
    deal = lambda df, n: df.repartition(n, "bucket").sortWithinPartitions("bucket")
    shared = deal(keyed.mapInArrow(_sample(buckets), schema), buckets).mapInArrow(_shared, by_doc)
    at = shared.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("data").alias("data"))
    same = lambda d: F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    pieces = keyed.join(at, same(at)).select("doc_id", "key", "text", "data").mapInArrow(_pieces(FINER * buckets), schema)
    hits = deal(pieces, FINER * buckets).mapInArrow(_bucket, by_doc)
    of_doc = hits.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_list("data").alias("data"))
    return keyed.join(of_doc, same(of_doc), "left").select("doc_id", "key", "text", "data")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    return removed(batch.column(2).to_pylist(), batch.column(3).to_pylist())


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs; null and empty texts have no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()) for text, runs in _each(batch)]
            n, gone, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_text(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): the bytes that stay, which need not be whole characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_kept(*x) for x in _each(batch)], pa.binary())], ["doc_id", "kept"])

    return marked(docs).mapInArrow(run, "doc_id long, kept binary")
