"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes, so they share at
least five positional bytes: five is the guaranteed minimum of the count filter. Posting lists of single bytes hold a 256th
of all fingerprints each and would meet quadratically often, so the index intersects them five positions at a time: a pair
sharing t bytes meets in C(t, 5) of the 56 lists, at least one, and a pair below the minimum never meets. Each list holds
distinct fingerprints equal in 40 bits: at most 2**24. Inside a list the tally of shared bytes is taken, pairs that reach the
minimum are verified by their differing bits, and a spanning forest of the verified links goes on, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import columns_of, cut, fresh
from splitfold.llm.graph import components
from splitfold.shipping import ship

MAX_BITS, SHINGLE, SEED = 3, 3, 42
MIN_BYTES = 8 - MAX_BITS
LISTS = list(combinations(range(8), MIN_BYTES))
#: Shingles hashed at a time, and the list size from which neighbours are enumerated instead of compared.
CHUNK, ENUMERATE = 1 << 15, 1 << 12
#: Members of a large list whose neighbours are looked up at a time.
LOOKED_UP = 256
#: A fingerprint with more than one in so many rows is joined by broadcast; there can be no more of them than this.
HOT_SHARE = 200


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint as an unsigned number; 0 for a text without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def text_hash(text_col: str = "text") -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp) of each row, repeated rows included; fp holds the 64 bits as a signed long. If hashed, also text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", "text_hash"][: 2 + hashed])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *([text_hash(text_col).alias("text_hash")] if hashed else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", text_hash binary" if hashed else ""))


def postings(distinct: DataFrame) -> DataFrame:
    """(list, fp): each fingerprint once in each of the 56 lists; list holds the number of the positions and their bytes."""

    ship(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            octets = fps.view(np.uint8).reshape(-1, 8).astype(np.int64)
            for k, places in enumerate(LISTS):
                key = np.full(len(fps), k, np.int64)
                for p in places:
                    key = key << 8 | octets[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps)], ["list", "fp"])

    return distinct.select("fp").mapInArrow(run, "list long, fp long")


def _tally(x: np.ndarray) -> np.ndarray:
    """Positional bytes that are shared, from the differing bits."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)


def _linked(one: np.uint64, others: np.ndarray) -> np.ndarray:
    x = others ^ one
    near = _tally(x) >= MIN_BYTES
    near[near] = np.bitwise_count(x[near]) <= MAX_BITS
    return near


def _forest(fps: np.ndarray, places: tuple[int, ...]) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Edges of a spanning forest of one list. Compares members up to ENUMERATE of them; beyond that looks up the 2,325
    neighbours of each member among the 24 bits in which members of the list may differ, so the work stays linear."""
    if len(fps) <= ENUMERATE:
        rest, queue = fps, []
        while len(rest) or queue:
            if not queue:
                queue, rest = [rest[0]], rest[1:]
            one = queue.pop()
            if not len(rest):
                return
            near = _linked(one, rest)
            for other in rest[near]:
                yield one, other
            queue.extend(rest[near])
            rest = rest[~near]
        return
    bits = np.array([np.uint64(1) << np.uint64(8 * p + b) for p in range(8) if p not in places for b in range(8)])
    masks = np.array([np.bitwise_or.reduce(bits[list(c)]) for n in range(1, MAX_BITS + 1) for c in combinations(range(len(bits)), n)])
    order, root = np.sort(fps), list(range(len(fps)))
    for start in range(0, len(order), LOOKED_UP):
        wanted = order[start : start + LOOKED_UP, None] ^ masks
        found = np.minimum(np.searchsorted(order, wanted), len(order) - 1)
        one, which = np.nonzero(order[found] == wanted)
        other = found[one, which]
        later = other > one + start
        for i, j in zip((one[later] + start).tolist(), other[later].tolist(), strict=True):
            a, b = _root(root, i), _root(root, j)
            if a != b:
                root[b] = a
                yield order[i], order[j]


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by list; keeps no more than a batch and the list that goes on in the next, put together once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def made(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        x = fps[two] ^ fps[two + 1] if len(two) else np.zeros(0, np.uint64)
        two = two[(_tally(x) >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS)] if len(two) else two
        a, b = [fps[two]], [fps[two + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if pairs := list(_forest(fps[at : at + n], LISTS[int(keys[at] >> 8 * MIN_BYTES)])):
                one, other = zip(*pairs, strict=True)
                a.append(np.array(one, np.uint64))
                b.append(np.array(other, np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], schema=schema)

    parts: list[tuple[np.ndarray, np.ndarray]] = []  # of one list that may go on
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        end = int(np.searchsorted(keys, keys[-1]))
        if parts and keys[0] == keys[-1] == parts[0][0][0]:
            parts.append((keys, fps))
            continue
        whole = [*parts, (keys[:end], fps[:end])]
        yield made(np.concatenate([k for k, _ in whole]), np.concatenate([f for _, f in whole]))
        parts = [(keys[end:], fps[end:])]
    if parts:
        yield made(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp): each links two that differ in at most three bits, and together
    they connect all that such links connect."""
    return postings(distinct).repartition("list").sortWithinPartitions("list").mapInArrow(_edges, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the smallest doc_id that links reach.

    Null and empty texts have fingerprint 0 and are linked like any other; rows with a null doc_id take part, but a
    component of such rows alone has a null component_id; repeated rows are returned as often as they occur. Other columns
    are ignored; an empty table gives no rows.
    """
    return _with_components(cut(fingerprints(docs, id_col, text_col))).select("doc_id", "fp", "component_id")


def _with_components(rows: DataFrame) -> DataFrame:
    """rows of fingerprints() with root, one fingerprint that stands for the component, and component_id."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = cut(components(cut(links(distinct))))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    component = cut(classes.join(ids, "root").select("fp", "n", "root", "component_id"))
    # A fingerprint that many rows share is joined where its rows are; at most HOT_SHARE can have so many.
    hot = F.col("n") > (distinct.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    many = F.broadcast(component.where(hot).drop("n"))
    rest = rows.join(F.broadcast(component.where(hot).select("fp")), "fp", "left_anti").join(component.where(~hot).drop("n"), "fp")
    return rows.join(many, "fp").unionByName(rest)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate component: the one with its smallest id, then hash of the text; null ids come last.

    Rows with the same id and text are in the same component, so id and hash name the row; of repeated such rows any one stays.
    Null and empty texts are one component with other texts of fingerprint 0. All columns stay, whatever their names.
    """
    found = _with_components(cut(fingerprints(docs, id_col, text_col, hashed=True)))
    of_key = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col("text_hash"), F.col("n"))).alias("x")
    own, known, n = fresh("id"), fresh("hash"), fresh("n")
    keep = of_key.groupBy("root").agg(least).select(F.col("x.doc_id").alias(own), F.col("x.text_hash").alias(known), F.col("x.n").alias(n))
    kept = docs.join(keep, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (text_hash(text_col) == F.col(known)))
    once, repeated = kept.where(F.col(n) == 1), kept.where(F.col(n) > 1).dropDuplicates([own, known])
    return once.unionAll(repeated).select(*columns_of(docs))


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
