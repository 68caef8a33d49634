"""Substring dedup with fixed-block anchors.

A repeat of `window` words holds at least one whole block of `(window + 1) // 2`
words that starts at a multiple of the block length in the document it is taken
from. So only those non-overlapping blocks are indexed, and every rolling window
of a block's length probes them:

1. Anchors. Index entries and probes of a chunk of text are packed, by hash
   bucket, into a few bytes each: a 32-bit tag (a bucket holds a bounded number
   of entries) and the gap to the previous place. A bucket reports the places
   whose tag also stands in another chunk, with an indexed block among them.
   Inside a chunk this is known at once, so a chunk sends each hash once, however
   often it occurs: a passage that a third of all documents share sends one entry
   per chunk.
2. Extension. Only documents with anchors are read again. The windows around
   their anchors are compared by their 64-bit hash; each piece sends its smallest
   document per hash, and a window whose hash belongs to a smaller document is a
   repeat. Runs of repeated windows are the maximal exact repeats.
3. Every word that a repeated window covers is removed.

Words are separated by white space. Ids are integers. Defined results: null and
empty texts have no words; a row without an id takes no part and loses nothing;
rows that repeat an id are one document, so they are no repeats of each other;
documents are judged on the input; an empty table gives an empty table. Only the
id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.llm.words import WHITE, Words, mix, pieces, utf8, words_of

WINDOW = 13
# Bytes of text whose entries share a bucket, so that a bucket fits a task at any size.
BUCKET_BYTES = 16_000_000
CHUNK_BYTES = 8_000_000


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, all first bytes before all second ones: zeros then pack well."""
    values = np.ascontiguousarray(values, np.uint64)
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(packed: bytes, width: int) -> np.ndarray:
    n = len(packed) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def pack_places(places: np.ndarray) -> bytes:
    """Rising numbers as gaps."""
    return planes(np.diff(places, prepend=0).astype(np.uint64), 4)


def unpack_places(packed: bytes) -> np.ndarray:
    return np.cumsum(unplanes(packed, 4)).astype(np.int64)


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (first key first), and the starts of equal runs."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    fresh = np.zeros(len(order), bool)
    fresh[0] = True
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(fresh)


def _chunk_name(ids: np.ndarray, rows: np.ndarray, borders: np.ndarray) -> int:
    raw = b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (ids, rows, borders))
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, ids, rows, bytes, borders) of each chunk; the name tells the documents and where they begin."""
    for batch in pieces(batches, "_text", limit):
        data, borders = utf8(batch.column("_text"))
        ids, rows = batch.column("_id").to_numpy(), batch.column("_row").to_numpy()
        yield _chunk_name(ids, rows, borders), ids, rows, data, borders


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of each bucket in their present order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def _same_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """One batch per value of the sorted key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        value = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and value[a] != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = value[a]
    if held:
        yield pa.concat_batches(held)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text")
    )


def anchors(rows: DataFrame, block: int, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """(chunk, places): the bytes at which windows begin whose words stand in another document too."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, _, data, borders in _chunks(batches, chunk_bytes):
            words = words_of(data, borders, WHITE)
            at, got = words.rolling(block)
            # a text stands once for each hash, with its first place
            order, starts = _groups(got, words.doc[at])
            indexed = ((at - words.first[words.doc[at]]) % block == 0)[order]
            if not len(order):
                continue
            flag = np.logical_or.reduceat(indexed, starts)
            value = got[order[starts]]
            fresh = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            many = np.diff(np.append(fresh, len(value))) > 1  # in more than one text of this chunk
            of_hash = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(value))))
            # every occurrence of those is an anchor already
            local = order[np.repeat(many[of_hash], np.diff(np.append(starts, len(order))))]
            body = [pack_places(np.sort(words.start[at[local]]))] if len(local) else []
            tag, flag = value[fresh], np.logical_or.reduceat(flag, fresh)
            place = words.start[at[order[starts[fresh]]]]
            by_place = np.argsort(place)
            tag, flag, place, many = tag[by_place], flag[by_place], place[by_place], many[by_place]
            bucket, out = _buckets(tag, n_buckets), []
            for b, some in _by_bucket(bucket, n_buckets):
                gaps = np.diff(place[some], prepend=0).astype(np.uint64)
                out.append((b, planes(tag[some], 4) + planes(gaps * np.uint64(2) + flag[some], 4)))
            out += [(-1, x) for x in body]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())],
                ["bucket", "chunk", "body"],
            )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _same_key(batches, "bucket"):
            if unit.column("bucket")[0].as_py() < 0:
                yield unit.select(["chunk", "body"]).rename_columns(["chunk", "places"])
                continue
            tags, flags, places, source = [], [], [], []
            for k, body in enumerate(unit.column("body")):
                body = body.as_py()
                gaps = unplanes(body[len(body) // 2 :], 4)
                tags.append(unplanes(body[: len(body) // 2], 4).astype(np.uint32))
                flags.append((gaps & np.uint64(1)).astype(bool))
                places.append(np.cumsum(gaps >> np.uint64(1)).astype(np.uint32))
                source.append(np.full(len(gaps), k, np.int32))
            tag, flag, place, source = (np.concatenate(x) for x in (tags, flags, places, source))
            order = np.argsort(tag, kind="stable")
            sorted_tag = tag[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_tag[1:] != sorted_tag[:-1]]))
            size = np.diff(np.append(starts, len(order)))
            good = (size > 1) & np.logical_or.reduceat(flag[order], starts)
            hit = np.sort(order[np.repeat(good, size)])  # chunk by chunk, places rising
            cuts = np.searchsorted(source[hit], np.arange(unit.num_rows + 1))
            found = [(k, hit[cuts[k] : cuts[k + 1]]) for k in range(unit.num_rows) if cuts[k + 1] > cuts[k]]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [unit.column("chunk").take(pa.array([k for k, _ in found])), pa.array([pack_places(place[x].astype(np.int64)) for _, x in found], pa.binary())],
                    ["chunk", "places"],
                )

    probes = rows.mapInArrow(probe, "bucket int, chunk bigint, body binary")
    # what needs no bucket is dealt out by its chunk
    salt = F.when(F.col("bucket") < 0, F.col("chunk")).otherwise(0)
    dealt = probes.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket")
    return dealt.select("bucket", "chunk", "body").mapInArrow(match, "chunk bigint, places binary")


def anchored_documents(rows: DataFrame, found: DataFrame, chunk_bytes: int) -> DataFrame:
    """(_id, _row, places) of the documents that hold anchors, places from the document's first byte."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, own, _, borders in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([ids.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary()), pa.array([borders.tobytes()], pa.binary())],
                ["chunk", "ids", "rows", "borders"],
            )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                if not batch.column("ids")[k].is_valid:
                    raise ValueError("the documents came in another order; write them to a table first")
                ids, own, borders = (np.frombuffer(batch.column(c)[k].as_py(), np.int64) for c in ("ids", "rows", "borders"))
                places = np.unique(np.concatenate([unpack_places(p) for p in batch.column("places")[k].as_py()]))
                cuts = np.searchsorted(places, borders)
                docs = np.flatnonzero(np.diff(cuts))
                packed = [pack_places(places[cuts[d] : cuts[d + 1]] - borders[d]) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(own[docs]), pa.array(packed, pa.binary())], ["_id", "_row", "places"])

    chunks = rows.mapInArrow(name, "chunk bigint, ids binary, rows binary, borders binary").dropDuplicates(["chunk"])
    # one row per chunk, whose size is bounded
    listed = found.groupBy("chunk").agg(F.collect_list("places").alias("places"))
    return listed.join(chunks, "chunk", "left").mapInArrow(resolve, "_id bigint, _row bigint, places binary").dropDuplicates(["_id", "_row"])


def _wide_windows(words: Words, place: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows that hold an anchored block, at any of its places in the text."""
    at, got = words.rolling(block)
    key = got ^ mix(words.doc[at].astype(np.uint64))
    hit = at[np.isin(key, key[np.searchsorted(at, np.searchsorted(words.start, place))])]
    at, got = words.rolling(window)
    anchored = np.zeros(len(words.hash) + 1, np.int64)
    reach = window - block
    np.add.at(anchored, np.maximum(hit - reach, 0), 1)
    np.add.at(anchored, hit + 1, -1)
    near = np.cumsum(anchored)[at] > 0
    return at[near], got[near]


GROUPED = ["group", "ids", "rows", "which", "places"]
GROUP_KINDS = [pa.int32(), *[pa.binary()] * 4]


def _by_document(ids: np.ndarray, rows: np.ndarray, place: np.ndarray, n: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Places packed by document, and the documents by group: (group, ids, rows, places per document, places)."""
    order, starts = _groups(ids, rows)
    if not len(order):
        return
    size = np.diff(np.append(starts, len(order))).astype(np.int32)
    ids, rows = ids[order[starts]], rows[order[starts]]
    group = _buckets(mix(ids.view(np.uint64) ^ mix(rows.view(np.uint64))), n)
    for g, some in _by_bucket(group, n):
        mine = np.concatenate([order[starts[k] : starts[k] + size[k]] for k in some])
        yield g, ids[some].tobytes(), rows[some].tobytes(), size[some].tobytes(), planes(place[mine].astype(np.uint64), 4)


def repeats(texts: DataFrame, block: int, window: int, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """(_id, _row, gone): bytes at which windows begin whose words also begin in a smaller document."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", chunk_bytes):
            data, borders = utf8(batch.column("_text"))
            ids, own = batch.column("_id").to_numpy(), batch.column("_row").to_numpy()
            words = words_of(data, borders, WHITE)
            place = np.concatenate([unpack_places(p.as_py()) + b for p, b in zip(batch.column("places"), borders)]) if len(ids) else np.zeros(0, np.int64)
            at, got = _wide_windows(words, place, block, window)
            if not len(at):
                continue
            doc = words.doc[at]
            order, starts = _groups(got, ids[doc])
            size = np.diff(np.append(starts, len(order)))
            value = got[order[starts]]
            first = np.concatenate([[True], value[1:] != value[:-1]])  # the smallest document of each hash
            later = order[np.repeat(~first, size)]
            packed = _by_document(ids[doc[later]], own[doc[later]], words.start[at[later]] - borders[doc[later]], n_buckets)
            out = [(-1, group, i, r, n, b"", p) for group, i, r, n, p in packed]
            asked = np.sort(order[np.repeat(first, size)])
            bucket = _buckets(got[asked], n_buckets)
            for b, some in _by_bucket(bucket, n_buckets):
                some = asked[some]
                docs, which = np.unique(doc[some], return_inverse=True)
                place = words.start[at[some]] - borders[doc[some]]
                out.append((b, 0, ids[docs].tobytes(), own[docs].tobytes(), which.astype(np.int32).tobytes(), planes(got[some], 8), planes(place, 4)))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], ["bucket", "group", "ids", "rows", "which", "tags", "places"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _same_key(batches, "bucket"):
            if unit.column("bucket")[0].as_py() < 0:
                yield unit.select(GROUPED)
                continue
            ids = [np.frombuffer(x, np.int64) for x in unit.column("ids").to_pylist()]
            own = [np.frombuffer(x, np.int64) for x in unit.column("rows").to_pylist()]
            which = [np.frombuffer(x, np.int32) for x in unit.column("which").to_pylist()]
            tag = np.concatenate([unplanes(x, 8) for x in unit.column("tags").to_pylist()])
            place = np.concatenate([unplanes(x, 4) for x in unit.column("places").to_pylist()]).astype(np.int64)
            doc = np.concatenate([i[w] for i, w in zip(ids, which)])
            row = np.concatenate([o[w] for o, w in zip(own, which)])
            order, starts = _groups(tag)
            size = np.diff(np.append(starts, len(order)))
            gone = np.flatnonzero(doc[order] > np.repeat(np.minimum.reduceat(doc[order], starts), size)) if len(order) else order
            gone = order[gone]
            out = list(_by_document(doc[gone], row[gone], place[gone], n_buckets))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), GROUP_KINDS)], GROUPED)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _same_key(batches, "group"):
            ids, own, size = (
                np.concatenate([np.frombuffer(x, kind) for x in unit.column(c).to_pylist()])
                for c, kind in (("ids", np.int64), ("rows", np.int64), ("which", np.int32))
            )
            place = np.concatenate([unplanes(x, 4) for x in unit.column("places").to_pylist()]).astype(np.int64)
            ids, own = np.repeat(ids, size), np.repeat(own, size)
            order, cuts = _groups(ids, own, place)
            ids, own, place = ids[order[cuts]], own[order[cuts]], place[order[cuts]]  # each place once
            cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (own[1:] != own[:-1])]))
            packed = [pack_places(x) for x in np.split(place, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids[cuts]), pa.array(own[cuts]), pa.array(packed, pa.binary())], ["_id", "_row", "gone"])

    offers = texts.mapInArrow(offer, "bucket int, group int, ids binary, rows binary, which binary, tags binary, places binary")
    salt = F.when(F.col("bucket") < 0, F.xxhash64("ids", "rows")).otherwise(0)
    dealt = offers.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket").drop("salt")
    found = dealt.mapInArrow(decide, "group int, ids binary, rows binary, which binary, places binary")
    return found.repartition("group").sortWithinPartitions("group").mapInArrow(gather, "_id bigint, _row bigint, gone binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """(_id, _row, n_words, sha256) of all rows as they are: words joined by one space."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, borders = utf8(batch.column("_text"))
            words = words_of(data, borders, WHITE)
            digests = [hashlib.sha256(_joined(data, words, slice(a, b))).hexdigest() for a, b in zip(words.first[:-1], words.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), pa.array(np.diff(words.first), pa.int64()), pa.array(digests, pa.string())],
                ["_id", "_row", "n_words", "sha256"],
            )

    return rows.mapInArrow(scan, "_id bigint, _row bigint, n_words bigint, sha256 string")


def _joined(data: np.ndarray, words: Words, some) -> bytes:
    """The chosen words with one space between them."""
    start, end = words.start[some], words.end[some]
    if not len(start):
        return b""
    raw = data[start[0] : end[-1]].tobytes()
    return b" ".join(raw[a:b] for a, b in zip((start - start[0]).tolist(), (end - start[0]).tolist()))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """All rows as (_id, _row, n_words, sha256), and the changed ones as (_id, _row, n_removed, kept, spans).

    `spans` are the maximal repeats, as first word and number of words in the input.
    Rows that repeat both id and text are listed as often as they stand in `docs`.
    """
    block = (window + 1) // 2
    rows = _rows(docs, id_col, text_col)
    named = rows.where("_id is not null and _text is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = named.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n_buckets = max(parts, -(-size // BUCKET_BYTES))
    hits = anchored_documents(named, anchors(named, block, n_buckets, chunk_bytes), chunk_bytes).withColumnsRenamed({"_id": "_hid", "_row": "_hrow"})
    same = (F.col("_id") == F.col("_hid")) & (F.col("_row") == F.col("_hrow"))
    # dealt out once by document, and read from there by both joins
    dealt = named.repartition(parts, "_id", "_row")
    texts = dealt.join(hits, same).select("_id", "_row", "_text", "places")
    gone = repeats(texts, block, window, n_buckets, chunk_bytes)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            data, borders = utf8(batch.column("_text"))
            words = words_of(data, borders, WHITE)
            n_removed, kept, spans = [], [], []
            for d, packed in enumerate(batch.column("gone").to_pylist()):
                first, last = words.first[d], words.first[d + 1]
                start = words.start[first:last] - borders[d]
                hit = np.searchsorted(start, unpack_places(packed))
                cover = np.zeros(last - first + 1, np.int64)
                np.add.at(cover, hit, 1)
                np.add.at(cover, np.minimum(hit + window, last - first), -1)
                covered = np.cumsum(cover[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                n_removed.append(int(covered.sum()))
                spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                kept.append(_joined(data, words, first + np.flatnonzero(~covered)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))],
                ["_id", "_row", "n_removed", "kept", "spans"],
            )

    changed = dealt.join(gone, ["_id", "_row"]).mapInArrow(
        remove, "_id bigint, _row bigint, n_removed bigint, kept string, spans array<struct<first: bigint, words: bigint>>"
    )
    return word_counts(rows), changed
