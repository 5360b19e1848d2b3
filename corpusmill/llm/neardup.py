"""Near-duplicate records with small edits: an exact grouped prefix join over word shingles.

Two passes over the texts. The first counts every shingle in a sketch of fixed size, which fixes one
global order from rare to common, and gives each record a class key: records with the same set of
shingles form one class. In the second, classes with identical prefix and size form one group. A group deals the
tokens of its prefix into parts and sends one row for each part; a class sends one record to where it is kept; so
what is shuffled is the same for any number of buckets. A task that has a part joins its rows on twos of tokens, which are
made there and not sent. Pairs of groups that pass the size filter are added up over the parts; those that share enough
twos are expanded to the classes that are members, whose bitmaps of fixed width bound the overlap from above. What is left is
verified on the texts and expanded to the records of a class.

A shingle alone is shared by many pairs of texts that are not alike, where texts use few words; two of one part seldom are.
The filters lose nothing. Sizes form classes, each twice the one before, and a pair meets in the class of its smaller
text, which has g parts. A pair at or above the threshold shares at least g + SHARED shingles, and its g + SHARED rarest
common ones stand within both prefixes; dealt over g parts they make at least SHARED twos. Texts of a few shingles (class 0) meet
by single tokens: they share their SHARED rarest common ones, or all of them if there are fewer. A bitmap bound is never below
the overlap. Groups are named by 32 to 48 bits, as their number asks for; groups or tokens that share a name only make more
candidates. A class is named by a 64-bit key of its set of shingles.

With more than HOT records the rows of a part are dealt over s salts and sent to the s cells of their salt, so that every two of
them meet in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import kernels as K
from corpusmill.session import materialise

#: Twos of tokens that a pair must share in all parts together; of short texts, rarest common shingles within both prefixes.
SHARED = 4
#: Parts into which the tokens of short texts are dealt.
SINGLES = 64
#: Twos that are joined at once.
TWOS = 8_000_000
#: Width of a class's bitmap in bits.
BITMAP = 512
#: Prefix entries in a bucket on average; a bucket is joined by one task.
BUCKET_ENTRIES = 500_000
#: Records that make one salt.
HOT = 8_000_000
#: Pairs of entries taken at once, and pairs of groups added up at once.
CHUNK = 500_000
#: Entries that a task holds before it sends them on, and members of one blob.
HELD, BLOB = 4_000_000, 1 << 16
_CELLS = 1 << K.SKETCH_BITS
#: Bits of a token within its part, and where the size class and the number of a part begin in its name; the cell of the grid is below.
_SHORT, _CLASS, _PART = 24, 58, 34
_BLOCK = 1 << 15
_U = np.uint64
#: Bytes of a group's name, at most; `_name_bytes` says how many are used.
_GROUP = 6
_BITS = [f"b{i}" for i in range(BITMAP // 64)]


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5) -> "Pairs":
    """All pairs of records whose shingle sets have a Jaccard similarity of at least `threshold`.

    `id_col` is a unique integral key. Records with a NULL key or a text that is NULL or has no word have
    no partner; texts of fewer than `width` words have no shingle and are alike only if their words are
    the same. Rows repeated with the same key count once. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    first = materialise(rows.mapInArrow(_counts(width), "kind int, key long, value long, data binary"), "shingles")
    members = first.where("kind = 1").select(F.col("key").alias("id"), F.col("value").alias("class")).distinct()
    rank, records, entries = _ranks(first, threshold)
    wide = _name_bytes(records)
    shared = df.sparkSession.sparkContext.broadcast(rank)
    buckets = int(max(32, -(-entries // BUCKET_ENTRIES)))
    sent = rows.mapInArrow(_prefixes(shared, buckets, width, threshold, HOT, wide, records), "bucket int, data binary")
    # pairs are fewer and smaller than entries; their buckets are taken in several rounds where they are not
    fewer = max(8, buckets // 8)
    met = materialise(_by_bucket(sent, buckets).mapInArrow(_met(threshold, fewer, wide), "bucket int, data binary"), "met")
    pairs = _by_bucket(met.where("bucket >= 0"), fewer).mapInArrow(_enough, "ga long, gb long")
    records = met.where("bucket < 0").select("data").mapInArrow(_records, f"class long, id long, n int, grp long, {', '.join(f'{b} long' for b in _BITS)}")
    # a class that several tasks have sent is named by its smallest record
    classes = materialise(records.groupBy("class").agg(F.min(F.struct("id", "n", "grp", *_BITS)).alias("r")).select("class", "r.*"), "classes")
    candidates = materialise(_expanded(pairs, classes, threshold), "candidates")
    return Pairs(members, materialise(_verified(rows, candidates, threshold, width), "links"))


def _by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    """Buckets one after the other in as many tasks as they need; more tasks than buckets while those are few, so that seldom two fall together."""
    return df.repartition(min(4 * buckets, max(200, buckets)), "bucket").sortWithinPartitions("bucket")


class Pairs:
    """Classes of records with equal shingle sets, and the verified links between different classes."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members = members
        self.links = links

    def classes(self) -> DataFrame:
        """(id, class_id, class_size, links): the class is named by its smallest record; links are those to other classes."""
        c = self.members.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
        l = self.links
        n = l.select(F.col("class_a").alias("class")).union(l.select("class_b")).groupBy("class").agg(F.count("*").alias("links"))
        named = c.join(n, "class", "left").fillna(0, ["links"])
        return self.members.join(named, "class").select("id", "class_id", "class_size", "links")

    def edges(self) -> DataFrame:
        """(a, b): verified links between the smallest records of two classes."""
        c = self.members.groupBy("class").agg(F.min("id").alias("rep"))
        x, y = c.toDF("class_a", "ra"), c.toDF("class_b", "rb")
        j = self.links.join(x, "class_a").join(y, "class_b")
        return j.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))

    def records(self) -> DataFrame:
        """(a, b), a < b: every pair of records, those within a class included."""
        m = self.members
        x, y = m.toDF("ia", "class_a"), m.toDF("ib", "class_b")
        across = self.links.select("class_a", "class_b").join(x, "class_a").join(y, "class_b").select("ia", "ib")
        shared = m.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        own = m.join(shared, "class")
        within = own.select("class", F.col("id").alias("ia")).join(own.select("class", F.col("id").alias("ib")), "class").where("ia < ib").select("ia", "ib")
        return across.union(within).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def _slices(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for at in range(0, b.num_rows, K.SLICE):
            s = b.slice(at, K.SLICE)
            yield s.column(0).to_numpy(zero_copy_only=False), s.column(1).to_pylist()


def _class_keys(key: np.ndarray, n: np.ndarray, flat: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set of shingles; of short texts, for the sequence of words."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(n), np.uint64)
        doc = (key >> _U(K.TOKEN_BITS)).astype(np.int64)
        np.add.at(sums, doc, K.mix(key & _U((1 << K.TOKEN_BITS) - 1)))
        out = K.mix(sums + n.astype(np.uint64))
        short = np.flatnonzero(n == 0)
        at = K.starts(words)
        for i in short:
            h = _U(0x5851F42D4C957F2D)
            for w in flat[at[i] : at[i] + words[i]]:
                h = h * _U(0x9E3779B97F4A7C15) + w
            out[i] = h
    return out.view(np.int64)


def _counts(width: int):
    def run(batches):
        cache, cells, sizes, wide = K.WordHashes(), np.zeros(_CELLS, np.int64), np.zeros(3, np.int64), 0
        for ids, texts in _slices(batches):
            flat, words = K.word_hashes(texts, cache)
            key, n = K.shingle_sets(flat, words, width)
            cells += np.bincount(K.bucket_of(key), minlength=_CELLS)
            sizes += (len(n), n.sum(), 0)
            has = words > 0
            cls = _class_keys(key, n, flat, words)
            k = int(has.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, 1, np.int32)), pa.array(ids[has]), pa.array(cls[has]), pa.nulls(k, pa.binary())], ["kind", "key", "value", "data"])
        if sizes[0]:
            for i, block in enumerate(cells.reshape(-1, _BLOCK)):
                if top := int(block.max()):
                    small = block.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([i], pa.int64()), pa.array([small.itemsize], pa.int64()), pa.array([small.tobytes()], pa.binary())], ["kind", "key", "value", "data"])
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([int(sizes[0])]), pa.array([int(sizes[1])]), pa.nulls(1, pa.binary())], ["kind", "key", "value", "data"])

    return run


def _add_blocks(key, table):
    total = np.zeros(_BLOCK, np.int64)
    for size, data in zip(table.column("value").to_pylist(), table.column("data")):
        total += np.frombuffer(data.as_py(), {1: np.uint8, 2: np.uint16}.get(size, np.int64))
    return pa.table({"key": pa.array([key[0].as_py()]), "data": pa.array([K.quantised(total).tobytes()], pa.binary())})


def _ranks(first: DataFrame, threshold: float) -> tuple[np.ndarray, int, int]:
    """The sketch as one byte a cell (4 MB whatever the input), the records, and an upper bound of the prefix entries."""
    blocks = first.where("kind = 0").groupBy("key").applyInArrow(_add_blocks, "key long, data binary").collect()
    rank = np.zeros(_CELLS, np.uint8)
    for b in blocks:
        rank[b.key * _BLOCK : (b.key + 1) * _BLOCK] = np.frombuffer(b.data, np.uint8)
    records, shingles = first.where("kind = 2").agg(F.sum("key"), F.sum("value")).first()
    return rank, records or 0, int((shingles or 0) * (1 - threshold)) + (SHARED + 1) * (records or 0)


def bitmaps(key: np.ndarray, docs: int) -> np.ndarray:
    """Parity bitmaps of the token sets, as rows of 64-bit words."""
    cell = (key >> _U(K.TOKEN_BITS)).astype(np.int64) * BITMAP + (K.mix(key & _U((1 << K.TOKEN_BITS) - 1)) & _U(BITMAP - 1)).astype(np.int64)
    odd = (np.bincount(cell, minlength=docs * BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(docs, BITMAP), axis=1).view(np.uint64)


def _name_bytes(records: int) -> int:
    """So many that about one group in 32 at most shares its name with another."""
    return next((w for w in (4, 5) if records <= 1 << (8 * w - 5)), _GROUP)


def _at_least(size: int, t: float) -> int:
    """Shingles that a text of `size` shares at least with any partner of its size or more."""
    return int(K.least_common(np.array([2 * size]), t)[0])


def _first_class(t: float) -> int:
    """The lowest size class (of sizes from 2 ** c on) whose pairs share enough tokens to be met by two at once; smaller texts meet by single tokens, as class 0."""
    return next(c for c in range(1, 64) if _at_least(1 << c, t) >= 2 * SHARED)


def _parts(c: int, t: float) -> int:
    """Parts into which tokens are dealt for size class c: fewer than any pair of it shares, by SHARED."""
    return SINGLES if c == 0 else max(1, min(int(0.6 * (1 - t) * (1 << c)), _at_least(1 << c, t) - SHARED))


def _classes_of(n: np.ndarray, first: int) -> np.ndarray:
    c = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    return np.where(c < first, 0, c)


def _length(n: np.ndarray, c: np.ndarray, t: float) -> np.ndarray:
    """Prefix of texts in size class c: holds the tokens of which a pair must share more than there are parts, by SHARED."""
    more = np.array([0 if x == 0 else _parts(int(x), t) for x in range(int(c.max(initial=0)) + 1)])
    return K.probe_length(n, t, SHARED + more[c])


def _prefixes(shared, buckets: int, width: int, t: float, most: float, wide: int = _GROUP, records: int = 0):
    """Blobs for the buckets: rows of the groups (bucket 0 and up) and records of the classes (below 0).

    A class and the prefix of a group are sent once by a task: copies cost nothing further.
    """
    first_class, salts = _first_class(t), max(1, -int(-records // most))

    def run(batches):
        cache, rank = K.WordHashes(), shared.value
        known: set[int] = set()
        groups: set[int] = set()
        held: list[tuple] = []
        size = 0
        for ids, texts in _slices(batches):
            flat, words = K.word_hashes(texts, cache)
            key, n = K.shingle_sets(flat, words, width)
            token = K.by_rarity(key, rank)
            cls = _class_keys(key, n, flat, words)
            top = _classes_of(n, first_class)
            at, run_, place = K.heads(n, np.where(n > 0, _length(n, top, t), 0))
            with np.errstate(over="ignore"):
                prefix = n.astype(np.uint64)
                np.add.at(prefix, run_, K.mix(token[at] + (place.astype(np.uint64) << _U(K.TOKEN_BITS))))
                group = K.mix(prefix) >> _U(64 - 8 * wide)
            fresh, first = np.zeros(len(n), bool), np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if (c := int(cls[i])) not in known:
                    known.add(c)
                    fresh[i] = True
                    if (g := int(group[i])) not in groups:
                        groups.add(g)
                        first[i] = True
            mine = np.flatnonzero(fresh)
            if len(mine):
                yield from _batches([(-1 - int(group[mine[0]] % _U(buckets)), pack_records(ids[mine], cls[mine], n[mine], group[mine], bitmaps(key, len(n))[mine]))])
            low = _classes_of(np.ceil(t * n - 1e-9).astype(np.int64), first_class)
            # a pair meets in the class of its smaller text
            for c in (0, *range(first_class, int(top.max(initial=0)) + 1)):
                here = first & (low <= c) & (c <= top)
                if here.any():
                    held.append(_spread(*_dealt(token, n, here, c, t), group, n, salts))
                    size += len(held[-1][-1])
            if size > HELD:
                yield from _batches(_entry_blobs(held, buckets, wide))
                held.clear(), known.clear(), groups.clear()
                size = 0
        if size:
            yield from _batches(_entry_blobs(held, buckets, wide))

    return run


def _dealt(token, n, here, c: int, t: float):
    """Rows of the chosen texts in size class c: name of their part of the tokens, text, number of tokens; and the tokens of all rows."""
    at, run, _ = K.heads(n, np.where(here, _length(n, np.full(len(n), c), t), 0))
    parts = _U(_parts(c, t))
    with np.errstate(over="ignore"):
        part = K.mix(token[at] + _U(1 << 60)) % parts
    full = ((run.astype(np.uint64) * parts + part) << _U(_SHORT)) | (token[at] & _U((1 << _SHORT) - 1))
    full.sort()
    row = full >> _U(_SHORT)
    lead = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    size = np.diff(np.append(lead, len(row)))
    row = row[lead]
    # one token makes no two
    ok = size >= (1 if c == 0 else 2)
    return (_U(c) << _U(_CLASS)) | ((row[ok] % parts) << _U(_PART)), (row[ok] // parts).astype(np.int64), size[ok], (full & _U((1 << _SHORT) - 1))[np.repeat(ok, size)]


def _spread(part, text, size, token, group, n, salts: int):
    """Rows with their side: once for each cell of the grid that their salt belongs to."""
    side = np.zeros(len(part), np.uint8)
    if salts > 1:
        i = np.repeat(np.arange(len(part)), salts)
        other = np.tile(np.arange(salts), len(part))
        with np.errstate(over="ignore"):
            own = (K.mix(group[text]) % _U(salts)).astype(np.int64)[i]
        token = token[_members(size, i)]
        part = part[i] + (np.minimum(own, other) * salts + np.maximum(own, other)).astype(np.uint64)
        text, size, side = text[i], size[i], (np.sign(other - own) % 3).astype(np.uint8)
    return part, group[text], n[text], size, side, token


def _members(size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the members of the given rows, whose members lie one row after the other."""
    return np.repeat(K.starts(size)[rows], size[rows]) + np.arange(int(size[rows].sum())) - np.repeat(K.starts(size[rows]), size[rows])


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal buckets of a sorted array, in pieces of BLOB members."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        for i in range(a, b, BLOB):
            yield int(bucket[a]), slice(i, min(i + BLOB, b))


def _entry_blobs(held: list[tuple], buckets: int, wide: int) -> Iterator[tuple[int, bytes]]:
    part, group, n, size, side, token = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(part)
    token = token[_members(size, order)].astype(np.uint32)
    part, group, n, size, side = part[order], group[order], n[order], size[order], side[order]
    ends = np.cumsum(size)
    for p, s in _runs(part):
        yield int(K.mix(part[s.start : s.start + 1])[0] % _U(buckets)), pack_entries(p, group[s], n[s], size[s], side[s], token[ends[s.start] - size[s.start] : ends[s.stop - 1]], wide)


def _batches(blobs) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for blob in blobs:
        held.append(blob)
        size += len(blob[1])
        if size > 1 << 22:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([d for _, d in blobs], pa.binary())], ["bucket", "data"])


def _planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of numbers, all first bytes before all second ones: what is mostly 0 then takes no room."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _packed(columns: list[tuple[np.ndarray, int]]) -> bytes:
    return b"".join([np.array([len(columns[0][0]), *(w for _, w in columns)], np.int64).tobytes(), *(_planes(x, w) for x, w in columns)])


def unpack(data: bytes, columns: int, at: int = 0) -> list[np.ndarray]:
    n, *widths = map(int, np.frombuffer(data, np.int64, 1 + columns, at))
    at, out = at + 8 + 8 * columns, []
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(data, np.uint8, w * n, at).reshape(w, n).T
        out.append(x.view(np.uint64).ravel())
        at += w * n
    return out


def _width(x: np.ndarray) -> int:
    return 2 if int(x.max(initial=0)) < 65536 else 4


def pack_entries(part: int, group, n, size, side, token, wide: int) -> bytes:
    """Rows of one part with the tokens of all of them, which come first."""
    return np.array([part], np.uint64).tobytes() + _packed([(token, 3)]) + _packed([(group, wide), (n, _width(n)), (size, _width(size)), (side, 1)])


def unpack_entries(data: bytes) -> list[np.ndarray]:
    """Groups, sizes, numbers of tokens, sides and tokens of a blob of rows."""
    token = unpack(data, 1, 8)[0]
    group, n, size, side = unpack(data, 4, 24 + 3 * len(token))
    return [group, n.astype(np.int32), size.astype(np.int32), side.astype(np.uint8), token.astype(np.uint32)]


def pack_records(ids, cls, n, group, bits) -> bytes:
    return _packed([(ids.view(np.uint64), 8), (cls.view(np.uint64), 8), (n, 4), (group, _GROUP), *((x, 8) for x in bits.reshape(-1, BITMAP // 64).T)])


def _records(batches):
    for b in batches:
        for x in b.column(0):
            ids, cls, n, group, *bits = unpack(x.as_py(), 4 + BITMAP // 64)
            yield pa.RecordBatch.from_arrays([pa.array(cls.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(group.view(np.int64)), *(pa.array(c.view(np.int64)) for c in bits)], ["class", "id", "n", "grp", *_BITS])


def _grouped(batches) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each bucket; rows are sorted by bucket."""
    key, held = None, []
    for b in batches:
        for k, d in zip(b.column(0).to_pylist(), b.column(1)):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(d.as_py())
    if held:
        yield key, held


def _met(t: float, buckets: int, wide: int):
    """Joins the rows of each part: blobs of group pairs with the twos of tokens they share there. Records of classes pass through."""
    first_class = _first_class(t)

    def run(batches):
        # pairs are held over the buckets of a task, so that blobs are as long with many small buckets
        held, size = [], 0
        for key, blobs in _grouped(batches):
            if key < 0:
                yield from _batches((key, d) for d in blobs)
                continue
            parts: dict[int, list[bytes]] = {}
            for d in blobs:
                parts.setdefault(int(np.frombuffer(d, np.uint64, 1)[0]), []).append(d)
            del blobs
            for part in sorted(parts):
                c = part >> _CLASS
                group, n, members, side, token = _once(*(np.concatenate(x) for x in zip(*map(unpack_entries, parts.pop(part)))))
                for two, row, again in _twos(token, members, c):
                    for a, b, seen in K.prefix_pairs(two, n[row], row, again, t, SHARED, CHUNK, side[row]):
                        ok = (group[a] != group[b]) & (_classes_of(np.minimum(n[a], n[b]), first_class) == c)
                        a, b, seen = a[ok], b[ok], seen[ok]
                        # two sets of `total` shingles together may share fewer than SHARED at the threshold
                        need = np.minimum(SHARED, K.least_common(n[a].astype(np.int64) + n[b], t))
                        x, y = group[a].view(np.int64), group[b].view(np.int64)
                        held.append((np.minimum(x, y), np.maximum(x, y), np.minimum(seen, SHARED) + 16 * need))
                        size += len(a)
                        if size > CHUNK:
                            yield from _batches(_pair_blobs(held, buckets, wide))
                            held, size = [], 0
        if size:
            yield from _batches(_pair_blobs(held, buckets, wide))

    return run


def _once(group, n, size, side, token):
    """The rows without those that several tasks have sent."""
    with np.errstate(over="ignore"):
        name = K.mix(group) + (n.astype(np.uint64) << _U(2)) + side
        if len(token):
            name = K.mix(name) + np.add.reduceat(K.mix(token.astype(np.uint64)), K.starts(size))
    rows = np.sort(np.unique(name, return_index=True)[1])
    if len(rows) == len(group):
        return group, n, size, side, token
    return group[rows], n[rows], size[rows], side[rows], token[_members(size, rows)]


def _twos(token, size, c: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names of the twos of tokens (in class 0 the tokens) that stand in several rows, their rows, and 1 for one that its row has already had."""
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(K.starts(size) + size, size) - np.arange(len(token)) - 1
    low = max(1, len(size).bit_length())
    sized = size.astype(np.int64)
    rounds = int(-(-(len(token) if c == 0 else (sized * (sized - 1) // 2).sum()) // TWOS)) or 1
    turn = K.mix(token.astype(np.uint64)) % _U(rounds)
    for r in range(rounds):
        i = np.flatnonzero(turn == r)
        got = []
        for d in (0,) if c == 0 else range(1, int(size.max(initial=0))):
            i = i[left[i] >= d]
            with np.errstate(over="ignore"):
                name = K.mix((token[i].astype(np.uint64) << _U(_SHORT)) | token[i + d])
            got.append(((name >> _U(low)) << _U(low)) | row[i].astype(np.uint64))
        if not got:
            continue
        full = np.concatenate(got)
        full.sort()
        name = full >> _U(low)
        same = name[1:] == name[:-1]
        at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(full) else []
        if len(at):
            again = np.concatenate([[0], full[at][1:] == full[at][:-1]]).astype(np.int64)
            yield name[at], (full[at] & _U((1 << low) - 1)).astype(np.int64), again


def _pair_blobs(held: list[tuple], buckets: int, wide: int) -> Iterator[tuple[int, bytes]]:
    a, b, x = (np.concatenate(y) for y in zip(*held))
    with np.errstate(over="ignore"):
        bucket = (K.mix(K.mix(a.view(np.uint64)) + b.view(np.uint64)) % _U(buckets)).astype(np.int64)
    order = np.lexsort((a, bucket))
    a, b, x, bucket = a[order], b[order], x[order], bucket[order]
    for k, s in _runs(bucket):
        yield k, _packed([(np.diff(a[s], prepend=0), wide), (b[s], wide), (x[s], 1)])


def _enough(batches):
    """(ga, gb): group pairs that share enough tokens in all buckets together."""
    for _, blobs in _grouped(batches):
        parts = [unpack(d, 3) for d in blobs]
        # a large bucket is taken in several rounds
        rounds = -(-sum(len(p[0]) for p in parts) // (4 * CHUNK))
        for r in range(rounds):
            got = []
            for p in parts:
                a, b, x = np.cumsum(p[0]), p[1], p[2]
                mine = (K.mix(a) % _U(rounds)) == r
                got.append((a[mine], b[mine], x[mine]))
            a, b, x = (np.concatenate(y).astype(np.int64) for y in zip(*got))
            order = np.lexsort((b, a))
            a, b, x = a[order], b[order], x[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
            if len(new):
                ok = np.add.reduceat(x & 15, new) >= np.minimum.reduceat(x >> 4, new)
                yield pa.RecordBatch.from_arrays([pa.array(a[new][ok]), pa.array(b[new][ok])], ["ga", "gb"])


def _expanded(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(a, b, class_a, class_b): classes of group pairs, and of one group, whose bitmaps allow the overlap they need.

    The bound is part of the join condition, so that the pairs of a hot group are met but not put out.
    """
    several = classes.groupBy("grp").count().where("count > 1").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
    x = classes.toDF("class_a", "a", "na", "ga", *[f"x{b}" for b in _BITS])
    y = classes.toDF("class_b", "b", "nb", "hb", *[f"y{b}" for b in _BITS])
    apart = " + ".join(f"bit_count(x{b} ^ y{b})" for b in _BITS)
    near = f"floor((na + nb - ({apart})) / 2) >= ceil({t / (1 + t)!r}D * (na + nb) - 1e-9D)"
    met = pairs.union(several).join(x, "ga")
    return met.join(y, F.expr(f"gb = hb and (ga < gb or class_a < class_b) and {near}")).select("a", "b", "class_a", "class_b")


def needed_rows(rows: DataFrame, ids: DataFrame, id_col: str, most: int = 1 << 26) -> DataFrame:
    """Rows whose id may occur in `ids`, by a bitmap of 16 bits an id, at most 8 MB: thins out texts before they are shuffled."""
    bits = 1 << min(most.bit_length() - 1, max(16, (16 * ids.count()).bit_length()))

    def maps(batches):
        m = np.zeros(bits, bool)
        for b in batches:
            m[_cell(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(m).tobytes()], pa.binary())], ["data"])

    total = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(4).mapInArrow(maps, "data binary").toLocalIterator():
        total |= np.frombuffer(r.data, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(total)

    def thin(batches):
        m = np.unpackbits(shared.value).view(bool)
        for b in batches:
            yield b.filter(pa.array(m[_cell(b.column(b.schema.get_field_index(id_col)).to_numpy(zero_copy_only=False), bits)]))

    return rows.mapInArrow(thin, rows.schema)


def _cell(ids: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(ids.astype(np.int64).view(np.uint64)) & _U(bits - 1)).astype(np.int64)


def _verified(rows: DataFrame, candidates: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (class_a, class_b, similarity): the shingle sets of the two texts themselves are compared."""
    ids = candidates.select(F.col("a").alias("id")).union(candidates.select("b"))
    texts = needed_rows(rows, ids, "id").dropDuplicates(["id"])
    j = candidates.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("class_a", "class_b", "text_a", "text_b")

    def verify(batches):
        # pairs of one text come in a row or nearly so
        sets = lru_cache(512)(lambda x: K.shingles(x, width))
        for b in batches:
            s = np.array([K.similarity(sets(x.as_py()), sets(y.as_py())) for x, y in zip(b.column(2), b.column(3))], np.float64)
            ok = pa.array(s >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(s).filter(ok)], ["class_a", "class_b", "similarity"])

    return j.mapInArrow(verify, "class_a long, class_b long, similarity double")
