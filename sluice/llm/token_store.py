"""Token-id shards with a minimal perfect hash index.

Shards are raw little-endian ids, documents in ascending doc_id order, one after the other; nothing stands between
them. The index maps a document key to (shard, position, length). It is split by key hash into parts of bounded size.
A part is a cascade of bit arrays (a key takes the first level where it alone hits a bit; its slot is the number of set
bits before it, which stands beside each word), so it is minimal and perfect, and a table of slots with a stored
fingerprint, so foreign keys are told apart. A lookup reads two words a level, of which there are two on average, then a
slot's entries; many lookups in one part read its arrays at once.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.shingles import mix
from sluice.llm.tokens import encoder, slices

#: Keys of an index part, and bytes of text of a shard, about.
PART_KEYS, SHARD_BYTES = 500_000, 24 << 20
#: Elements for each one that is asked for, from which on an array is read by words and not at once.
SPARSE = 64
#: Bits of a level for each key that reaches it.
GAMMA = 2.0
#: File header: magic, then the width of an id in bytes.
MAGIC = b"TOKIDS01"
_KIND = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys with a fingerprint for each slot. ``bits``: of each level; the arrays
    level0, rank0, level1, ... and prints come from ``take(name, places)``."""

    def __init__(self, bits: list[int], arrays: dict[str, np.ndarray] | None = None):
        self.bits, self.arrays = bits, arrays or {}

    def take(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.arrays[name][at]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, arrays, n = keys, [], {}, 0
        while len(left):
            level, bits = len(sizes), max(64, int(GAMMA * len(left)) + 63 & ~63)
            at = _at(left, level, bits)
            times = np.bincount(at.astype(np.int64), minlength=bits)
            words = np.packbits(times == 1, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            arrays[f"level{level}"], arrays[f"rank{level}"] = words, (n + np.cumsum(ones) - ones).astype("<u4")
            n += int(ones.sum())
            sizes.append(bits)
            left = left[times[at.astype(np.int64)] > 1]
            if len(sizes) > 60:
                raise ValueError("keys aren't distinct")
        out = cls(sizes, arrays)
        prints = np.zeros(len(keys), "<u4")
        prints[out.slots(keys)] = cls.fingerprint(keys)
        arrays["prints"] = prints
        return out

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a foreign key any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.bits):
            if not len(open_):
                break
            at = _at(keys[open_], i, bits)
            w, b = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            word = self.take(f"level{i}", w)
            hit = (word >> b & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << b[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.take(f"rank{i}", w[hit]).astype(np.int64) + below
            open_ = open_[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that aren't there (but for one foreign key in 2 ** 32)."""
        s = self.slots(keys)
        ok = s >= 0
        ok[ok] = self.take("prints", s[ok]) == self.fingerprint(keys[ok])
        return np.where(ok, s, -1)


def dump_index(index: PerfectHash, columns: dict[str, np.ndarray]) -> bytes:
    arrays = index.arrays | columns
    head = json.dumps({"bits": index.bits, "arrays": [[k, v.dtype.str, len(v)] for k, v in arrays.items()]}).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values())


class IndexFile(PerfectHash):
    """An index in a file that can be read at any place: few elements are read one by one, many with their array."""

    def __init__(self, file):
        self.file = file
        n = int.from_bytes(file.read_at(8, 0), "little")
        head = json.loads(file.read_at(n, 8))
        super().__init__(head["bits"])
        self.places, at = {}, 8 + n
        for k, kind, n in head["arrays"]:
            self.places[k] = (at, np.dtype(kind), n)
            at += n * np.dtype(kind).itemsize

    def take(self, name: str, at: np.ndarray) -> np.ndarray:
        start, kind, n = self.places[name]
        if name not in self.arrays and len(at) * SPARSE >= n:
            self.arrays[name] = np.frombuffer(self.file.read_at(n * kind.itemsize, start), kind)
        if name in self.arrays:
            return self.arrays[name][at]
        return np.frombuffer(b"".join(self.file.read_at(kind.itemsize, start + int(i) * kind.itemsize) for i in at), kind)


#: Where a null doc_id stands in the order, and what its key is made of.
NULL_ID = -(1 << 63)


def _ids(column) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy()


def key_of(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Key of the ``copy``-th row (from 0) of a doc_id."""
    return mix(doc_id.astype(np.int64).view(np.uint64) + copy.astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _write(root: str, tokenizer: str, end: int):
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        e, part = encoder(tokenizer), TaskContext.get().partitionId()
        at, path = storage.filesystem(f"{root}/shard-{part:06d}-{uuid.uuid4().hex}.ids")
        name, before, copy, position = path.rsplit("/", 1)[1], object(), -1, 0
        at.create_dir(path.rsplit("/", 1)[0], recursive=True)
        last = np.array([end], e.kind).tobytes()
        with at.open_output_stream(path + ".part") as out:
            out.write(MAGIC + e.kind.itemsize.to_bytes(8, "little"))
            for big in batches:
                for b in slices(big):
                    doc_ids, copies, sizes = b.column("doc_id").to_pylist(), [], []
                    for doc, raw in zip(doc_ids, e.encode(b.column("text"))):
                        known = NULL_ID if doc is None else doc
                        copy = copy + 1 if known == before else 0
                        before = known
                        out.write(raw)
                        out.write(last)
                        copies.append(copy)
                        sizes.append(len(raw) // e.kind.itemsize + 1)
                    n, m = np.array(sizes, np.int64), len(sizes)
                    pos = position + np.cumsum(n) - n
                    position += int(n.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(copies, pa.int64()), pa.array([part] * m, pa.int32()), pa.array([name] * m), pa.array(pos), pa.array(n)],
                        names=["doc_id", "copy", "part", "shard", "position", "n_tokens"],
                    )
        # a task that fails before this leaves no file of the name that its rows told
        if position:
            at.move(path + ".part", path)
        else:
            at.delete_file(path + ".part")

    return run


def _index(root: str):
    def run(group, table):
        import pyarrow as pa

        part = group[0].as_py()
        key = key_of(_ids(table.column("doc_id")), table.column("copy").to_numpy())
        index = PerfectHash.build(key)
        slot = index.slots(key)
        columns = {}
        for c, kind in (("shard_id", "<u4"), ("position", "<u8"), ("n_tokens", "<u8")):
            columns[c] = np.zeros(len(key), kind)
            columns[c][slot] = table.column(c).to_numpy()
        storage.write_file(f"{root}/index-{part:06d}.mph", dump_index(index, columns))
        return pa.table({"index_part": pa.array([part], pa.int32()), "n_keys": pa.array([len(key)], pa.int64())})

    return run


def _runs(values: np.ndarray):
    """(first, last + 1) of the runs of equal values."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return zip([0, *edge.tolist()], [*edge.tolist(), len(values)])


def _find(root: str):
    """Of rows sorted by index part."""

    def run(batches):
        import pyarrow as pa

        file, known, index = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column("index_part").to_numpy()
            for p, q in _runs(part):
                if part[p] != known:
                    if file:
                        file.close()
                    at, path = storage.filesystem(f"{root}/index-{part[p]:06d}.mph")
                    file, known = at.open_input_file(path), part[p]
                    index = IndexFile(file)
                rows = b.slice(p, q - p)
                slot = index.find(key_of(_ids(rows.column("doc_id")), rows.column("copy").to_numpy()))
                ok = slot >= 0
                out = [rows.column(c).filter(pa.array(ok)) for c in ("doc_id", "copy")]
                out += [pa.array(index.take(c, slot[ok]).astype(np.int64)) for c in ("shard_id", "position", "n_tokens")]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "copy", "shard_id", "position", "n_tokens"])
        if file:
            file.close()

    return run


def _read(root: str):
    """Of rows sorted by shard and position."""

    def run(batches):
        import pyarrow as pa

        file, known, kind = None, None, None
        for b in batches:
            crc = []
            for name, p, n in zip(*(b.column(c).to_pylist() for c in ("shard", "position", "n_tokens"))):
                if name != known:
                    if file:
                        file.close()
                    at, path = storage.filesystem(f"{root}/{name}")
                    file, known = at.open_input_file(path), name
                    head = file.read(16)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{name} is no id shard")
                    kind = _KIND[int.from_bytes(head[8:], "little")]
                raw = file.read_at(n * kind.itemsize, 16 + p * kind.itemsize)
                if len(raw) != n * kind.itemsize:
                    raise ValueError(f"{name} ends early")
                crc.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
            start = pa.array(b.column("position").to_numpy() + b.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), start, b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "copy", "start", "n_tokens", "ids_crc32"])
        if file:
            file.close()

    return run


class TokenStore:
    """Shards and index below ``root``: ``entries`` lists the documents, ``shards`` each shard's first id."""

    def __init__(self, root: str, entries: DataFrame, shards: DataFrame, parts: int):
        self.root, self.entries, self.shards, self.parts = root, entries, shards, parts

    def _part(self):
        return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(self.parts)).cast("int").alias("index_part")

    def find(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard_id, position, n_tokens) of keys (doc_id, copy) that are in the index, as often as they are
        asked for. Null ids are keys like others; an empty table finds nothing."""
        rows = keys.select("doc_id", "copy", self._part()).repartition("index_part").sortWithinPartitions("index_part")
        return rows.mapInArrow(_find(self.root), "doc_id long, copy long, shard_id long, position long, n_tokens long")

    def read(self, found: DataFrame) -> DataFrame:
        """Reads the ids of found documents from their shards: doc_id, copy, start (ids before it), n_tokens, ids_crc32.
        A shard that is missing, foreign or short raises."""
        rows = found.join(storage.small(self.shards), "shard_id").repartition("shard_id").sortWithinPartitions("shard_id", "position")
        return rows.mapInArrow(_read(self.root), "doc_id long, copy long, start long, n_tokens long, ids_crc32 long")


def _counted(raw: DataFrame) -> DataFrame:
    """Entries whose copies count on where rows of one doc_id go over several shards."""
    heads = raw.where("position = 0").select("doc_id").distinct()  # a row for each shard at most
    counts = raw.join(F.broadcast(heads), raw["doc_id"].eqNullSafe(heads["doc_id"]), "left_semi").groupBy("doc_id", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    more = storage.persist(counts.withColumn("more", F.sum("n").over(order)).where("more > 0").select(F.col("doc_id").alias("_doc"), F.col("part").alias("_part"), "more"), "copies")
    if more.isEmpty():
        storage.drop(more)
        return raw
    both = raw.join(F.broadcast(more), raw["doc_id"].eqNullSafe(more["_doc"]) & (raw["part"] == more["_part"]), "left")
    return storage.persist(both.withColumn("copy", F.col("copy") + F.coalesce("more", F.lit(0))).select(raw.columns), "entries")


def write_store(docs: DataFrame, tokenizer: str, end: int, root: str | None = None) -> TokenStore:
    """Encodes every row of ``docs`` (doc_id, text), ids in ascending doc_id order with ``end`` after each document.

    A null or empty text is ``end`` alone; long texts are encoded whole. Rows that repeat a doc_id are kept side by side
    and keyed by their number, in an order by a hash of their text. A null doc_id comes before all others. Other columns are ignored; an empty table gives an empty
    store. Shard names hold a random part, so a task that runs again never meets its own leavings.
    """
    spark = docs.sparkSession
    root = root or storage.new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(1, -(-(rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)).first()[0] or 0) // SHARD_BYTES))
    order = [F.coalesce("doc_id", F.lit(NULL_ID)), F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    with storage.narrow_batches(spark):
        entries = storage.persist(rows.mapInArrow(_write(root, tokenizer, end), "doc_id long, copy long, part int, shard string, position long, n_tokens long"), "entries")
    entries = _counted(entries)
    totals = entries.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = storage.persist(totals.select(F.col("part").cast("long").alias("shard_id"), "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "shards")
    parts = max(1, -(-entries.count() // PART_KEYS))
    store = TokenStore(root, entries, shards, parts)
    keyed = entries.select("doc_id", "copy", F.col("part").cast("long").alias("shard_id"), "position", "n_tokens", store._part())
    storage.persist(keyed.groupBy("index_part").applyInArrow(_index(root), "index_part int, n_keys long"), "index")
    return store
