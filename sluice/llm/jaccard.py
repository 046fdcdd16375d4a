"""N-gram Jaccard join by vertical partitioning.

The global order of the n-grams is the order of their 64-bit hashes. It is cut into fragments, the same for all sets, so
a set is a row of segments. For each candidate pair the partial overlaps are counted fragment by fragment, on (pair,
fragment) rows, and summed per pair; only the sum decides.

Candidates come from finer cuts of the same order, one for each size class. Two sets of Jaccard similarity ``t`` or
more differ in at most ``D`` n-grams (``D`` follows from the class and ``t``), so of ``floor(D / (k2 + 1)) + 1`` groups
of ``n2`` segments at least one holds at most ``k2`` differing ones: the sets agree on ``n2 - k2`` whole segments there.
Such agreements are keys (exact: no link is lost). Tasks send 32 bits of a key and the place of its set in the task's
list of sets; what 32 bits confuse is a needless candidate, nothing else.

Equal sets are one node, whatever the number of copies. Of the sets that share a key only pairs with the smallest node
are candidates at first: of these each node's best is counted, components grow, and then what still lies across
components. Where a key's list still holds several components, its cross pairs follow; where these are many (copies that
are near each other, but often just below the threshold), the sets are compared in blocks: each pair of blocks is a task
that counts overlaps as matrix products and returns components, not pairs. So a group of n near copies makes in the order
of n rows, not n * n, and a task sends a key that all its sets share once, or once for each component.

Before n-grams are sent, candidates are held against parity bitmaps: an n-gram flips one bit, so two sets differ in at
least as many n-grams as bits, and pairs that differ in too many can't link.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.shingles import mix, shingle_sets
from sluice.llm.tokens import forget

#: Fragments of the global order: segments on which partial overlaps are counted. A power of two.
FRAGMENTS = 8
#: A bucket of the candidate search gets about so many keys.
BUCKET_KEYS = 800_000
#: Keys that a task gathers before it sends them, and sets of these at most.
FLUSH_KEYS, FLUSH_SETS = 400_000, 1 << 16
#: So many sets of one component that share a key travel one by one; more in one task go as their component.
PACK = 8
#: A list of several components gives its cross pairs up to so many a member. Longer ones are compared in blocks.
CROSS = 8
#: Sets of a block, and n-grams of one, at most; n-grams whose overlaps are counted at a time; bitmaps of a block.
BLOCK, BLOCK_GRAMS, COLUMNS, BLOCK_SIGNS = 768, 1_000_000, 4096, 400


@lru_cache(None)
def _bounds() -> tuple[int, ...]:
    """First sizes of the classes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return tuple(out)


@lru_cache(None)
def _scheme(c: int, num: int, den: int) -> tuple[int, int, int, int] | None:
    """(groups, n2, k2, slack) of class ``c``; None if only equal sets can link."""
    most = _bounds()[c + 1] - 1
    d = (most + most * den // num) * (den - num) // (den + num)
    if d == 0:
        return None
    if d <= 4:
        return 1, d + 3, d, 0
    if d <= 14:
        return d // 3 + 1, 5, 2, 0
    groups = d // 2 + 1
    slack = groups // 8 + 2
    return groups + slack, 3, 1, slack


@lru_cache(None)
def _classes(n: int, num: int, den: int) -> tuple[int, ...]:
    """Classes under which a set of size n looks for partners: its own, as the smaller, and lower ones, as the larger."""
    b = _bounds()
    own = int(np.searchsorted(b, n, "right")) - 1
    out = [own]
    while out[-1] > 0 and (b[out[-1]] - 1) * den // num >= n:
        out.append(out[-1] - 1)
    return tuple(c for c in out if _scheme(c, num, den))


@lru_cache(None)
def _picks(n2: int, k2: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), n2 - k2)))


def set_node(tokens: np.ndarray) -> int:
    """The id of a set: equal sets, equal ids."""
    h = mix(tokens.sum(keepdims=True, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens)))
    return int(h.view(np.int64)[0])


def segment_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """What a set agrees on with every set it can link to, at least once."""
    out = []
    for c in _classes(len(tokens), num, den):
        groups, n2, k2, slack = _scheme(c, num, den)
        cuts = groups * n2
        at = np.searchsorted(tokens >> np.uint64(32), (np.arange(cuts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(cuts))
        at[-1] = len(tokens)
        total = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens + np.uint64(0x2545F4914F6CDD1D)), out=total[1:])
        part = mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).reshape(groups, n2)
        size = np.diff(at).reshape(groups, n2)
        pick = _picks(n2, k2)
        coef = np.arange(1, pick.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        keys = mix((part[:, pick] * coef).sum(2, dtype=np.uint64) + (np.arange(groups * len(pick), dtype=np.uint64).reshape(groups, -1) + np.uint64(c << 40)) * np.uint64(0xFF51AFD7ED558CCD))
        full = size[:, pick].sum(2) > 0
        # Keys of empty segments say nothing. They are left out while enough groups without any remain.
        out.append(keys[full] if (~full.all(1)).sum() <= slack else keys.ravel())
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _profile(k: int):
    def run(batches):
        import pyarrow as pa

        forget()
        for b in batches:
            node, n = [], []
            for t in shingle_sets(b.column("text"), k):
                n.append(len(t))
                node.append(set_node(t) if len(t) else 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "node", "n"])

    return run


#: Bits of a set's parity bitmap, at least and at most; about one an n-gram between.
LEAST_BITS, MOST_BITS = 64, 1 << 16


def parity(tokens: np.ndarray) -> np.ndarray:
    """The bitmap of a set, in 64-bit words: bit i is the parity of the n-grams whose mixed hash is i modulo the size."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length()))
    at = (mix(tokens ^ np.uint64(0x94D049BB133111EB)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").view(np.uint64)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """N-grams that two sets differ in, at least: by bitmaps, the larger one folded to the smaller one's size."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(k: int):
    """(doc_id, node, n, bits, grams): a set's bitmap and its n-grams, one binary a fragment. A task gives a (doc_id, node)
    once."""

    def run(batches):
        import pyarrow as pa

        forget()
        seen: set = set()
        shift = np.uint64(64 - FRAGMENTS.bit_length() + 1)
        edges = np.arange(1, FRAGMENTS, dtype=np.uint64)
        for b in batches:
            rows, held = [], 0
            for doc, t in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), k)):
                if not len(t) or (key := (doc, set_node(t))) in seen:
                    continue
                seen.add(key)
                rows.append((*key, len(t), parity(t).tobytes(), [x.tobytes() for x in np.split(t, np.searchsorted(t >> shift, edges))]))
                held += len(t)
                if held > 1 << 18:
                    yield _sets_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _sets_batch(rows)
        yield _sets_batch([])

    def _sets_batch(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())))], names=["doc_id", "node", "n", "bits", "grams"])

    return run


def _tokens(grams):
    """The sets of a column of grams, a few at a time."""
    for i in range(0, len(grams), 200):
        for x in grams.slice(i, 200).to_pylist():
            yield np.frombuffer(b"".join(x), np.uint64)


def _star(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (key, node) rows: the rows of each key's smallest node, and pairs (smallest, other) with the number of keys
    that give them."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    order, key, node = order[new], key[new], node[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(head)
    a, b = np.repeat(node[first], np.diff(np.append(first, len(key))))[~head], node[~head]
    return order[head], *_counted(a, b)


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, with the sums of n."""
    if not len(a):
        return a, b, np.zeros(0, np.int64)
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[new], b[new], np.add.reduceat(np.ones(len(a), np.int64) if n is None else n[o], at)


#: Rows that tasks send: of a bucket, 32 bits of each key and the place of its set among nodes (and labels); packed: 1
#: where the set stands for its whole component. In buckets below 0, pairs: keys and nodes are nodes, labels the counts.
_PACKED = "bucket int, keys binary, place binary, nodes binary, labels binary, packed binary"


def _packed_batch(rows):
    import pyarrow as pa

    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])


def _send(num: int, den: int, buckets: int, labelled: bool, k: int = 0):
    """Sends the keys of all sets to their buckets. Without labels a key goes out once a flush, with its smallest node; the
    others are paired with that one here. With labels (the nodes' components), up to PACK sets of a label go out one
    by one, more as one row that stands for the component."""

    def flush(keys, nodes, labels):
        key = np.concatenate(keys)
        if not len(key):
            return
        place = np.repeat(np.arange(len(nodes)), [len(x) for x in keys])
        node, out = np.array(nodes, np.int64), []
        label = np.array(labels, np.int64) if labelled else None
        packed = None
        if labelled:
            order = np.lexsort((node[place], label[place], key))
            key, place = key[order], place[order]
            head = np.ones(len(key), bool)
            head[1:] = (key[1:] != key[:-1]) | (label[place[1:]] != label[place[:-1]])
            size = np.diff(np.append(np.flatnonzero(head), len(key)))
            many = np.repeat(size > PACK, size)
            keep = ~many | head
            key, place, packed = key[keep], place[keep], many[keep].astype(np.uint8)
        else:
            keep, a, b, n = _star(key, node[place])
            key, place = key[keep], place[keep]
            if len(a):
                to = (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for i in np.unique(to):
                    m = to == i
                    out.append((-1 - int(i), a[m].tobytes(), b"", b[m].tobytes(), n[m].tobytes(), b""))
        h = mix(key ^ np.uint64(0xA5A5A5A5))
        to, short = (h % np.uint64(buckets)).astype(np.int32), (mix(key) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(to, kind="stable")
        ends = np.searchsorted(to[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(ends)):
            m = order[ends[i] : ends[i + 1]]
            own, at = np.unique(place[m], return_inverse=True)
            out.append((int(i), short[m].tobytes(), at.astype(np.uint16).tobytes(), node[own].tobytes(), label[own].tobytes() if labelled else b"", packed[m].tobytes() if labelled else b""))
        for i in range(0, len(out), 256):
            yield _packed_batch(out[i : i + 256])

    def run(batches):
        forget()
        keys, nodes, labels, held = [], [], [], 0
        seen: set[int] = set()
        for b in batches:
            mark = b.column("label").to_pylist() if labelled else None
            for i, t in enumerate(_tokens(b.column("grams")) if labelled else shingle_sets(b.column("text"), k)):
                if not len(t) or (node := set_node(t)) in seen:
                    continue
                seen.add(node)
                keys.append(segment_keys(t, num, den))
                nodes.append(node)
                if labelled:
                    labels.append(mark[i])
                held += len(keys[-1])
                if held >= FLUSH_KEYS or len(nodes) >= FLUSH_SETS:
                    yield from flush(keys, nodes, labels)
                    keys, nodes, labels, held = [], [], [], 0
        if keys:
            yield from flush(keys, nodes, labels)

    return run


def _unpacked(table) -> tuple[np.ndarray, ...]:
    """(key, node, label, packed) of a bucket's rows."""
    get = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    place, nodes, labels = get("place", np.uint16), get("nodes", np.int64), get("labels", np.int64)
    at = lambda x: np.concatenate([y[p] if len(y) else np.zeros(len(p), np.int64) for y, p in zip(x, place)])
    return np.concatenate(get("keys", np.uint32)), at(nodes), at(labels), np.concatenate(get("packed", np.uint8))


def _pairs_table(a: np.ndarray, b: np.ndarray, n: np.ndarray):
    import pyarrow as pa

    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})


def _stars(key, table):
    if key[0].as_py() < 0:
        a, b, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("keys", "nodes", "labels"))
        return _pairs_table(*_counted(a, b, n))
    keys, node, _, _ = _unpacked(table)
    return _pairs_table(*_star(keys, node)[1:])


#: What a row (a, b) of _crosses asks for: count the pair, compare the node b in blocks with all others of group a, or the
#: whole component b.
COUNT, IN_BLOCKS, WHOLE = 0, 1, 2


def _crosses(key, table):
    """Of lists that hold several components: pairs across these, or what goes to blocks. Lists are one group there if they
    have the same smallest node (the same smallest component, of those that travel packed). Lists that only share some
    node stay apart: through passages that many texts hold they all hang together, and a group costs its square."""
    k, node, label, packed = _unpacked(table)
    order = np.lexsort((node, label, k))
    k, node, label, packed = k[order], node[order], label[order], packed[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = np.append(np.flatnonzero(head), len(k))
    several = label[first[:-1]] != label[first[1:] - 1] if len(k) else np.zeros(0, bool)
    rows, done = [], set()
    for p, q in zip(first[:-1][several], first[1:][several]):
        if (same := (node[p:q].tobytes(), packed[p:q].any())) in done:
            continue
        done.add(same)
        keep = np.ones(q - p, bool)
        keep[1:] = node[p + 1 : q] != node[p : q - 1]
        n, l, whole = node[p:q][keep], label[p:q][keep], np.unique(label[p:q][packed[p:q] > 0])
        _, size = np.unique(l, return_counts=True)
        start = np.concatenate([[0], np.cumsum(size)])
        if not len(whole) and (len(l) ** 2 - int((size.astype(np.int64) ** 2).sum())) // 2 <= CROSS * len(l):
            for g in range(len(size) - 1):
                x, y = n[start[g] : start[g + 1]], n[start[g + 1] :]
                rows.append((np.repeat(x, len(y)), np.tile(y, len(x)), COUNT))
        else:
            group = whole.min() if len(whole) else n.min()
            rows.append((np.full(len(n), group), n, IN_BLOCKS))
            rows.append((np.full(len(whole), group), whole, WHOLE))
    if not rows:
        return _pairs_table(*[np.zeros(0, np.int64)] * 3)
    a, b = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
    what = np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])
    pair = what == COUNT
    lo, hi = np.where(pair, np.minimum(a, b), a), np.where(pair, np.maximum(a, b), b)
    order = np.lexsort((what, hi, lo))
    lo, hi, what = lo[order], hi[order], what[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (what[1:] != what[:-1])
    return _pairs_table(lo[new], hi[new], what[new])


def _block_links(num: int, den: int):
    """Components of the sets of two blocks, as (smallest node, node) pairs. Overlaps of all pairs are counted on one
    fragment of the order at a time, as products of 0-1 matrices, and summed."""

    def run(key, table):
        node = table.column("node").to_numpy()
        sets = list(_tokens(table.column("grams")))
        n = np.array([len(t) for t in sets], np.float64)
        grams, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
        shared = times > 1  # an n-gram of one set overlaps with nothing
        column = np.cumsum(shared) - 1
        keep = shared[at]
        column, owner = column[at][keep], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(shared.sum()), COLUMNS):
            p, q = np.searchsorted(column, (c, c + COLUMNS))
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[p:q], column[p:q] - c] = 1
            overlap += m @ m.T
        link = overlap * float(den) >= (n[:, None] + n[None, :] - overlap) * float(num)
        return _stars_of(node, _reached(link))

    return run


def _reached(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that is reachable."""
    label = np.full(len(link), -1)
    for i in range(len(link)):
        if label[i] < 0:
            front = np.array([i])
            label[i] = i
            while len(front):
                near = np.flatnonzero(link[front].any(0) & (label < 0))
                label[near] = i
                front = near
    return label


def _stars_of(node: np.ndarray, label: np.ndarray):
    """(smallest node, node) pairs of what has the same label."""
    import pyarrow as pa

    low = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(low, label, node)
    a = low[label]
    m = a != node
    return pa.table({"a": pa.array(a[m], pa.int64()), "b": pa.array(node[m], pa.int64())})


def _block_near(num: int, den: int):
    """Of two blocks' bitmaps: which sets of different components may link, as stars of what hangs together. Bitmaps are
    compared with those of their own size and of twice that, folded; sets of other sizes can't link."""

    def run(key, table):
        node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        bits = [np.frombuffer(x, np.uint64) for x in table.column("bits").to_pylist()]
        words = np.array([len(x) for x in bits])
        near = np.zeros((len(node), len(node)), bool)
        for size in np.unique(words):
            own, twice = np.flatnonzero(words == size), np.flatnonzero(words == 2 * size)
            at = np.concatenate([own, twice])
            signs = np.stack([bits[i] if words[i] == size else bits[i][:size] ^ bits[i][size:] for i in at])
            both = np.zeros((len(own), len(at)), np.float32)
            for c in range(0, size, COLUMNS // 64):
                x = np.unpackbits(signs[:, c : c + COLUMNS // 64].view(np.uint8), axis=1).astype(np.float32)
                both += x[: len(own)] @ x.T
            set_ = np.bitwise_count(signs).sum(1).astype(np.float32)
            differ = set_[: len(own), None] + set_[None, :] - 2 * both
            total = (n[own][:, None] + n[at][None, :]).astype(np.float64)
            less, more = np.minimum(n[own][:, None], n[at][None, :]), np.maximum(n[own][:, None], n[at][None, :])
            ok = (differ * float(den + num) <= total * (den - num)) & (less * den >= more * num) & (label[own][:, None] != label[at][None, :])
            near[np.ix_(own, at)] |= ok
            near[np.ix_(at, own)] |= ok.T
        return _stars_of(node, _reached(near))

    return run


def _dealt(group: DataFrame, payload: DataFrame, most) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of ``payload`` (node, n, ...) for each pair of blocks (grp, lo, hi) that their group (node, grp) is cut into,
    tables to delete). Blocks get ``most`` (of the mean n) rows, about."""
    size = group.join(payload.select("node", "n"), "node").groupBy("grp").agg(F.count("*").alias("c"), F.avg("n").alias("n"))
    size = storage.persist(size.select("grp", F.ceil(F.col("c") / most(F.col("n"))).cast("int").alias("blocks")), "blocks")
    rows = group.join(storage.small(size), "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    groups = storage.persist(rows, "groups")
    names = [c for c in payload.columns if c != "node"]
    rows = payload.join(storage.small(groups), "node").select("node", *names, "grp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return rows.select("node", *names, "grp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")), [size, groups]


def _in_blocks(groups: DataFrame, sets: DataFrame, signs: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Links among the sets of each of ``groups`` (grp, node): a group is cut into blocks of bounded size, and
    each pair of blocks is one task's work, so no group is gathered whole. Bitmaps first: what may link by these makes
    new groups, most of them small."""
    signs = signs.join(label.withColumnRenamed("label", "l"), "node", "left").select("node", "n", "bits", F.coalesce("l", "node").alias("label"))
    rows, more = _dealt(groups, signs, lambda n: F.lit(BLOCK_SIGNS))
    near = storage.persist(rows.select("node", "label", "n", "bits", "grp", "lo", "hi").groupBy("grp", "lo", "hi").applyInArrow(_block_near(num, den), "a long, b long").distinct(), "near")
    held = [*more, near, components(near)]
    rows, more = _dealt(held[-1].withColumnRenamed("label", "grp"), sets.select("node", "n", "grams"), lambda n: F.least(F.lit(BLOCK), F.greatest(F.lit(16), F.floor(F.lit(BLOCK_GRAMS) / n))))
    out = storage.persist(rows.select("node", "grams", "grp", "lo", "hi").groupBy("grp", "lo", "hi").applyInArrow(_block_links(num, den), "a long, b long").distinct(), "links")
    storage.drop(*held, *more)
    return out


def _overlaps(batches):
    import pyarrow as pa

    for b in batches:
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("na"), b.column("nb"), pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "part"])


def _near(num: int, den: int):
    """Rows whose bitmaps x and y differ in no more bits than their sets may differ in n-grams."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist())
            keep = [differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) * (den + num) <= (na + nb) * (den - num) for na, nb, x, y in n]
            yield b.select(["a", "b", "na", "nb", "keys"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sized(pairs: DataFrame, signs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, keys) of sets whose sizes and bitmaps allow a link, with na and nb; ``signs``: node, n, bits."""
    of = lambda c, bits: signs.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(bits))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return storage.persist(both.mapInArrow(_near(num, den), "a long, b long, na long, nb long, keys long"), "pairs")


def _linked(sized: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, na, nb; a persisted table), those that link, by partial overlaps summed over the fragments. A pair's
    second set goes to its first by (first set, fragment); where the pairs are few enough to be known to all tasks, that is
    the only shuffle of n-grams."""
    cut = sets.select("node", F.posexplode("grams").alias("fragment", "gram")).where(F.length("gram") > 0)
    known = storage.small(sized)
    firsts = sized.select(F.col("a").alias("node")).distinct()  # no larger than ``sized``
    right = cut.select(F.col("node").alias("b"), "fragment", F.col("gram").alias("y")).join(known, "b")
    left = cut.join(firsts if known is sized else F.broadcast(firsts), "node", "left_semi").select(F.col("node").alias("a"), "fragment", F.col("gram").alias("x"))
    both = right.join(left, ["a", "fragment"])
    part = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_overlaps, "a long, b long, na long, nb long, part long")
    total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
    return storage.persist(total.where(F.col("o") * den >= (F.col("na") + F.col("nb") - F.col("o")) * num).select("a", "b"), "links")


def _state(e: DataFrame) -> tuple[int, bool]:
    """Number of edges (u, v), and whether each u has one v and no v is a u: all are stars."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(e.select(F.col("v"), F.lit(0), F.lit(1)))
    by = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    n, open_ = by.agg(F.sum("low"), F.count_if((F.col("low") > 1) | (F.col("low") == 1) & (F.col("high") == 1))).first()
    return n or 0, not open_


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b): the smallest node reachable. Alternating large and small
    stars, each round written to the shared folder and the one before deleted. Each node's smallest neighbour comes from
    a pre-aggregated table, broadcast where the number of edges bounds its size, or else written and a side of a join that
    can be split: so a hub is no task's work."""
    e = storage.persist(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        n, done = _state(e)
        if done:
            break
        few, held = n * 64 <= storage.BROADCAST_BYTES, [e]  # two nodes an edge at most, of two numbers each

        def known(df: DataFrame) -> DataFrame:
            if few:
                return F.broadcast(df)
            held.append(storage.persist(df, "least"))
            return held[-1]

        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = known(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if not few:
            held.append(large := storage.persist(large, "edges"))
        least = known(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        e = storage.persist(small, "edges")
        storage.drop(*held)
    out = storage.persist(e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct(), "components")
    storage.drop(e)
    return out


def jaccard_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links documents whose sets of ``k``-word shingles have a Jaccard similarity of ``num / den`` or more, and returns
    (doc_id, n_shingles, component_id): the set's size and the smallest doc_id reachable by links.

    Texts that are null, empty or without words have no shingles and stand alone. Texts of any length are read whole.
    Equal sets are always linked. A doc_id that comes several times gives a row each time; its rows link as their texts
    do. Rows with a null doc_id link as others do; they are no component's id unless no other row is in it, then that id is
    null. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    prof = storage.persist(texts.mapInArrow(_profile(k), "doc_id long, node long, n long"), "profile")
    nodes = storage.persist(prof.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "nodes")
    found = _links(spark, texts, nodes, k, num, den)
    if found is not None:
        label = found.join(nodes.select("node", "rep"), "node")
        best = label.groupBy("label").agg(F.min("rep").alias("component_id"))
        label = storage.persist(label.join(best, "label").select("node", "component_id"), "labels")
        reps = nodes.join(label, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
        storage.drop(found)
    else:
        reps = nodes.select("node", F.col("rep").alias("component_id"))
    storage.release(spark)
    out = prof.join(reps, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _buckets(spark, total: int, num: int, den: int) -> int:
    per = 0.4 if num * 10 >= den * 9 else 0.8  # keys an n-gram, about
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * per / BUCKET_KEYS) + 1)


def _links(spark, texts: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(node, label) of the nodes that have candidates, None without any."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    sent = texts.mapInArrow(_send(num, den, _buckets(spark, total, num, den), False, k), _PACKED)
    tried = storage.persist(sent.groupBy("bucket").applyInArrow(_stars, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("keys")), "pairs")
    storage.release(spark)
    if tried.isEmpty():
        storage.drop(tried)
        return None
    active = storage.persist(tried.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "active")
    sets = _active_sets(texts, active, k)
    signs = storage.persist(sets.select("node", "n", "bits"), "signs")
    signed = storage.small(signs)
    sized = _sized(tried, signed, num, den)
    # each node's candidate with most keys first: most links of a group need no other pair
    best = sized.groupBy("b").agg(F.max(F.struct("keys", "a", "na", "nb")).alias("x")).select(F.col("x.a").alias("a"), "b", "x.na", "x.nb")
    best = storage.persist(best, "pairs")
    edges = _linked(best, sets, num, den)
    label = components(edges)
    storage.drop(edges)
    rest = storage.persist(_across(sized, label).join(best.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "na", "nb"), "pairs")
    label = _merged(label, _linked(rest, sets, num, den))
    storage.drop(sized, best, rest)
    storage.release(spark)
    marked = sets.join(label, "node", "left").select("grams", F.coalesce("label", "node").alias("label"))
    sent = marked.mapInArrow(_send(num, den, _buckets(spark, active.agg(F.sum("n")).first()[0], num, den), True), _PACKED)
    more = storage.persist(sent.groupBy("bucket").applyInArrow(_crosses, "a long, b long, n long").distinct(), "pairs")
    storage.release(spark)
    new = _sized(more.where(F.col("n") == COUNT).select("a", "b", F.lit(0).cast("long").alias("keys")).join(tried, ["a", "b"], "left_anti"), signed, num, den)
    alone = more.where(F.col("n") == IN_BLOCKS).select(F.col("a").alias("grp"), F.col("b").alias("node"))
    whole = more.where(F.col("n") == WHOLE).select(F.col("a").alias("grp"), F.col("b").alias("label"))
    lists = storage.persist(alone.union(label.join(whole, "label").select("grp", "node")).distinct(), "lists")
    if not new.isEmpty():
        label = _merged(label, _linked(new, sets, num, den))
    if not lists.isEmpty():
        label = _merged(label, _in_blocks(lists, sets, signs, label, num, den))
    storage.drop(tried, active, sets, signs, more, new, lists)
    return label


def _active_sets(texts: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """(node, n, bits, grams) of the active nodes, read from the texts of their smallest doc_id."""
    reps = active.select(F.col("node").alias("_node"), F.col("rep").alias("_rep"))
    own = storage.small(reps)
    if own is not reps:  # few enough to tell each task which texts to read
        texts = texts.join(storage.small(active.select(F.col("rep").alias("_rep"))), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    rows = texts.mapInArrow(_sets(k), "doc_id long, node long, n long, bits binary, grams array<binary>")
    sets = storage.persist(rows.join(own, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("node", "n", "bits", "grams"), "sets")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    once = storage.persist(sets.dropDuplicates(["node"]), "sets")  # a doc_id with one text several times
    storage.drop(sets)
    return once


def _across(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose nodes lie in different components."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def _merged(label: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels after further edges (a, b): components of the components. ``edges`` and, if it changes, ``label`` are
    deleted."""
    if edges.isEmpty():
        storage.drop(edges)
        return label
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    named = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    up = components(named)
    both = label.unionByName(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").withColumn("label", F.col("node")))
    new = storage.persist(both.join(up.select(F.col("node").alias("label"), F.col("label").alias("_up")), "label", "left").select("node", F.coalesce("_up", "label").alias("label")), "components")
    storage.drop(label, edges, up)
    return new
