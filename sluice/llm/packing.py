"""Best-two-fit packing of documents into sequences of bounded length.

Packing sees lengths only, and there are at most ``size`` of them, so the corpus comes to the driver as a histogram of
bounded size. Bins are filled greedily, the largest length that fits first; then a bin's smallest document gives way to
two unpacked ones if they fill its expanded gap more tightly. From which gap on that pays is tried, up to never (best-fit
decreasing), and the plan with fewest bins is taken. A filled bin is a pattern used as often as the histogram
allows, so the plan's size does not depend on the number of documents. Each piece knows its rank among the pieces of its
length (a running count per partition plus the counts of the partitions before), and the plan maps ranks to sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _two_fit(histogram: dict[int, int], size: int, least: float) -> list[tuple[list[int], int]]:
    """Best-two-fit, for bins whose gap is more than ``least`` of their size."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    lengths = np.arange(size + 1)
    while True:
        there = np.where(left > 0, lengths, 0)
        fits = np.maximum.accumulate(there)
        if not fits[-1]:
            return out
        bin_, gap, used = [], size, {}
        while gap:
            x = int(fits[gap])
            while x and left[x] <= used.get(x, 0):
                x = int(fits[x - 1])
            if not x:
                break
            bin_.append(x)
            used[x] = used.get(x, 0) + 1
            gap -= x
        if gap > least * size and len(bin_) > 1:
            smallest = bin_[-1]
            free = left.copy()
            for x, n in used.items():
                free[x] -= n
            room = gap + smallest
            has = np.where(free > 0, lengths, 0)
            upto = np.maximum.accumulate(has)
            a = np.flatnonzero(has[: room + 1])
            b = upto[np.minimum(room - a, a)]
            same = (b == a) & (free[a] < 2)
            b = np.where(same, upto[np.maximum(np.minimum(room - a, a - 1), 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > smallest:
                i = len(total) - 1 - int(total[::-1].argmax())  # the larger one as large as may be: small ones stay for later gaps
                bin_[-1:] = [int(a[i]), int(b[i])]
        used = {x: bin_.count(x) for x in set(bin_)}
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((bin_, times))


def _best_fit(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing: each document goes where it leaves the least room. Bins filled alike are one entry."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left -> (lengths, bins)
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        while n:
            room = min((r for r in bins if r >= x), default=size)
            if room in bins:
                pattern, count = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            else:
                pattern, count = (), n
            k = room // x
            full = min(count, n // k)
            one = n % k if count > full and n // k == full else 0  # documents that fill one more bin in part
            for times, m in ((full, k), (1 if one else 0, one)):
                if times:
                    bins.setdefault(room - m * x, []).append((pattern + (x,) * m, times))
            if pattern and (rest := count - full - bool(one)):
                bins.setdefault(room, []).append((pattern, rest))
            n -= full * k + one
    return [(list(p), n) for groups in bins.values() for p, n in groups]


#: Gaps, as shares of a bin, from which on two documents are looked for; each makes a plan.
GAPS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.05)


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, number of such bins) that use up ``histogram`` (length -> documents): of best-two-fit
    from each of GAPS on, and of greedy filling alone, the plan with fewest bins; the first of equal ones."""
    histogram = {x: n for x, n in histogram.items() if n}
    plans = [_two_fit(histogram, size, x) for x in GAPS] + [_best_fit(histogram, size)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _slots(patterns: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): keys, first rank, first sequence, offset."""
    rows, taken, base = [], {}, 0
    for bin_, times in patterns:
        at = 0
        for x in bin_:
            first = taken.get(x, 0)
            rows.append((x, first, base, at))
            taken[x] = first + times
            at += x
        base += times
    rows.sort()
    length, first, seq, at = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), (), ())))
    return (length << 44) + first, first, seq, at


def _pieces(path: str, end: int, size: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        e, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for big in batches:
            for b in slices(big):
                rows = []
                for doc, raw in zip(b.column("doc_id").to_pylist(), e.encode(b.column("text"))):
                    ids = np.append(np.frombuffer(raw, e.kind).astype("<u4"), np.uint32(end)).astype("<u4")
                    n = len(ids)
                    cut = n % size or size if n > size else n
                    p, start = 0, 0
                    while start < n:
                        stop = cut + p * size
                        length = stop - start
                        rows.append((doc, p, start, length, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[length])))
                        seen[length] += 1
                        p, start = p + 1, stop
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def _place(slots: tuple[np.ndarray, ...]):
    key, first, seq, at = slots

    def run(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(key, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq[i] + rank - first[i]), pa.array(at[i])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = 1024) -> DataFrame:
    """Packs all rows of ``docs`` (doc_id, text) and returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A document is its token ids and ``end``; a null or empty text is ``end`` alone. Documents of more than ``size`` ids
    are cut into pieces of ``size``, the first one taking what is left over, however long they are. Repeated rows are packed each time, a null
    doc_id stays null, other columns are ignored, an empty table gives an empty result. Sequence ids count from 0.
    """
    # before the plan, pieces are written once: ranks belong to that writing
    with storage.narrow_batches(docs.sparkSession):
        pieces = storage.persist(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, end, size), PIECES), "pieces")
    counts = storage.persist(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = storage.persist(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    ranked = pieces.join(storage.small(offsets), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    slots = _slots(plan(histogram, size), size)
    storage.drop(counts)
    return ranked.mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
