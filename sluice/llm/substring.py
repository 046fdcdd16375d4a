"""Substring dedup by hashes of lines and of parts of lines.

A text is cut at line ends, and within lines after the words that come first (marks before plain words, then by a hash)
among WINDOW words in a row of the line. So a cut depends on the words around it only, and a passage pasted into another
line is cut in the same places but for its edges. Where code points stand without spaces (CJK, runs of over LONG) each is
a word. A unit begins at a cut and ends at the first cut that makes it LEAST words or more; at the end of a line one ends that is as
short as LEAST allows. So units are lines, paragraphs of consecutive lines, or parts of lines, and overlap. Words are normalised (case, white space) and units hashed; digests
are grouped over all documents. The earliest occurrence, by (doc_id, offset), stays; the others are cut out, and their
original offsets kept.

LEAST is what makes a repeat a passage: any passage of LEAST + 2 * WINDOW words holds a whole unit, and lines that are
shorter and stand alone (a greeting, "and so on.") are no passage. With ``least=1, inline=False`` units are single lines
of any length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.shingles import mix, powers
from sluice.llm.tokens import forget

#: Words of a unit at least, and words in a row of which one at least ends a part of a line.
LEAST, WINDOW = 25, 9
#: A run without spaces of more code points than this is no word but as many words.
LONG = 32
#: Code points that a task cuts at a time, about; a longer text is cut alone.
CHUNK = 1 << 18

#: fixed values: scripts written without spaces, by first and last code point
_SCRIPTS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_MARKS = np.array(sorted(map(ord, ".,;:!?…。，、；：！？")), np.uint32)


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is white space, lower case) by code point, up to the last one that has a case."""
    n = 0x1F000
    low = np.arange(n, dtype=np.uint32)
    white = np.zeros(n, bool)
    for i in range(n):
        c = chr(i)
        white[i] = c.isspace()
        if len(x := c.lower()) == 1:
            low[i] = ord(x)
    return white, low


def _words(cp: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 code point of the words; ``edge`` has True where a text begins."""
    white, _ = _tables()
    solid = ~((cp < len(white)) & white[np.minimum(cp, len(white) - 1)])
    dense = np.zeros(len(cp), bool)
    if len(cp) and cp.max() >= _SCRIPTS[0][0]:
        for a, b in _SCRIPTS:
            dense |= (cp >= a) & (cp <= b)
    before = np.zeros(len(cp), bool)
    before[1:] = solid[:-1] & ~dense[:-1]
    start = solid & (~before | dense | edge[:-1])
    first = np.flatnonzero(start)
    closed = np.ones(len(cp) + 1, bool)
    closed[:-1] = ~solid | start
    ends = np.flatnonzero(closed)
    last = ends[np.searchsorted(ends, first, "right")] if len(first) else first
    if len(first) and (last - first).max() > LONG:
        long = last - first > LONG
        more = np.concatenate([np.arange(a, b) for a, b in zip(first[long], last[long])])
        first = np.concatenate([first[~long], more])
        last = np.concatenate([last[~long], more + 1])
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
    return first, last


def _sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the ranges a to b of a sequence: equal sequences, equal hashes."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _ends(word: np.ndarray, mark: np.ndarray, line: np.ndarray, inline: bool) -> np.ndarray:
    """The words after which a cut is."""
    cut = np.ones(len(word), bool)
    cut[:-1] = line[1:] != line[:-1]
    if inline and len(word) >= WINDOW:
        before = np.zeros(len(word), np.uint64)
        before[1:] = np.where(cut[:-1], np.uint64(0), word[:-1])
        rank = mix(word + mix(before + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(1) | np.where(mark, 0, 1).astype(np.uint64) << np.uint64(63)
        rows = np.lib.stride_tricks.sliding_window_view(rank, WINDOW)
        at = np.arange(len(rows)) + WINDOW - 1 - np.argmin(rows[:, ::-1], axis=1)
        cut[at[line[: len(rows)] == line[WINDOW - 1 :]]] = True
    return np.flatnonzero(cut)


def units(texts: list[str], least: int = LEAST, inline: bool = True) -> tuple[np.ndarray, ...]:
    """(text, start, end, high, low) of the units of some texts: offsets in code points, and 96 bits of digest. White
    space after a unit belongs to it, the break after a line doesn't."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.cumsum([0, *map(len, texts)])
    edge = np.zeros(len(cp) + 1, bool)
    edge[off] = True
    first, last = _words(cp, edge)
    if not len(first):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int32))
    low = _tables()[1]
    text = np.searchsorted(off, first, "right") - 1
    breaks = np.flatnonzero(cp == 10)
    line = np.searchsorted(breaks, first) + text
    word = _sums(mix(np.where(cp < len(low), low[np.minimum(cp, len(low) - 1)], cp).astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D)), first, last)
    ends = _ends(word, np.isin(cp[last - 1], _MARKS), line, inline)
    begin, least = np.append(0, ends[:-1] + 1), max(1, least)
    i, to = np.arange(len(ends)), np.searchsorted(ends, begin + least - 1)
    # the end of a line ends a unit too, even if none that begins at a cut has just its size
    line_end = np.flatnonzero(np.append(line[1:] != line[:-1], True)[ends])
    back = np.searchsorted(begin, ends[line_end] + 1 - least, "right") - 1
    pair = np.concatenate([i * (len(ends) + 1) + to, (back * (len(ends) + 1) + line_end)[back >= 0]])
    i, to = np.divmod(np.unique(pair), len(ends) + 1)
    there = to < len(ends)
    begin, to = begin[i[there]], ends[to[there]]
    same = text[begin] == text[to]
    begin, to = begin[same], to[same]
    # a unit ends where its line ends, or where the next word begins
    stop = np.append(breaks, len(cp))[np.searchsorted(breaks, last[to])]
    stop = np.minimum(stop, off[text[to] + 1])
    follows = np.append(first, len(cp))[to + 1]
    high = _sums(word, begin, to + 1).view(np.int64)
    other = _sums(mix(word ^ np.uint64(0x9FB21C651E98DF25)), begin, to + 1)
    return text[begin], first[begin] - off[text[begin]], np.minimum(stop, follows) - off[text[to]], high, (other >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hash(least: int, inline: bool):
    def run(batches):
        import pyarrow as pa

        forget()
        for b in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
            rank, key, text = (b.column(c).to_pylist() for c in ("rank", "key", "text"))
            i = 0
            while i < len(text):
                j, held = i, 0
                while j < len(text) and (j == i or held + len(text[j]) <= CHUNK):
                    held += len(text[j])
                    j += 1
                at, start, end, high, low = units(text[i:j], least, inline)
                cols = [pa.array(np.array(rank[i:j], np.int64)[at]), pa.array(np.array(key[i:j], np.int64)[at]), pa.array(start << 32 | end), pa.array(high), pa.array(low)]
                yield pa.RecordBatch.from_arrays(cols, names=["rank", "key", "span", "high", "low"])
                i = j

    return run


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, sorted, those that touch as one. Offsets are below 2 ** 32."""
    if not len(row):
        return row, start, end
    order = np.lexsort((end, start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    reach = np.maximum.accumulate(row << 32 | end)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] << 32 | start[1:]) > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(row)) - 1
    return row[new], start[new], reach[last] & 0xFFFFFFFF


def _merge(batches):
    import pyarrow as pa

    for b in batches:
        spans = b.column("spans")
        flat, n = spans.flatten(), np.diff(spans.offsets.to_numpy())
        row, start, end = merged(np.repeat(np.arange(len(n)), n), *(flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(n)))).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column("rank"), b.column("key"), out], names=["_rank", "_key", "_spans"])


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; a line that is cut away wholly goes with its line break."""
    keep, at, whole = [], 0, True  # whole: nothing of this line is kept so far
    for s, e in sorted(spans):
        if kept := text[at:s]:
            keep.append(kept)
            whole = kept.rpartition("\n")[2] == "" and "\n" in kept or whole and not kept.strip(" \t")
        if whole and text[e : e + 1] == "\n":
            e += 1
        elif e > s and whole and e == len(text) and keep and keep[-1].endswith("\n"):
            keep[-1] = keep[-1][:-1]
        at = max(at, e)
    keep.append(text[at:])
    return "".join(keep)


def _apply(fields: list[str], text_at: int, spans_at: int):
    def run(batches):
        import pyarrow as pa

        for b in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
            spans = b.column(spans_at).to_pylist()
            text = [cut(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in zip(b.column(text_at).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if i == text_at else b.column(i) for i in range(len(fields))], names=fields)

    return run


#: Where rows without a doc_id stand in the order: behind all others.
_LAST = (1 << 63) - 1


def dedup_substrings(docs: DataFrame, least: int = LEAST, inline: bool = True) -> DataFrame:
    """``docs`` with repeated units cut out of ``text``, and ``removed``: their (start, end) in the original text, merged.

    Units that come several times stay in the document of the smallest doc_id, at the smallest offset. Rows of one doc_id
    with different texts are documents of their own, in an order by a hash of the text; rows that repeat doc_id and text
    tie: they are cut alike, and what they share with each other alone stays in each. Rows without a doc_id come after all
    others. Null and empty texts, and texts of fewer than ``least`` words, stay as they are; long ones are read whole.
    Documents cut away wholly stay with an empty text. All columns are kept, whatever their names; one named removed
    is replaced; an empty table gives an empty result.
    """
    docs = docs.drop("removed")
    rank, key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = docs.select(rank.alias("rank"), key.alias("key"), "text").where("text IS NOT NULL")
    # span: start and end in one number, which orders as they do; rows are many, and each column takes eight bytes in a
    # shuffle. Digests alone first; joins shuffle at every size, so that cost grows in proportion
    hashed = storage.persist(found.mapInArrow(_hash(least, inline), "rank long, key long, span long, high long, low int"), "units")
    twice = storage.persist(hashed.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "repeats")
    storage.release(docs.sparkSession)
    repeats = storage.persist(hashed.join(twice.hint("merge"), ["high", "low"]), "repeats")
    storage.drop(hashed, twice)
    storage.release(docs.sparkSession)
    first = storage.persist(repeats.groupBy("high", "low").agg(F.min(F.struct("rank", "key", "span")).alias("first")), "first")
    later = repeats.join(first.hint("merge"), ["high", "low"]).where(F.struct("rank", "key", "span") > F.col("first"))
    # a unit that overlaps with its own first occurrence goes without what that one keeps
    own = (F.col("rank") == F.col("first.rank")) & (F.col("key") == F.col("first.key"))
    start_of, end_of = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    start = F.when(own, F.greatest(start_of("span"), end_of("first.span"))).otherwise(start_of("span"))
    spans = later.select("rank", "key", start.alias("start"), end_of("span").alias("end")).where("start < end").groupBy("rank", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = storage.persist(spans.mapInArrow(_merge, "_rank long, _key long, _spans array<struct<start:int,end:int>>"), "spans")
    storage.drop(repeats, first)
    storage.release(docs.sparkSession)
    # names of the input may be any: everything travels as one struct
    rows = docs.select(F.struct("*").alias("_row"), rank.alias("_rank"), key.alias("_key")).join(storage.small(spans), ["_rank", "_key"], "left")
    removed = F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int>>"))
    fields = docs.columns
    flat = rows.select(*[F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(fields)], removed.alias("removed"))
    names = flat.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    out = flat.mapInArrow(_apply(names, fields.index("text"), len(fields)), schema)
    return out.toDF(*fields, "removed")
