"""Toxicity by a grammar of weighted finite-state transducers.

A lexicon transducer reads a word's letters and writes its class: insult, threat, target, intent, negation, reported
speech, or nothing. A clause is the tape of its words' classes. Five transducers are composed over it: threats (a threat
word counts after an intent and with a target, before it or to come), targets (an insult near a target is aimed and
weighs more), negations (what follows one soon weighs less), reported speech (what stands in quotes of a clause that
reports weighs less, wherever the reporting word stands) and insults (which counts hits: the first one of a clause weighs
less if nothing aims it). A hit weighs nothing rather than less than nothing. The best path's weight is the clause's, and
a document's score comes from the sum of its clauses.

The lexicon starts from fixed words; stems of insults and their weights are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import storage
from sluice.llm.tokens import forget
from sluice.llm.transducers import Cascade, Lexicon, Machine

#: Labelled rows of either kind that learning sees at most, the first by a hash of their id.
TOXIC_ROWS, CLEAN_ROWS = 2000, 6000
#: Stems are of so many letters, and learned from so many distinct surroundings at least.
STEM = range(3, 9)
SUPPORT = 3
#: ... and from such a share of the toxic rows.
SHARE = 0.01
#: A learned stem's share of clean rows, against its share of toxic ones, at most.
LEAK = 0.02
#: Learned stems that are kept, the heaviest first.
STEMS = 4000
#: Texts that a task holds as Python strings at a time.
SLICE = 500

# fixed values: words of the grammar
INSULTS = {w: 3.0 for w in ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin")}
THREATS = {"kill": 2.0, "hurt": 1.5, "destroy": 1.5, "murder": 2.0, "beat": 1.0, "burn": 1.0, "shoot": 1.5}
TARGETS = {"you", "your", "yourself", "they", "them", "he", "him", "she", "her", "these", "those", "people"}
WILL = {"will", "gonna", "going", "shall", "must", "should"}
NEGATIONS = {"not", "never", "no", "isn't", "aren't", "wasn't", "don't", "won't", "nobody"}
REPORTS = {"said", "says", "say", "called", "wrote", "claimed", "quoted", "allegedly", "reportedly", "according"}

#: A mark ends a clause; words are runs of letters with inner apostrophes.
_token = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]|[\"“”«»]")
#: Words within which a cue reaches a hit, and what it adds to the hit's weight.
NEAR = 4
AIMED, NEGATED, REPORTED, ALONE = 0.6, -2.0, -2.0, -0.5

#: Symbols of the tapes: other word, insult, threat, target, intent, negation, reporting word, quote; an aimed insult, a
#: threat that is one, and a hit.
SYMBOLS = "oihtwnrqIHx"


def _choices() -> Machine:
    """A hit stays, or is passed over where it would weigh less than nothing."""
    return Machine(0, SYMBOLS, lambda s, x: [(x, 0.0, 0), ("o", 0.0, 0)] if x in "ih" else [(x, 0.0, 0)])


def _threats() -> Machine:
    """h becomes H within NEAR words after an intent, if a target stands within NEAR before it or comes within NEAR;
    otherwise nothing. State: words that intent, target and the wait for a target still reach."""

    def rule(state, x):
        will, target, wait = state
        if wait == 1 and x != "t":
            return  # no target came: this was a wrong guess
        after = (NEAR if x == "w" else max(0, will - 1), NEAR if x == "t" else max(0, target - 1), 0 if x == "t" else max(0, wait - 1))
        if x != "h":
            yield x, 0.0, after
            return
        yield "o", 0.0, after
        if will and target:
            yield "H", 0.0, after
        elif will:
            yield "H", 0.0, (after[0], after[1], after[2] or NEAR)

    return Machine((0, 0, 0), SYMBOLS, rule, lambda s: s[2] == 0)


def _targets() -> Machine:
    """i becomes I near a target. State: words that a target before, and the wait for one to come, still reach."""

    def rule(state, x):
        target, wait = state
        if wait == 1 and x != "t":
            return
        after = (NEAR if x == "t" else max(0, target - 1), 0 if x == "t" else max(0, wait - 1))
        if x == "i" and target:
            yield "I", AIMED, after
            return
        yield x, 0.0, after
        if x == "i":
            yield "I", AIMED, (after[0], after[1] or NEAR)

    return Machine((0, 0), SYMBOLS, rule, lambda s: s[1] == 0)


def _negations() -> Machine:
    """State: words that a negation still reaches."""

    def rule(state, x):
        yield x, NEGATED if state and x in "iIH" else 0.0, NEAR if x == "n" else max(0, state - 1)

    return Machine(0, SYMBOLS, rule)


def _reports() -> Machine:
    """State: within quotes or not; and whether a reporting word stood, will come or won't, which is guessed where
    quotes open before any, and a wrong guess has no arc."""

    def rule(state, x):
        quoted, said = state
        if x == "r":
            if said != "won't":
                yield x, 0.0, (quoted, "stood")
        elif x == "q":
            for guess in ("will", "won't") if said == "open" else (said,):
                yield x, 0.0, (not quoted, guess)
        else:
            yield x, REPORTED if quoted and x in "iIH" and said in ("stood", "will") else 0.0, state

    return Machine((False, "open"), SYMBOLS, rule, lambda s: s[1] != "will")


def _insults() -> Machine:
    """Hits become x. State: whether the clause had one."""

    def rule(state, x):
        if x not in "iIH":
            yield x, 0.0, state
            return
        yield "x", ALONE if x == "i" and not state else 0.0, True

    return Machine(False, SYMBOLS, rule)


#: The transducers in the order of their composition; without _insults nothing counts.
PARTS = {"threats": _threats, "targets": _targets, "negations": _negations, "reports": _reports, "insults": _insults}


@lru_cache(None)
def cascade(without: str = "") -> Cascade:
    """The composition, or without one of PARTS: its hits then pass as they are (threats without a condition)."""
    return Cascade([_choices()] + [Machine(0, SYMBOLS, lambda s, x: [("H" if x == "h" and name == "threats" else x, 0.0, 0)]) if name == without else make() for name, make in PARTS.items()])


@dataclass
class Grammar:
    """Weights. ``stems``: stem -> weight; ``bias`` and ``scale`` turn a sum of clauses into a score; ``without``
    names a transducer that is left out."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    scale: float = 1.0
    without: str = ""
    _seen: dict[str, tuple | None] = field(default_factory=dict, repr=False)
    _lexicon: Lexicon | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_lexicon": None}

    def read(self, word: str) -> tuple[str, float] | None:
        """(symbol, weight) of a word, or None."""
        try:
            return self._seen[word]
        except KeyError:
            pass
        if self._lexicon is None:
            words = {w: (x, 0.0) for x, them in (("t", TARGETS), ("w", WILL), ("n", NEGATIONS), ("r", REPORTS)) for w in them}
            words |= {q: ("q", 0.0) for q in "\"“”«»"} | {w: ("h", v) for w, v in THREATS.items()} | {w: ("i", v) for w, v in INSULTS.items() if w not in self.stems}
            self._lexicon = Lexicon(words, {w: ("i", v) for w, v in self.stems.items()})
        out = self._lexicon.read(word)
        if len(self._seen) < 100_000:
            self._seen[word] = out
        return out

    def clauses(self, text: str) -> list[float]:
        """Weights of the clauses that match."""
        tokens = _token.findall(text.lower())
        read, seen = self.read, self._seen
        hits = [i for i, t in enumerate(tokens) if (x := seen[t] if t in seen else read(t)) and x[0] in "ih"]
        out, at, machine = [], 0, cascade(self.without)
        while at < len(hits):
            start = end = hits[at]
            while start > 0 and tokens[start - 1] not in ".!?;\n":
                start -= 1
            while end < len(tokens) and tokens[end] not in ".!?;\n":
                end += 1
            while at < len(hits) and hits[at] < end:
                at += 1
            weight = machine.best([read(t) or ("o", 0.0) for t in tokens[start:end]], "x")
            if weight:
                out.append(weight)
        return out

    def score(self, text: str | None) -> float:
        """From 0 to 1; 0.5 and more is toxic. Null and empty texts get the score of no match."""
        total = sum(self.clauses(text)) if text else 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.scale * total))))


def stem_counts(rows) -> list[tuple[str, int, int, int]]:
    """(stem, around, toxic rows, clean rows) of (text, toxic) rows. A row counts a stem once; ``around`` tells the
    toxic rows' neighbour words of its first place apart, so copies of one text don't make a stem."""
    n: Counter = Counter()
    for text, toxic in rows:
        words = _token.findall((text or "").lower())
        own: dict[str, int] = {}
        for i, w in enumerate(words):
            if len(w) >= STEM[0] and w[: STEM[-1]] not in own:
                around = hash_of(words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "") if toxic else 0
                for k in STEM:
                    if len(w) < k:
                        break
                    own.setdefault(w[:k], around)
        n.update((s, around, bool(toxic)) for s, around in own.items())
    return [(s, around, c if toxic else 0, 0 if toxic else c) for (s, around, toxic), c in n.items()]


def hash_of(a: str, b: str) -> int:
    import zlib

    return zlib.crc32(f"{a} {b}".encode())


def choose_stems(candidates: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems and weights from (stem, toxic rows, clean rows) of stems with enough support."""
    n, found = {}, {}
    for s, a, b in candidates:
        n[s] = a
        # log odds, with the lower end of what the count of toxic rows may stand for
        found[s] = min(6.0, math.log(((a - math.sqrt(a) / 2) / max(1, n_toxic) + 1e-4) / (b / max(1, n_clean) + 1e-4)))
    children = defaultdict(list)
    for s in n:
        children[s[:-1]].append(s)
    stems = {}
    for s, w in found.items():
        if any(s[:k] in found for k in STEM if k < len(s)):
            continue
        # a stem is as long as nearly all rows that have it allow
        while next_ := [c for c in children[s] if n[c] >= 0.95 * n[s]]:
            s = max(next_, key=lambda c: (n[c], c))
        stems[s] = w
    return dict(sorted(stems.items(), key=lambda x: (-x[1], x[0]))[:STEMS])


def bias_of(totals: list[tuple[float, int]]) -> float | None:
    """The bias that puts 0.5 where most of (sum of clauses, toxic) are right; the highest one of several."""
    totals = sorted(totals)
    best, at, right = -1, 1.0, sum(y for _, y in totals)
    if not right or right == len(totals):
        return None
    for i in range(len(totals) + 1):
        edge = i in (0, len(totals)) or totals[i][0] > totals[i - 1][0]
        if edge and right > best and 0 < i:
            best = right
            at = (totals[i - 1][0] + totals[i][0]) / 2 if i < len(totals) else totals[-1][0] + 1
        if i < len(totals):
            right += 1 - 2 * totals[i][1]
    return -max(0.05, at)


def held_out():
    """Rows whose labels learning never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def _stem_rows(batches):
    import pyarrow as pa

    for b in (big.slice(i, SLICE) for big in batches for i in range(0, big.num_rows, SLICE)):
        rows = stem_counts(zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["stem", "around", "toxic", "clean"])


def _totals(grammar: Grammar):
    def run(batches):
        import pyarrow as pa

        for b in (big.slice(i, SLICE) for big in batches for i in range(0, big.num_rows, SLICE)):
            total = [sum(grammar.clauses(t)) if t else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), b.column("toxic")], names=["total", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, without: str = "") -> Grammar:
    """Learns from at most TOXIC_ROWS and CLEAN_ROWS labelled documents, none of them held out. Their texts stay on the
    executors: stems' counts that have support, and a number for each row, come to the driver. A document that is
    labelled several times is toxic if one label says so."""
    known = labels.select(F.col("doc_id").cast("long"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = storage.persist(part(1, TOXIC_ROWS).unionByName(part(0, CLEAN_ROWS)), "chosen")
    rows = storage.persist(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "labelled")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}  # two rows
    toxic, clean = n.get(1, 0), n.get(0, 0)
    grammar = Grammar(without=without)
    if toxic:
        least = max(SUPPORT, int(SHARE * toxic))
        counts = rows.mapInArrow(_stem_rows, "stem string, around long, toxic long, clean long").groupBy("stem", "around").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        counts = counts.groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"), F.count_if(F.col("toxic") > 0).alias("places"))
        counts = counts.where((F.col("a") >= least) & (F.col("places") >= least) & (F.col("b") * toxic <= LEAK * F.col("a") * max(1, clean)))
        grammar.stems = choose_stems([tuple(r) for r in counts.select("stem", "a", "b").orderBy(F.desc("a"), "stem").limit(64 * STEMS).collect()], toxic, clean)
    if toxic or clean:
        bias = bias_of([tuple(r) for r in rows.mapInArrow(_totals(grammar), "total double, toxic int").collect()])
        grammar.bias = grammar.bias if bias is None else bias
    storage.drop(chosen, rows)
    return grammar


def _scores(grammar: Grammar, text_at: int):
    """Of struct columns row, whose field ``text_at`` is the text."""

    def run(batches):
        import pyarrow as pa

        forget()
        for big in batches:
            for i in range(0, big.num_rows, SLICE):
                row = big.column(0).slice(i, SLICE)
                s = [grammar.score(t) for t in row.field(text_at).to_pylist()]
                yield pa.RecordBatch.from_arrays([row, pa.array(s, pa.float64())], names=["row", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, without: str = "", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and the prediction (1 from 0.5 on), in columns called ``names``; columns of these
    names are replaced, all others are kept.

    Only the text is read for a score. Null and empty texts score as texts without a match, long ones are read whole;
    repeated rows score alike; labels that are null or missing teach nothing, and without any the fixed words alone
    decide. ``without`` leaves one of PARTS out. An empty table gives an empty result.
    """
    docs = docs.drop(*names)
    grammar = fit(docs, labels, without)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = docs.select(row.alias("row"))
    out = out.mapInArrow(_scores(grammar, docs.columns.index("text")), f"row {out.schema['row'].dataType.simpleString()}, score double")
    kept = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*kept, F.col("score").alias(names[0]), (F.col("score") >= 0.5).cast("int").alias(names[1]))
