"""Token ids of whole texts by the tokenizers library.

Byte-level BPE cuts a text before each space and around each line end, so what stands between them is encoded alike
wherever it stands. Of such pieces, words of Latin letters are cut from the marks that follow them, which the library
does as well. Each distinct word, row of marks or other piece goes through the library once per worker, as far as the worker
remembers them; texts are then put together from their ids by Arrow. Texts with three white spaces in a row, or two at
their end, go through the library whole. Equality with the library's result on whole texts is tested.
"""

from __future__ import annotations

import numpy as np

#: Words and pieces a worker remembers.
REMEMBERED = 400_000

#: Bytes of text that ``slices`` takes at once, if one text doesn't have more.
TOGETHER = 4 << 20

#: How byte-level vocabularies write the bytes 0x20 and 0x0A.
_OPENING = ("\u0120", "\u010a")

#: What str.isspace holds for, in the syntax of Arrow's expressions, and texts that go through the library whole.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_WHITE}{{3}}|{_WHITE}{{2}}\z"
#: A word of letters that every version of Unicode has, and the marks after it.
_CUT = r"\A(?P<word>\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)(?P<marks>[!-/:-@\[-`{-~]+)\z"
_open: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.opens = np.zeros(self.library.get_vocab_size(), bool)
        self.opens[[i for x, i in self.library.get_vocab().items() if x.startswith(_OPENING)]] = True

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, or of what follows nothing."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space or begin with a line end. Many go in one call: an id whose token begins with one of these
        begins a piece."""
        plain = [not _white(x[x[:1] == "\n" :]) for x in new]
        many, out, w = [x for x, y in zip(new, plain) if y], [], self.kind.itemsize
        for i in range(0, len(many), 4000):
            part = many[i : i + 4000]
            ids = np.array(self.library.encode_batch_fast([(" " + " ".join(part)).replace(" \n", "\n")], add_special_tokens=False)[0].ids, self.kind)
            at = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * w).tolist()
            if len(at) != len(part) + 1:
                raise ValueError("pieces and their ids don't agree")
            out += map(ids.tobytes().__getitem__, map(slice, at[:-1], at[1:]))
        if len(many) == len(new):
            return out
        some, rest = iter(out), iter(self._each([x if x[:1] == "\n" else " " + x for x, y in zip(new, plain) if not y]))
        return [next(some if y else rest) for y in plain]

    def _ids(self, values, known: dict[str, bytes], learn):
        """Ids of an Arrow array of strings, each distinct one looked up once."""
        import pyarrow as pa

        coded = values.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, names))
        if None in ids:
            new = [x for x, y in zip(names, ids) if y is None]
            fresh = learn(new)
            more = iter(fresh)
            ids = [next(more) if y is None else y for y in ids]
            room = max(0, REMEMBERED - len(self.known) - len(self.marks))
            known.update(zip(new[:room], fresh))
        return pa.array(ids, pa.large_binary()).take(coded.indices)

    def _pieces(self, pieces):
        """Ids of distinct pieces that follow a space or begin with a line end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.extract_regex(pieces, _CUT)
        words = self._ids(pc.coalesce(pc.struct_field(cut, "word"), pieces), self.known, self._learn)
        marks = self._ids(pc.fill_null(pc.struct_field(cut, "marks"), ""), self.marks, self._each)
        return pc.binary_join_element_wise(words, marks, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts) -> list[bytes]:
        """The ids of each text, little-endian, in ``kind``. texts: a list or an Arrow array; null is an empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        odd = pc.match_substring_regex(rows, _ODD)
        whole = {i: self._each([rows[i].as_py()])[0] for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            rows = pc.if_else(odd, pa.scalar("", pa.large_string()), rows)
        split = pc.split_pattern(pc.replace_substring(rows, "\n", " \n"), " ")
        at, words = split.offsets.to_numpy(), split.values
        del rows, split
        head = np.zeros(len(words), bool)
        head[at[:-1]] = True
        heads = words.filter(pa.array(head)).to_pylist()  # they follow nothing
        some = list(dict.fromkeys(heads))
        begin = dict(zip(some, self._each(some)))
        words = words.filter(pa.array(~head)).dictionary_encode()
        which = np.empty(len(head), np.int64)
        which[~head], which[head] = words.indices.to_numpy(), len(words.dictionary) + np.arange(len(heads))
        ids = pa.concat_arrays([self._pieces(words.dictionary), pa.array(map(begin.get, heads), pa.large_binary())]).take(pa.array(which))
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[at].tolist() if len(ids) else []
        raw = memoryview(raw or b"")
        return [whole[i] if i in whole else raw[p:q].tobytes() for i, (p, q) in enumerate(zip(ends, ends[1:]))]


def _white(x: str) -> bool:
    return not x or x[0].isspace() or x[-1].isspace()


def slices(batch):
    """A batch's rows in their order, as many at once as have ``TOGETHER`` bytes of text: what is said once of a word holds for
    more of them, and what an encoder holds meanwhile is bounded."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    p = 0
    while p < len(ends):
        q = max(p + 1, int(np.searchsorted(ends, TOGETHER + (ends[p - 1] if p else 0), "right")))
        yield batch.slice(p, q - p)
        p = q


def encoder(path: str) -> Encoder:
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def forget() -> None:
    """Drops what this worker remembers of pieces: workers are used again by tasks that need the memory otherwise."""
    _open.clear()
