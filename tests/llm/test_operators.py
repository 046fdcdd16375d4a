import base64
import hashlib
import io
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontaminate, html_extract, media_gif, packing, substring, token_store, tokens, toxicity, url_filter, warc
from sluice.llm.queries import tokenizer_path
from sluice.llm.tokens import encoder

TEXTS = [(1, "Hello world, it's fine."), (2, None), (3, ""), (4, "  two  spaces\n\n \nand é中 lines "), (5, "word " * 900), (5, "word " * 900), (7, "x" * 3000), (-3, "negative id")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", f"s{i}", "clash") for i, t in rows], "doc_id long, text string, lang string, score string, removed string").repartition(3)


def empty(spark):
    return docs(spark).limit(0)


# -- tokens, packing, store --------------------------------------------------------------------------------------------


def library_ids(text, end):
    e = encoder(tokenizer_path())
    return e.library.encode(text or "", add_special_tokens=False).ids + [end]


def test_encoder_equals_the_library_on_whole_texts():
    e, r = encoder(tokenizer_path()), random.Random(3)
    texts = ["".join(r.choice(" \n\ta bÉ1,.'s  x  中é!?\r\xa0") for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts += ["<|endoftext|> a <|endoftext|>", " ", "  ", "\n \n x", "a   b", "it's  we're"]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_goes_through_the_library_once_whatever_marks_follow():
    class Counting:
        def __init__(self, library):
            self.library, self.n = library, 0

        def __getattr__(self, name):
            def run(x, **options):
                self.n += len(x) if isinstance(x, str) else sum(map(len, x))
                return getattr(self.library, name)(x, **options)

            return run

    e, r = tokens.Encoder(tokenizer_path()), random.Random(4)
    words = ["".join(r.choice("abdeinorstéß") for _ in range(9)) for _ in range(200)]
    marks = ["", ",", ".", ";", "!", "?", ".,", "%%%", "###", '"', ")", "'", "...", ".***"]
    texts = [" ".join(w + m for w in words) for m in marks] + ["".join(w + m + "\n" for w in words) for m in marks]
    e.library = count = Counting(library := e.library)
    got = [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    # each word after a space and after a line end; before, once for each row of marks and each word on the next line
    assert count.n < 3 * sum(len(w) + 1 for w in words) < sum(map(len, texts)) // 8


def test_encoder_on_odd_characters():
    e, r = tokens.Encoder(tokenizer_path()), random.Random(5)
    odd = [" "] * 6 + ["\n"] * 3 + list("\t\r\x0b\x1c\x85\xa0\u2003\u2028\u3000\u200b\u180e\x00abcABC.,!'\"-_<|>~1½²€ªºµǅɏɐ中д") + ["'s", "'ll", "th", "ing", "é", "ß", "<|endoftext|>"]
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(30))) for _ in range(6000)]
    want = [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, e.kind).tolist() for x in e.encode(texts)] == want
    import pyarrow as pa
    import pyarrow.compute as pc

    b = pa.RecordBatch.from_arrays([pa.array(texts + [None])], names=["text"])
    assert [np.frombuffer(x, e.kind).tolist() for s in tokens.slices(b) for x in e.encode(s.column("text"))] == [*want, []]
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) <= 0xDFFF]
    white = pc.match_substring_regex(pa.array(every), rf"\A{tokens._WHITE}\z").to_pylist()
    assert [c for c, x in zip(every, white) if x] == [c for c in every if c.isspace()]


def test_slices_take_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "TOGETHER", 10)
    for rows in ([], [None], ["x" * 40], ["", None, "ab", "x" * 10, "é" * 6, "x" * 30, "", "abc", "abc", "abcde", "", "f"]):
        parts = [s.column("text").to_pylist() for s in tokens.slices(pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"]))]
        assert [x for p in parts for x in p] == rows and all(len(p) == 1 or sum(len((x or "").encode()) for x in p) <= 10 for p in parts)


def test_plan_uses_everything_and_fits():
    r = random.Random(1)
    for _ in range(5):
        h = {r.randrange(1, 1025): r.randrange(1, 400) for _ in range(r.choice([1, 3, 50, 400]))}
        p = packing.plan(h, 1024)
        used = {}
        for bin_, n in p:
            assert sum(bin_) <= 1024
            for x in bin_:
                used[x] = used.get(x, 0) + n
        assert used == h
        lower = -(-sum(k * v for k, v in h.items()) // 1024)
        assert lower <= sum(n for _, n in p) <= best_fit_decreasing([k for k, v in h.items() for _ in range(v)], 1024)


def best_fit_decreasing(lengths, size):
    """Bins that plain best-fit decreasing needs, document by document."""
    import bisect

    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else size
        bins += room == size
        if room > x:
            bisect.insort(rooms, room - x)
    return bins


def test_greedy_filling_is_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(40):
        h = {r.randrange(1, 65): r.randrange(1, 40) for _ in range(r.choice([1, 2, 5, 30]))}
        p = packing._best_fit(h, 64)
        used = {}
        for bin_, n in p:
            assert n > 0 and 0 < sum(bin_) <= 64
            for x in bin_:
                used[x] = used.get(x, 0) + n
        assert used == h and sum(n for _, n in p) == best_fit_decreasing([k for k, v in h.items() for _ in range(v)], 64)


def test_two_documents_take_the_place_of_the_smallest():
    # greedily 60 + 30 leaves 10; 20 + 20 in place of 30 leave nothing
    p = packing._two_fit({60: 1, 30: 1, 20: 2}, 100, 0.0)
    assert ([60, 20, 20], 1) in p and sum(n for _, n in p) == 2


def test_pack(spark):
    rows = TEXTS + [(100 + i, "some words here " * (i % 40)) for i in range(200)]
    out = packing.pack(docs(spark, rows), tokenizer_path(), end=2, size=64).collect()
    want = sorted((d, tuple(library_ids(t, 2))) for d, t in rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    for d in {x for x, _ in want}:
        ids = next(i for x, i in want if x == d)
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by[d]})
        assert [p[1] for p in pieces] == [sum(q[2] for q in pieces[:i]) for i in range(len(pieces))] and sum(p[2] for p in pieces) == len(ids)
        assert all(p[3] == zlib.crc32(np.array(ids[p[1] : p[1] + p[2]], "<u4").tobytes()) for p in pieces)
        assert len(pieces) == 1 or all(p[2] == 64 for p in pieces[1:])
    assert len(out) == sum(-(-len(i) // 64) for _, i in want)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(empty(spark), tokenizer_path(), 2).collect() == []


def test_perfect_hash():
    keys = token_store.key_of(np.arange(20000), np.zeros(20000, np.int64))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(20000)) and (h.find(keys) >= 0).all()
    other = token_store.key_of(np.arange(50000, 60000), np.zeros(10000, np.int64))
    assert (h.find(other) < 0).sum() >= 9999
    import pyarrow as pa

    class Counting:
        def __init__(self, data):
            self.file, self.n = pa.BufferReader(data), 0

        def read_at(self, n, at):
            self.n += n
            return self.file.read_at(n, at)

    data = token_store.dump_index(h, {"x": np.arange(20000)})
    again = token_store.IndexFile(Counting(data))
    assert (again.find(keys) == h.find(keys)).all() and again.take("x", np.array([5])).tolist() == [5]
    few = token_store.IndexFile(file := Counting(data))
    assert (few.find(keys[:20]) == h.find(keys[:20])).all() and (few.find(other[:20]) < 0).all() and not few.arrays or file.n < len(data) // 4
    assert file.n < 20_000 < len(data)


def test_token_store(spark, monkeypatch):
    s = token_store.write_store(docs(spark), tokenizer_path(), end=0)
    got = sorted(tuple(r) for r in s.read(s.find(s.entries)).collect())
    want, at, seen = [], 0, {}
    for d, t in sorted(TEXTS, key=lambda x: x[0]):
        ids = library_ids(t, 0)
        want.append((d, seen.get(d, 0), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        seen[d] = seen.get(d, 0) + 1
        at += len(ids)
    assert got == sorted(want)
    keys = spark.createDataFrame([(999, 0), (1, 0)], "doc_id long, copy long")
    assert [r.doc_id for r in s.find(keys).collect()] == [1]
    null = token_store.write_store(docs(spark, [(None, "a b"), (None, "c"), (1, "d")]), tokenizer_path(), end=0)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in null.read(null.find(null.entries)).collect()) == [(-1, 2), (-1, 3), (1, 2)]
    monkeypatch.setattr(token_store, "SHARD_BYTES", 200)
    rows = [(7, f"text {i} " * (i % 9)) for i in range(60)] + [(None, f"n{i}") for i in range(30)] + [(8, "end")]
    many = token_store.write_store(docs(spark, rows), tokenizer_path(), end=0)
    out = many.read(many.find(many.entries)).collect()
    assert many.shards.count() > 3 and len(out) == 91 and sorted(r.copy for r in out if r.doc_id == 7) == list(range(60)) and sorted(r.copy for r in out if r.doc_id is None) == list(range(30))
    assert sorted(r.n_tokens for r in out if r.doc_id == 7) == sorted(len(library_ids(t, 0)) for d, t in rows if d == 7)
    out.sort(key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:])) and [r.doc_id for r in out] == [None] * 30 + [7] * 60 + [8]
    none = token_store.write_store(empty(spark), tokenizer_path(), end=0)
    assert none.read(none.find(none.entries)).collect() == []


# -- media -------------------------------------------------------------------------------------------------------------


def test_lzw_round_trips():
    for n in (64, 6400, 64 * 1024 * 2 + 64):
        for p in (os.urandom(n), bytes(n), (b"abcab" * n)[:n]):
            frames, _ = media_gif.decode(media_gif.encode(p, n))
            assert b"".join(f.samples[:, :, 0].tobytes() for f in frames) == p


def test_gif_rules():
    def image(x, y, w, h, data, control=b"", flags=0):
        return control + b"\x2c" + x.to_bytes(2, "little") + y.to_bytes(2, "little") + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([flags]) + b"\x08" + media_gif._blocks(media_gif.lzw_encode(data))

    head = b"GIF89a" + bytes([2, 0, 8, 0, 0xF7, 0, 0]) + bytes(x for i in range(256) for x in (i, 0, 255 - i))
    gce = lambda disposal, delay, clear=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0])
    g = head + image(0, 0, 2, 8, bytes(range(1, 17)), gce(1, 5)) + image(0, 0, 1, 1, b"\x63", gce(3, 7)) + image(1, 0, 1, 2, b"\x09\x0a", gce(2, 1, 9)) + image(0, 0, 2, 8, bytes(range(1, 17)), gce(0, 1), 0x40) + b"\x3b"
    f, _ = media_gif.decode(g)
    assert f[0].canvas[0, 0].tolist() == [1, 0, 254] and [x.start_ms for x in f] == [0, 50, 120, 130]
    assert f[1].canvas[0, 0, 0] == 0x63 and f[2].canvas[0, 0, 0] == 1  # the third disposal brings back what was there
    assert f[2].canvas[0, 1, 0] == 2 and f[2].canvas[1, 1, 0] == 10  # index 9 is transparent
    assert f[3].canvas[4, 0, 0] == 3 and f[3].canvas[0, 0, 0] == 1  # interlaced rows
    assert sum(media_gif.histogram(f[0].canvas)) == 3 * 16
    with pytest.raises(ValueError):
        media_gif.decode(b"PNG" * 10)


def test_damaged_media_raise():
    whole = media_gif.encode(bytes(range(256)) * 300, 5)
    media_gif.decode(whole)
    for cut in (0, 5, 12, 300, 781, 800, 830, 2000, len(whole) - 2, len(whole) - 1):
        with pytest.raises(ValueError):
            media_gif.decode(whole[:cut])
    with pytest.raises(ValueError):
        media_gif.decode(whole[:-1] + b"!")
    for bad in ([256, 300], [257], [256, 65, 300], [256, 65, 66, 257]):  # unknown codes; ends before all samples
        bits = sum(c << 9 * i for i, c in enumerate(bad))
        with pytest.raises(ValueError):
            media_gif.lzw_decode(bits.to_bytes(-(-9 * len(bad) // 8), "little"), 8, 3)
    assert media_gif.lzw_decode((256 | 65 << 9 | 258 << 18 | 257 << 27).to_bytes(5, "little"), 8, 3) == b"AAA"


def plain_decode(data, bits, most):
    """LZW by the book: a code at a time."""
    n, at, out = int.from_bytes(data, "little"), 0, b""
    clear = 1 << bits
    table, width, before = None, bits + 1, None
    while True:
        code, at = n >> at & (1 << width) - 1, at + width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [None, None], bits + 1, None
        elif code == clear + 1:
            return out[:most]
        else:
            entry = table[code] if code < len(table) else before + before[:1]
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            out, before = out + entry, entry
            if len(table) == 1 << width and width < 12:
                width += 1


def test_lzw_against_a_plain_decoder():
    r = random.Random(5)
    for n in (1, 64, 5000, 40000):
        data = bytes(r.choice(b"abcdefgh    \n") if r.random() < 0.9 else r.randrange(256) for _ in range(n))
        assert plain_decode(media_gif.lzw_encode(data), 8, n) == data == media_gif.lzw_decode(media_gif.lzw_encode(data), 8, n)


def test_media(spark):
    assert media_gif.read(media_gif.store(docs(spark, [(None, None)]))).first().n_bytes == 0
    assert packing.pack(docs(spark, [(None, "a"), (None, None)]), tokenizer_path(), 2).count() == 2
    out = {(r.doc_id, r.n_bytes): r for r in media_gif.read(media_gif.store(docs(spark))).collect()}
    for d, t in TEXTS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = out[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and len(r.frames) >= 1
        want = [sum(x // 16 == i for x in p) for i in range(16)]
        assert r.red == r.green == r.blue == want and [sum(f.histogram[i] for f in r.frames) for i in range(16)] == want
        assert r.feature == f"frames={len(r.frames)};ms={100 * len(r.frames)};" + ";".join(f"{c}={','.join(map(str, want))}" for c in ("red", "green", "blue"))
        assert [f.start_ms for f in r.frames] == [100 * i for i in range(len(r.frames))] and r.media_bytes > r.payload_bytes // 8
    assert media_gif.read(media_gif.store(empty(spark))).collect() == []


# -- html --------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="sidebar">Side</div>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First<br>paragraph  with
lines<p>Second &copy; one</p><div class="ad">Buy!</div><ul><li>a<li>b</ul><!-- no --><form><input><p>field</p></form></article><section class="comments"><p>nice article, very nice article indeed, I say</p></section><footer>End</footer></body></html>"""


def test_html(spark):
    want = "Title & more\n\nFirst paragraph with lines\n\nSecond © one\n\na\n\nb"
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE), (2, "http://a.example/2", PAGE), (3, None, None), (4, "x", ""), (5, "http://b.example", "<p>just text &am"), (6, "http://a.example/3", PAGE[: PAGE.index("</p><div")])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, path string")
    got = {r.page_id: r for r in html_extract.extract_main_text(df).collect()}
    assert got[1].text == want and got[2].text == want and got[1].n_chars == len(want)
    assert got[3].text == "" and got[4].text == "" and got[5].text == "just text &am" and got[6].text.endswith("Second © one")
    assert html_extract.extract_main_text(df.limit(0)).collect() == []
    soup = "<body><div class='menu'>m</div><div class='c1'><div class='post-12'><p>" + "long text here " * 20 + "</p><p>more</p></div></div></body>"
    assert html_extract.extract(soup, None).endswith("more") and "m\n" not in html_extract.extract(soup, None)


def test_every_container_of_a_page_votes(spark):
    box = lambda i, x, name, text: f"<div class='{x}{chr(97 + i)}a'><div class='{x}{chr(97 + i)}b'><div class='{name}'><p>{text}</p></div></div></div>"
    page = lambda i: "<body>" + "".join(box(i, x, f"{x}{chr(97 + i)}c", "other words " * 9) for x in "stuv") + "<div><div>" + "<div class='same'><p>" + "common text " * 8 + "</p></div></div></div></body>"
    assert [p.endswith("div.same") for p, *_ in html_extract.votes(page(0))].index(True) > 2
    df = spark.createDataFrame([(i, f"http://c.example/{i}", page(i)) for i in range(12)], "page_id long, url string, html string")
    assert all(r.text == ("common text " * 8).strip() for r in html_extract.extract_main_text(df).collect())


def test_the_vote_decides_on_pages_without_an_article(spark):
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["sun", "moon", "river", "hill", "stone"]) + str(r.randrange(1000)) for _ in range(n))
    story, other, rows = {}, {}, []
    for i in range(30):
        story[i], other[i] = [words(5 if i % 5 == 0 else 60) for _ in range(2)], words(25)
        html = f"<body><div class=ka><div class=x>Read more of our stories</div><h2>T{i}</h2><p>{story[i][0]}<div class=x>Tell a friend about it</div><p>{story[i][1]}</div><div class=kb><p>{other[i]}</div></body>"
        rows.append((i, f"http://d.example/{i}", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n\n".join([f"T{i}", *story[i]]) for i in story}
    got = {x.page_id: x.text for x in html_extract.extract_main_text(df).collect()}
    assert got == want
    alone = {x.page_id: x.text for x in html_extract.extract_main_text(df, vote=False).collect()}
    assert {i for i in alone if alone[i].endswith(other[i])} == {i for i in alone if i % 5 == 0} and "Tell a friend about it" in alone[1]


def test_furniture_by_name_and_what_only_looks_like_it():
    for x in ("ad", "ads", "AdBox2", "site-footer", "cookie-notice", "sidebar_left", "comment-list", "related-posts", "share-buttons", "widget"):
        assert html_extract.names_furniture(x), x
    for x in ("side-effects", "side", "content", "post-body", "search-results-study", "notice-of-death", "shareholders", "story", "hidden-figures", "adrift"):
        assert not html_extract.names_furniture(x), x
    page = '<article><p>one</p><div class="side-effects"><p>two</p></div><fieldset><p>three</p></fieldset><p>x <math>y</math> <svg><text>z</text></svg></p><form><p>no</p></form><p>a <a title="q>b</a> c</p></article>'
    assert html_extract.extract(page, None) == "one\n\ntwo\n\nthree\n\nx y z\n\na b c"
    assert html_extract.extract("<article><p title='q\">b &lt; &#x41; &nbsp; c</p></article>", None) == "b < A c"


def test_copies_of_pages_are_no_furniture(spark):
    same = "<body><article><div class=k><p>" + "words of one story " * 9 + "</p></div><p>end</p></article></body>"
    df = spark.createDataFrame([(i, "http://e.example/", same) for i in range(12)], "page_id long, url string, html string")
    assert {x.text for x in html_extract.extract_main_text(df).collect()} == {("words of one story " * 9).strip() + "\n\nend"}


# -- toxicity ----------------------------------------------------------------------------------------------------------


def test_stems_are_learned():
    r = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ale", "ire", "one", "una")]
    plain = lambda: [r.choice(words) for _ in range(12)]
    rows = [(" ".join([*plain(), f"zorgon{chr(97 + i % 26)}", *plain()]), 1) for i in range(60)] + [(" ".join(plain() + plain()), 0) for _ in range(120)]
    n = {}
    for s, _, a, b in toxicity.stem_counts(rows):
        n[s] = (n.get(s, (0, 0))[0] + a, n.get(s, (0, 0))[1] + b)
    assert n["zorgon"] == (60, 0) and n["bale"][0] <= 60 and n["bale"][1] > 20
    stems = toxicity.choose_stems([(s, a, b) for s, (a, b) in n.items() if a >= 3 and b == 0], 60, 120)
    assert set(stems) == {"zorgon"}
    assert toxicity.bias_of([(0.0, 0), (0.5, 0), (2.5, 1), (3.0, 1)]) == -1.5 and toxicity.bias_of([(1.0, 1)]) is None


def test_grammar():
    g = toxicity.Grammar({"zorgon": 3.0})
    total = lambda t: sum(g.clauses(t))
    assert g.score("what a zorgonzz that is") >= 0.5 and g.score("a calm day") < 0.5 and g.score(None) < 0.5 and g.score("") < 0.5
    assert g.score("you are an idiot") >= 0.5
    assert total("you are not an idiot") < total("you are an idiot")
    assert total("such an idiot is you") == total("you are such an idiot") > total("such an idiot") > 0  # targets before and after
    assert total("an idiot far away from any of you") == total("such an idiot")
    for t in ('he said "idiot" twice', '"idiot" he said twice', "«idiot» was what someone wrote"):
        assert total(t) < total("he idiot twice")
    assert total('"idiot" he is. he said so') > total('"idiot" he said so')  # the report has to be in the clause
    assert g.clauses("I will kill you") and g.clauses("you will be hurt, we will hurt all of you") and not g.clauses("they kill time") and not g.clauses("to kill a process") and not g.clauses("we will kill that old process here with you")
    assert total("we will never hurt you") < total("we will hurt you")
    assert len(g.clauses("idiot here. calm there. moron again")) == 2
    assert total("idiot and moron") > total("idiot") + total("moron")  # the second hit of a clause is not alone
    assert not g.clauses("no trash at all, never") or total("no trash") < total("trash")


def test_each_transducer_against_a_plain_reading():
    r = random.Random(4)
    for _ in range(400):
        tape = [(x, 3.0 if x in "ih" else 0.0) for x in r.choices("ooihtwnrq", k=r.randrange(1, 12))]
        syms = "".join(x for x, _ in tape)
        total, hit = 0.0, False
        near = lambda i, cue, after: any(syms[j] == cue for j in range(max(0, i - 4), min(len(syms), i + 5 if after else i)) if j != i)
        for i, x in enumerate(syms):
            if x not in "ih" or x == "h" and not (near(i, "w", False) and near(i, "t", True)):
                continue
            aimed = x == "i" and near(i, "t", True)
            w = 3.0 + 0.6 * aimed - 2.0 * near(i, "n", False) - 2.0 * ("r" in syms and syms[:i].count("q") % 2 == 1)
            w -= 0.5 if x == "i" and not aimed and not hit else 0.0
            if w > 0:
                total, hit = total + w, True
        assert toxicity.cascade().best(tape, "x") == pytest.approx(total), syms


def test_parts_left_out():
    text = 'you will not hurt anyone you idiot, "moron" he said'
    whole = sum(toxicity.Grammar().clauses(text))
    by = {name: sum(toxicity.Grammar(without=name).clauses(text)) for name in toxicity.PARTS}
    assert by["insults"] == 0 and by["targets"] < whole < min(by["negations"], by["reports"])
    assert sum(toxicity.Grammar(without="threats").clauses("kill time")) > 0


def test_toxicity(spark):
    rows = [(i, f"fine words {i}" if i % 2 else f"such a moron {i}") for i in range(60)] + [(99, None), (98, ""), (98, ""), (97, "calm " * 30000 + "you moron")]
    labels = spark.createDataFrame([(i, (i + 1) % 2, None) for i in range(60)] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    out = toxicity.score_toxicity(docs(spark, rows), labels).collect()
    assert len(out) == 64 and all(r.predicted == (1 if r.doc_id < 60 and r.doc_id % 2 == 0 or r.doc_id == 97 else 0) for r in out)
    assert toxicity.score_toxicity(empty(spark), labels.limit(0)).collect() == []
    df = docs(spark, rows).withColumns({"row": F.lit(1), "toxic": F.lit("t"), "a b": F.lit(2)})
    out = toxicity.score_toxicity(df, labels, names=("s", "p"))
    assert out.columns == [*df.columns, "s", "p"] and out.where("toxic = 't' AND score LIKE 's%' AND removed = 'clash'").count() == 64


def test_learning_on_executors(spark):
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    text = lambda bad: " ".join(r.choice(words) if not bad or i != 7 else "zorgon" + r.choice("abc") for i in range(30))
    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(3, 0)], "doc_id long, toxic int")
    g = toxicity.fit(docs(spark, rows), labels)
    assert "zorgon" in g.stems and len(g.stems) < 10
    out = toxicity.score_toxicity(docs(spark, rows), labels).collect()
    assert sum(x.predicted == (x.doc_id % 3 == 0) for x in out) > 290


# -- substring dedup ---------------------------------------------------------------------------------------------------


def test_cut():
    assert substring.cut("ab\ncd\nef", [(3, 5)]) == "ab\nef" and substring.cut("abcdef", [(1, 3)]) == "adef" and substring.cut("ab\ncd", [(3, 5)]) == "ab"


def plain_lines(rows):
    """Line dedup in plain Python: {doc_id: text that stays}, first come by doc_id."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            k = " ".join(line.lower().split())
            if not k or k not in seen:
                keep.append(line)
            seen.add(k)
        out[d] = "\n".join(keep)
    return out


def test_lines_of_any_length_against_plain_python(spark):
    r = random.Random(5)
    lines = ["a", "Of.", "to the point", "x y z  w", " and so on ", "Ünï çode", "long line " * 9] + [" ".join(f"w{r.randrange(90)}" for _ in range(r.randrange(1, 5))) for _ in range(60)]
    rows = [(i * 3, "\n".join(r.choice([str.upper, str.lower, lambda x: f"  {x}"])(r.choice(lines)) if r.random() < 0.7 else "" for _ in range(r.randrange(1, 9)))) for i in range(60)]
    out = {x.doc_id: x for x in substring.dedup_substrings(docs(spark, rows), least=1, inline=False).collect()}
    words = lambda t: t.split()
    for d, want in plain_lines(rows).items():
        assert words(out[d].text) == words(want)
        assert substring.cut(dict(rows)[d], [(s.start, s.end) for s in out[d].removed]) == out[d].text


def test_substring_dedup(spark):
    r = random.Random(2)
    passage = " ".join(f"p{r.randrange(10**6)}{'.' if i % 9 == 8 else ''}" for i in range(60)) + "."
    own = lambda: " ".join(f"q{r.randrange(10**6)}" for _ in range(30)) + "."
    clean = own()
    rows = [(4, own() + " " + passage + " " + own()), (2, passage + "\n" + own()), (9, own() + "\n" + passage), (1, clean), (7, None), (8, ""), (11, "one"), (12, "one")]
    out = {x.doc_id: x for x in substring.dedup_substrings(docs(spark, rows)).collect()}
    assert out[2].text == rows[1][1] and out[1].text == clean and out[7].text is None and out[8].text == "" and out[12].text == "one"
    assert out[9].text == rows[2][1].split("\n")[0]
    kept = out[4].text
    assert kept == substring.cut(rows[0][1], [(s.start, s.end) for s in out[4].removed])
    assert sum(w in kept for w in re.findall(r"p\d+", passage)) <= 16 and all(w in kept for w in re.findall(r"q\d+", rows[0][1]))
    assert substring.dedup_substrings(empty(spark)).collect() == []


def without_passages(rows, first, **how):
    """Texts of ``rows`` after their units that are in ``first`` too are cut, by the module's units but no Spark."""
    texts = [*first, *rows]
    text, start, end, high, low = substring.units(texts, **how)
    known = {(h, w) for t, h, w in zip(text, high, low) if t < len(first)}
    spans = {i: [] for i in range(len(texts))}
    for t, s, e, h, w in zip(text.tolist(), start.tolist(), end.tolist(), high, low):
        if t >= len(first) and (h, w) in known:
            spans[t].append((s, e))
    return [substring.cut(texts[i], spans[i]) for i in range(len(first), len(texts))]


def test_every_pasted_passage_is_found_and_nothing_else():
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    for marks in (0.0, 0.1, 0.4):
        text = lambda n, end=" ": end.join(r.choice(words) + ("," if r.random() < marks else "") for _ in range(n))
        first, rows, passages = [], [], []
        for i in range(150):
            p = text(51)
            passages.append(p)
            first.append(text(r.randrange(20, 60)) + " " + p + " " + text(30))
            rows.append(text(r.randrange(20, 60)) + " <" + p + "> " + text(40))
        out = without_passages(rows, first)
        gone = [len(a.split()) - len(b.split()) for a, b in zip(rows, out)]
        assert min(gone) >= 25 and max(gone) <= 51 and sum(gone) / len(gone) >= 38
        for a, b, p in zip(rows, out, passages):
            head, tail = a.split("<" + p + ">")
            assert b.startswith(head) and b.endswith(tail)  # what isn't the passage stays
        fresh = [text(400) for _ in range(50)]
        assert without_passages(fresh, first) == fresh


def test_short_lines_and_texts_without_spaces(spark):
    r = random.Random(11)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    verse = "\n".join(line(6) for _ in range(20))
    assert without_passages([verse], [verse]) == [""]
    short = "\n".join(line(6) for _ in range(10))
    mine = line(20)
    assert without_passages([mine + "\n" + short], [line(25) + "\n" + short]) == [mine]
    han = lambda n: "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage, head = han(60), han(40)
    left = without_passages([head + passage + head], [han(30) + passage + han(50)])[0]
    assert left.startswith(head) and left.endswith(head) and len(left) < 80 + 18
    solid = "z" * 90 + han(3)
    assert without_passages(["a " + solid], ["b " + solid])[0].startswith("a")
    out = {x.doc_id: x.text for x in substring.dedup_substrings(docs(spark, [(1, verse), (2, verse), (3, passage), (4, passage)])).collect()}
    assert out == {1: verse, 2: "", 3: passage, 4: ""}


def test_spans_merge_as_in_plain_python():
    r = random.Random(8)
    spans = [(i, a, a + r.randrange(1, 9)) for i in range(60) for a in (r.randrange(60) for _ in range(r.randrange(0, 12)))]
    want = []
    for i, s, e in sorted(spans):
        if want and want[-1][0] == i and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([i, s, e])
    got = substring.merged(*(np.array([x[q] for x in spans], np.int64) for q in range(3)))
    assert [list(x) for x in zip(*(g.tolist() for g in got))] == want
    assert all(len(g) == 0 for g in substring.merged(*[np.zeros(0, np.int64)] * 3))


def test_periodic_texts_keep_their_first_unit(spark):
    rows = [(1, "ab cd " * 200), (2, "ab cd " * 200), (3, "lone words here")]
    out = {x.doc_id: x.text for x in substring.dedup_substrings(docs(spark, rows)).collect()}
    assert 25 <= len(out[1].split()) < 80 and len(out[2].split()) < 25 and out[3] == "lone words here"


def test_rows_that_share_an_id_and_clashing_names(spark):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, shared = text(40), text(50), text(60)
    rows = [(5, a + "\n" + shared), (5, b), (5, b), (None, shared), (9, shared), (3, None), (3, "")]
    df = spark.createDataFrame([(*x, 1, "n", "k", "s", 2) for x in rows], "doc_id long, text string, _id int, rank string, key string, _row string, `odd name` int")
    out = substring.dedup_substrings(df)
    assert out.columns == [*df.columns, "removed"]
    want = [(5, a + "\n" + shared), (5, b), (5, b), (None, ""), (9, ""), (3, None), (3, "")]
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == sorted(want, key=repr)


# -- decontamination ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("known", [True, False])
def test_decontamination(spark, monkeypatch, known):
    if not known:  # as for a benchmark that can't be broadcast
        monkeypatch.setattr("sluice.llm.storage.BROADCAST_BYTES", -1)
    r = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 10, 14])))) for i in range(12)] + [(50, None), (51, ""), (52, "É Ünïq, zz"), (53, "W1 w2")]
    rows = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(12)] + [(20, None), (21, ""), (22, "so É-Ünïq-ZZ."), (23, items[2][1].upper()), (23, "w1")]
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, row string")
    split = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    want = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for i, x in items:
            x = split(x)
            for win in [x[k : k + 10] for k in range(max(1, len(x) - 9))] if x else []:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(i)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    out = decontaminate.decontaminate(docs(spark, rows), b).collect()
    assert sorted(tuple(x)[:6] for x in out) == sorted(want)
    assert all(sum(s.last - s.first for s in x.spans) == x.n_hit for x in out)
    assert decontaminate.decontaminate(empty(spark), b).collect() == [] and not any(x.contaminated for x in decontaminate.decontaminate(docs(spark, rows), b.limit(0)).collect())


# -- warc --------------------------------------------------------------------------------------------------------------


def test_archive_round_trip_and_validation():
    recs = [warc.record(i, f"http://x/{i}\r\n", f"<p>page number {i} with words {i * 7}</p>".encode() * 5, None if i % 3 else 1) for i in range(40)]
    data = b"".join(warc.archive(recs, recs[:30]))
    assert data[:4] == warc.FRAME_MAGIC
    assert list(warc.read_archive(io.BytesIO(data))) == recs
    h, block = warc.parse(recs[1])
    assert warc.payload_of(h, block)[0] == len(block.partition(b"\r\n\r\n")[2]) and "\r" not in h["warc-target-uri"]
    for bad in (recs[0][:-1], recs[1].replace(b"page", b"rage"), recs[0].replace(b"WARC/1.1", b"WARC/9"), b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    for bad in (data[:-3], data[:30]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    assert list(warc.read_archive(io.BytesIO(b""))) == []


def test_warc(spark):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (1, "u1", None), (3, "u3", ""), (4, "u4", "é"), (4, "u4", "é")] + [(100 + i, "u", f"page {i} " * 50) for i in range(60)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string").repartition(2)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        first = min(q for q, _, x in rows if (x or "") == (h or ""))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in sorted(want, key=lambda x: x[:4])]
    assert warc.read_archives(warc.write_archives(df.limit(0))).collect() == []


# -- urls --------------------------------------------------------------------------------------------------------------


def test_url_rules_and_graph(spark):
    link = lambda *hosts: "".join(f'<a class=x href="http://{h}/p">l</a>' for h in hosts)
    rows = [
        (1, "http://example.net/en/1?x=/de/", ""), (2, "http://a.b.NET/x", ""), (3, "http://example.com/de/1", ""), (4, "https://m.example.org/fr/", link("good.example")), (5, None, None), (6, "no scheme", ""), (7, "http://net/", ""),
        (8, "http://notnet/", ""), (9, "http://farm.example/", link("bad.net", "bad.net")), (10, "http://good.example/", ""), (11, "http://example.net#/en/", ""), (12, "http://bad.net/", ""), (13, "http://far.example/", link("farm.example")), (13, "http://far.example/", link("farm.example")),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("a.b.net", "/x", "net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7][2] == "net/" and got[8][2] is None and got[11] == ("example.net", "", None, "allow")
    assert got[9] == ("farm.example", "/", None, "block") and got[13][3] == "block" and got[10][3] == "allow"
    assert url_filter.filter_urls(df.limit(0)).collect() == []


def test_page_rank_against_brute_force(spark):
    r = random.Random(6)
    e = {(f"h{r.randrange(8)}", f"h{r.randrange(8)}") for _ in range(20)}
    e = sorted((a, b) for a, b in e if a != b)
    got = {x.host: x["rank"] for x in url_filter.propagate(spark.createDataFrame([(*x, 1.0) for x in e], "src string, dst string, weight double"), spark.createDataFrame([("h0", 1.0)], "host string, share double"), rounds=60, tolerance=0.0).collect()}
    rank = {"h0": 1.0}
    for _ in range(300):  # hosts without links pass their rank to the seed
        new = {"h0": 0.15 + 0.85 * sum(v for k, v in rank.items() if all(a != k for a, _ in e))}
        for a, b in e:
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) / sum(x == a for x, _ in e)
        rank = new
    assert sum(rank.values()) == pytest.approx(1) and any(all(a != k for a, _ in e) for k in rank)
    assert {k: pytest.approx(v, abs=1e-4) for k, v in rank.items() if v} == got


def test_hosts_that_are_only_linked_to_are_seeds(spark):
    link = lambda *urls: "".join(f'<a href="{u}">l</a>' for u in urls)
    rows = [(1, "http://farm.example/", link("http://bad.net/p")), (2, "http://far.example/", link("http://farm.example/")), (3, "http://src.example/", link("http://x.org/fr/a?b"))]
    rows += [(4, "http://up.example/", link("http://x.org/de/")), (5, "http://x.org/", link("http://friend.example/", "http://worse.net/"))]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].verdict == got[2].verdict == "block" and got[3].rule is None
    assert got[5].trust > 0 and got[4].trust == 0 and got[5].rule is None


def test_propagation_reaches_far_hosts_by_default(spark):
    rows = [(k, f"http://h{k}.example/", f'<a href="http://{f"h{k - 1}.example" if k > 1 else "bad.net"}/">l</a>') for k in range(1, 20)]
    got = {r.page_id: (r.verdict, r.distrust) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("block", pytest.approx(0.15 * 0.85**k / (1 - 0.85**20), abs=1e-5)) for k in range(1, 20)}


def test_propagation_with_many_seeds(spark):
    n = 20_000
    pairs = spark.range(n // 2).selectExpr("concat('x', id) AS src", "concat('y', id) AS dst", "1.0D AS weight")
    chain = spark.createDataFrame([("s0" if k == 0 else f"c{k}", f"c{k + 1}", 1.0) for k in range(6)], pairs.schema)
    seeds = spark.range(n).selectExpr("concat('s', id) AS host", f"1.0D / {n} AS share")
    got = {r.host: r["rank"] for r in url_filter.propagate(pairs.unionByName(chain), seeds).where("host LIKE 'c%'").collect()}
    # a seed's share and what it passes on along the chain, against that of all seeds, most of which pass on nothing
    total = (0.15 * (n - 1) + 1 - 0.85**7) / n
    assert got == {f"c{k}": pytest.approx(0.15 * 0.85**k / n / total, rel=1e-6) for k in range(1, 7)}


# -- very long texts ---------------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    r = random.Random(17)
    item = " ".join(f"item{i}" for i in range(14))
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000)) + " " + item
    df = docs(spark, [(1, long), (2, "short one")])
    hit = {x.doc_id: x for x in decontaminate.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit[1].n_words == 200_014 and hit[1].n_hit == 14 and not hit[2].contaminated
    media = {x.doc_id: x for x in media_gif.read(media_gif.store(df)).collect()}
    raw = long.encode()
    assert media[1].n_bytes == len(raw) and media[1].payload_sha256 == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest() and len(media[1].frames) > 10
    store = token_store.write_store(df, tokenizer_path(), end=0)
    ids = library_ids(long, 0)
    got = {x.doc_id: x for x in store.read(store.find(store.entries)).collect()}
    assert got[1].n_tokens == len(ids) and got[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = [x for x in packing.pack(df, tokenizer_path(), end=2, size=1024).collect() if x.doc_id == 1]
    assert sum(x.length for x in pieces) == len(ids) and all(x.length == 1024 for x in pieces if x.piece)
    pages = spark.createDataFrame([(1, "http://x.example/", f"<body><article><p>{long}</p></article><nav>menu</nav></body>")], "page_id long, url string, html string")
    assert html_extract.extract_main_text(pages).first().text == long
    assert warc.read_archives(warc.write_archives(pages)).first().payload_bytes == len(pages.first().html.encode())
    assert url_filter.filter_urls(pages).first().verdict == "allow"
    out = {x.doc_id: x.text for x in substring.dedup_substrings(docs(spark, [(1, long), (2, "intro " + long)])).collect()}
    assert out[1] == long and len(out[2]) < 200
