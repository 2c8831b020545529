"""Parts that need no cluster: coder, parsers, lattice, filters, fingerprints."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lociflow.llm import langid, licenses, media, neardup, pages, pieces, rangecoder, tokens


@pytest.mark.parametrize("n", [0, 1, 2, 100, 2048, 2049, 7000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in ((rng.zipf(1.3, n) % 50257), rng.integers(0, rangecoder.MAX_ID, n), np.zeros(n), np.arange(n) % 3):
        ids = ids.astype(np.uint32)
        assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_coder_shrinks_and_checks():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 200), 40).astype(np.uint32)
    coded = bytearray(rangecoder.encode(ids))
    assert len(coded) < len(ids)
    coded[-9] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(coded))
    with pytest.raises(ValueError):
        rangecoder.decode(b"nope")
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([rangecoder.MAX_ID], np.uint32))


def test_coder_beats_deflate_on_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:300]
    ids = np.concatenate(tokens.Encoder().encode(texts))
    assert len(rangecoder.encode(ids)) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_coder_escapes_rare_ids(monkeypatch):
    monkeypatch.setattr(rangecoder, "MAX_ALPHABET", 50)
    ids = np.concatenate([np.arange(3000) % 40, np.random.default_rng(1).integers(0, rangecoder.MAX_ID, 900)]).astype(np.uint32)
    np.random.default_rng(2).shuffle(ids)
    assert (rangecoder.decode(rangecoder.encode(ids, 512)) == ids).all()


def test_coder_blocks_are_independent():
    ids = (np.random.default_rng(3).zipf(1.3, 3000) % 500).astype(np.uint32)
    coded = rangecoder.encode(ids, 1000)
    assert (rangecoder.decode(coded) == ids).all()
    damaged = bytearray(coded)
    damaged[-60] ^= 0x55  # in the last block, before its padding
    with pytest.raises(ValueError, match="block 2"):
        rangecoder.decode(bytes(damaged))


def test_token_cache_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    e = tokens.Encoder()
    texts = [" ".join(f"word{i + j}" for j in range(9)) + " \n\t x\n" for i in range(0, 300, 5)] * 2
    for t in texts:
        assert list(e.encode([t])[0]) == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.known) + len(e.older) <= 60


def test_pieces_of_text_are_the_tokenizers_own():
    e = tokens.Encoder()
    rng = random.Random(3)
    alphabet = [*"ab' \n\t\r  \x1c\x85\xa0 　,.!1é漢", "'ll", " ", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", None, "<|endoftext|> a  b"]
    want = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(list(g) == w.ids for g, w in zip(e.encode(texts), want, strict=True))


def test_words_are_the_models_own():
    e = tokens.Encoder()
    rng = random.Random(5)
    texts = ["".join(rng.choice([" ", "", "\n"]) + "".join(rng.choices("aenstXéßñüÀÖ×÷ªµÿ", k=rng.randrange(9))) + rng.choice(["", "", ",", "...", "'s", "_", "(-)", "9", "\x7f"]) for _ in range(8)) for _ in range(4000)]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(list(g) == w.ids for g, w in zip(e.encode(texts), want, strict=True))


def test_new_words_are_asked_for_together():
    e = tokens.Encoder()
    bare, batch, calls = e.pieces.bare, e.pieces.batch, []
    e.pieces.bare = lambda words, **how: calls.append(len(words)) or bare(words, **how)
    e.pieces.batch = lambda texts, **how: calls.append(len(texts)) or batch(texts, **how)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("aeinrst", k=9)) + rng.choice(["", ",", "2"]) for _ in range(50)) for _ in range(40)]
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for n_calls in (10, 10):  # the second time all are remembered
        assert all(list(g) == w.ids for g, w in zip(e.encode(texts), want, strict=True))
        assert len(calls) <= n_calls


@pytest.mark.parametrize("how", ["as is", "one hash", "parts", "one by one"])
def test_pieces_of_all_lengths(monkeypatch, how):
    if how == "one hash":
        monkeypatch.setattr(tokens._Table, "hashed", staticmethod(lambda key: np.zeros(len(key[0]), np.uint64)))
    if how == "parts":
        monkeypatch.setattr(tokens, "_WAIT", 100)
        monkeypatch.setattr(tokens, "_WAIT_PIECES", 3)
    e = tokens.Encoder()
    if how == "one by one":
        e.pieces.bare = None
    rng = random.Random(11)
    words = ["".join(rng.choices("abéß漢,'\0\xa0", (9, 9, 3, 2, 1, 1, 1, 1, 0.2), k=k)) for k in (*range(80), 300)] * 2
    rng.shuffle(words)
    texts = [rng.choice([" ", "\n", "  ", "\n\n"]).join(words[a : a + 7]) + rng.choice(["", " ", "\t"]) for a in range(len(words))] + [" ".join(words)]
    want = [w.ids for w in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [list(x) for x in e.encode(texts)] == want


def test_other_vocabularies_get_whole_texts():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Two  words, one\n\nline", "", None, "a b'll <|endoftext|> C"]
    want = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert not e.by_piece and [list(x) for x in e.encode(texts)] == [w.ids for w in want]


def test_carries_go_up():
    ids = np.tile(np.r_[np.zeros(40), np.full(3, 7), np.arange(5)], 500).astype(np.uint32)
    for n in range(1, 4):
        assert (rangecoder.decode(rangecoder.encode(ids, 100 * n + 1)) == ids).all()


def test_licence_expressions():
    assert licenses.to_postfix("MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause)") == ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "with", "BSD-3-Clause", "and", "or"]
    for bad in ("", "OR MIT", "(MIT", "MIT AND"):
        assert licenses.to_postfix(bad) is None
    value = lambda x: licenses.evaluate(licenses.to_postfix(x))[1]
    assert value("MIT OR GPL-3.0-only") and not value("MIT AND GPL-3.0-only") and value("GPL-3.0-only AND MIT OR ISC")


def test_licence_scan_against_brute_force():
    rng = random.Random(4)
    auto = licenses.automaton()
    bits = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "x", "é", ".", ",", "\n", "License,"]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        words = licenses._WORD.findall("".join(c.lower() if c.isascii() else c for c in text))
        hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = licenses.scan_text(auto, text)
        starts = [i for i, _ in hits]
        assert got[:5] == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(got[4].split(",")) <= set(got[5].split(","))
    assert licenses.scan_text(auto, None)[:7] == (0, 0, None, None, "", "", 0.0)
    tagged = licenses.scan_text(auto, "// SPDX-License-Identifier: MIT AND Zlib\ncode")
    assert tagged[5] == "spdx:mit,spdx:zlib" and tagged[6] == 1.0 and tagged[8] is True


def test_licence_expressions_are_read_whole():
    auto = licenses.automaton()
    names = [f"LicenseRef-{i}" for i in range(400)]
    for text in (" AND ".join(names), f"({' OR '.join(names)})"):
        got = licenses.scan_text(auto, f"SPDX-License-Identifier: {text}\nAND MIT")
        assert got[5] == ",".join(sorted(f"spdx:{x.lower()}" for x in names)) and len(got[7]) == 1
    line = "/* SPDX-License-Identifier: MIT */ a(); /* SPDX-License-Identifier: GPL-3.0-only OR ISC */ b(); // spdx license identifier Zlib"
    assert licenses.scan_text(auto, line)[7:] == (["MIT", "GPL-3.0-only ISC or", "Zlib"], True)
    assert licenses.scan_text(auto, "SPDX-License-Identifier:\nMIT AND\nSPDX-License-Identifier: ISC")[7] == ["ISC"]


def test_media():
    for text, size in ((None, 64), ("", 64), ("a" * 64, 64), ("a" * 65, 128), ("é" * 4000, 8000)):
        n, payload = media.payload_of(text)
        assert len(payload) == size and payload[:n] == (text or "").encode()
        x, raw = media.from_wav(media.to_wav(payload))
        assert raw == payload and len(x) == size
    tone = np.round(128 + 60 * np.sin(np.arange(4096) * 2 * np.pi * 40 / media.WINDOW)).astype(np.uint8)
    frames = np.concatenate(list(media.stft(media.from_wav(media.to_wav(tone.tobytes()))[0])))
    assert (np.abs(frames[:, 5:200]).argmax(axis=1) + 5 == 40).all()
    rows = [media.media_row(media.to_wav(media.payload_of(t)[1]), len(t)) for t in ("hello world " * 300, "hello world " * 300, "other text " * 300)]
    assert str(rows[0]) == str(rows[1]) and str(rows[0]) != str(rows[2])


def test_grams_ignore_chunks(monkeypatch):
    text = "Café au lait, 1234 -- et  du pain! " * 30
    whole = np.concatenate(list(langid.grams(text)))
    monkeypatch.setattr(langid, "_CHUNK", 37)
    assert sorted(np.concatenate(list(langid.grams(text))).tolist()) == sorted(whole.tolist())
    assert len(list(langid.grams("a"))) == 1


def test_shingles_are_the_words_sets():
    rng = random.Random(6)
    made = {}
    for _ in range(300):
        words = [rng.choice(["a", "B", "cc", "d" * 50, "é"]) for _ in range(rng.randrange(12))]
        text = rng.choice([" ", "\n", " \t"]).join(words)
        low = tuple(w.lower() if w.isascii() else w for w in words)
        key = frozenset(low[i : i + 5] for i in range(len(low) - 4)) if len(low) >= 5 else frozenset([low] if low else [])
        s = neardup.shingles(text)
        assert len(s) == len(key)
        assert made.setdefault(key, s.tobytes()) == s.tobytes()
    assert len(set(made.values())) == len(made)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_pigeonhole(threshold):
    plan = neardup.Plan(threshold)
    rng = np.random.default_rng(2)
    indexes = plan.indexes()
    for _ in range(3000):
        wrong = set(rng.choice(neardup.K, plan.max_diff, replace=False).tolist())
        assert any(not wrong & set(keep) for keep in indexes)


def test_page_text():
    text = lambda html: pages.parse(html)[1]
    assert text("<body><nav>n</nav><article><h1>T</h1><p><b>one  &amp;\ntwo<br><p>three</article><footer>f</footer>") == "T\none & two\nthree"
    assert text('<main><article><header><h1>T</h1></header><p>a<div class="ad">x</div><section id="comments"><article>c</article></section></article></main>') == "T\na"
    assert text('<div id="content"><p>a</p><form><p>f</p></form><script>var t="</p>";</script></div><aside>s</aside>') == "a"
    assert text(None) == "" and text("") == ""
    assert pages.host_of("https://u@Www.Ex.org:80/a?b#c") == "www.ex.org" and pages.host_of(None) == ""


def test_page_names_of_the_layout():
    text = lambda html: pages.parse(html)[1]
    assert text('<body class="single no-sidebar"><article>a</article></body>') == "a"
    assert text('<main class="has-sidebar"><p>a</p><div class="sidebar">s</div></main>') == "a"
    assert text('<article class="post comments-open"><p>a</p><article class="comment">c</article></article>') == "a"
    assert text('<div class="has-sidebar"><div class="has-header"><article><p>a</p><p class="ad">x</p></article></div><p>b</p></div>') == "a"
    assert text('<main><div class="layout-sidebar"><article>the article</article></div><p>b</p></main>') == "the article"
    assert text('<article>a</article><div class="related"><article>a longer teaser</article></div>') == "a"
    assert text('<div class="has-sidebar"><div class="entry-content">the text</div></div>') == "the text"
    assert text('<div class="content">a</div><div id="comments"><div class="comment-content">a long comment</div></div>') == "a"
    assert text('<nav class="x"><article>n</article></nav><article>a</article>') == "a"


def test_sampler_takes_texts_of_any_length(monkeypatch):
    m = pieces.Pieces()
    rng = random.Random(8)
    words = " ".join("".join(rng.choice("abcdefgh\u6f22\U0001f600") for _ in range(rng.randrange(1, 40))) for _ in range(2000))
    keys = np.arange(1, dtype=np.uint64)
    whole = m.segment([words], keys)[0]
    monkeypatch.setattr(pieces, "BATCH_CHARS", 700)
    assert (m.segment([words], keys)[0] == whole).all()
    monkeypatch.setattr(pieces, "CACHE_ROWS", 300)
    assert (pieces.Pieces().segment([words], keys)[0] == whole).all()
    run = "".join(rng.choice("abcdefgh") for _ in range(40_000))  # no limit anywhere
    got = m.segment([run], keys)[0]
    monkeypatch.setattr(pieces, "WINDOW", 1000)
    assert (m.segment([run], keys)[0] == got).all() and m.decode(got.tolist()) == run


def test_sampler_is_exact_in_windows(monkeypatch):
    monkeypatch.setattr(pieces, "LONG_CHARS", 3)
    monkeypatch.setattr(pieces, "WINDOW", 4)
    check_sampler(pieces.Pieces(), 4000, 0.04)


def test_sampler_is_exact_and_lossless():
    check_sampler(pieces.Pieces(), 20_000, 0.02)


def check_sampler(m, n, within):
    texts = ["hello world", "", "  a▁b\n\n x  ", "漢字 é \U0001f600", "a" * 300, "x" + " " * 40 + "y"]
    keys = np.arange(len(texts), dtype=np.uint64)
    got = m.segment(texts, keys)
    assert [m.decode(x) for x in got] == texts
    again = [m.segment([t], keys[i : i + 1])[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(got, again, strict=True))
    weight = {m.bytes_of[i]: math.exp(w) for i, w in zip(m.ids.tolist(), m.log_weight.tolist(), strict=True)}
    word, ways = b" lower", {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        if all(p in weight for p in parts):
            ways[tuple(parts)] = math.prod(weight[p] for p in parts)
    total = sum(ways.values())
    drawn = Counter(tuple(m.bytes_of[i] for i in x) for x in m.segment([word.decode()] * n, np.arange(n, dtype=np.uint64)))
    assert set(drawn) <= set(ways)
    assert all(abs(drawn[w] / n - p / total) < within for w, p in ways.items())
