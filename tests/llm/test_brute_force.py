"""Operators without SQL against slow models written from their rules."""

import io
import math
import random
import wave
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.llm import common, langid, licenses, media, neardup, pages, quality, sharding


def slow_peaks(x):
    """(frame, bin) by the discrete Fourier sum, frame by frame."""
    n = max(1, -(-max(len(x) - media.WINDOW, 0) // media.HOP) + 1)
    padded = np.zeros((n - 1) * media.HOP + media.WINDOW)
    padded[: len(x)] = x
    k = np.arange(media.WINDOW // 2 + 1)[:, None] * np.arange(media.WINDOW)[None, :]
    basis = np.exp(-2j * np.pi * k / media.WINDOW)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.WINDOW) / (media.WINDOW - 1))
    mags = [np.abs(basis @ (padded[i * media.HOP : i * media.HOP + media.WINDOW] * hann)) for i in range(n)]
    out = []
    for i in range(n):
        for a, b in media.BANDS:
            top = [m[a:b].max() for m in mags]
            if top[i] > 1e-3 and (i == 0 or top[i] >= top[i - 1]) and (i == n - 1 or top[i] > top[i + 1]):
                out.append((i, a + int(mags[i][a:b].argmax())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_peaks_and_pairs(seed, monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 7)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=rng.integers(1, 9000)) * 0.2
    got = list(zip(*(v.tolist() for v in media.peaks(x.astype(np.float32))), strict=True))
    want = slow_peaks(x.astype(np.float32).astype(float))
    assert got == want
    pairs = sorted((t, (a << 13) | (b << 4) | (u - t)) for t, a in want for u, b in want if 1 <= u - t <= media.FAN_FRAMES)
    t, c = media.pair_codes(np.array([p[0] for p in want], int), np.array([p[1] for p in want], int))
    assert list(zip(t.tolist(), c.tolist(), strict=True)) == pairs


def wav(width, channels, frames):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(frames)
    return out.getvalue()


def test_other_media(spark):
    tone = np.sin(np.arange(3000) * 0.4)
    raw = {1: (tone * 100 + 128).astype("u1").tobytes(), 2: (tone * 30000).astype("<i2").tobytes(), 4: (tone * 2e9).astype("<i4").tobytes()}
    raw[3] = b"".join(int(v).to_bytes(3, "little", signed=True) for v in tone * 8e6)
    for width, frames in raw.items():
        x, back = media.from_wav(wav(width, 1, frames))
        assert back == frames and np.corrcoef(x, tone)[0, 1] > 0.999 and 0.7 < np.abs(x).max() <= 1
    assert len(media.from_wav(wav(2, 2, raw[2]))[0]) == 1500
    rows = [(1, wav(2, 1, raw[2])), (2, None), (3, b"no wav"), (None, b""), (4, b"RIFF\x00\x00\x00\x00WAVE"), (5, wav(1, 1, b""))]
    got = {r.doc_id: r for r in media.wav_fingerprints(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert len(got) == 6 and got[1].n_bytes == 6000 and got[5].n_bytes == 0 and got[5].n_peaks == 0
    assert all(got[k].n_bytes is None and got[k].codes is None for k in (2, 3, 4, None))


def slow_grams(text):
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    framed = " " + " ".join(kept.split()) + " "
    framed += " " * max(0, langid.N - len(framed))
    return [framed[i : i + langid.N] for i in range(len(framed) - langid.N + 1)]


def test_language_filter(spark):
    rng = random.Random(2)
    alphabet = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop", "dd": "mnopabcd"}
    word = lambda k: "".join(rng.choice(alphabet[k]) for _ in range(rng.randrange(2, 9)))
    data = [(i, " ".join(word(k) for _ in range(30)), k) for i in range(60) for k in alphabet]
    data = [(i * 4 + j, t, k) for j in range(4) for i, (_, t, k) in enumerate(data[j::4])]
    docs = spark.createDataFrame([*data, (None, "null id", "ee"), (9999, None, "ff"), (9998, "no label", None)], "doc_id long, text string, lang string")
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("h")).collect()}
    model = langid.train(docs)
    assert sorted(model.langs) == sorted(alphabet)
    learned = defaultdict(set)
    for i, t, k in data:
        if not held[i]:
            learned[k] |= set(slow_grams(t))
    every = sorted(set().union(*learned.values()) | {"".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(3000)})
    framed = {g: np.concatenate(list(langid.grams(g)))[1:2] for g in every if " " not in g}  # " abcd ": its second gram
    got = model.languages_of(np.concatenate(list(framed.values())))
    false = Counter()
    for g, hit in zip(framed, got, strict=True):
        for k, h in zip(model.langs, hit.tolist(), strict=True):
            assert h or g not in learned[k]  # all languages that contain it
            false[k] += h and g not in learned[k]
    for i, k in enumerate(model.langs):
        rate = false[k] / sum(g not in learned[k] for g in framed)
        assert abs(rate - model.false_rate[i]) < 0.02
    text = data[0][1]
    n, hits = model.hits(text)
    assert n == len(slow_grams(text))
    found = np.clip((hits - n * model.false_rate) / (1 - model.false_rate), 0, None)
    assert model.predict(text)[:2] == (model.langs[int(found.argmax())], pytest.approx(found.max() / found.sum()))
    out = langid.identify(docs, model).select("doc_id", "lang", "language.pred").collect()
    judged = [r for r in out if held.get(r.doc_id) and r.lang in alphabet]
    assert len(judged) > 30 and all(r.pred == r.lang for r in judged)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.train(docs)).filter(langid.is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("language.pred") != "und"))
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("language.pred"))).first()
    assert n > 200 and right >= 0.98 * n


def slow_repeats(pages_, many, share, run, block_run):
    """Covered (page, word) of unmarked pages of one host, all blocks own."""
    owners = defaultdict(set)
    same = {i: tuple(blocks) for i, blocks in pages_.items()}
    spots = []
    for i, blocks in pages_.items():
        words = [b.split(" ") for b in blocks]
        at = 0
        for k, w in enumerate(words):
            for j in range(len(w) - run + 1):
                spots.append((i, at + j, run, ("run", tuple(w[j : j + run]))))
            whole, n = [], 0
            for m in range(k, len(words)):
                whole.append(tuple(words[m]))
                n += len(words[m])
                if n >= block_run:
                    spots.append((i, at, n, ("blocks", tuple(whole))))
                    break
            at += len(w)
    for i, *_, key in spots:
        owners[key].add(same[i])
    n_pages = len(set(same.values()))
    return {(i, at + j) for i, at, n, key in spots if len(owners[key]) >= many and len(owners[key]) >= share * n_pages for j in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_host_repeats(spark, seed):
    rng = random.Random(seed)
    stock = [[f"s{k}_{j}" for j in range(n)] for k, n in enumerate([2, 4, 7, 33, 45, 40])]
    made = {}
    for i in range(14):
        blocks = []
        for _ in range(rng.randrange(1, 7)):
            own = [f"p{i}_{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 6))]
            blocks.append(own + rng.choice(stock) if rng.random() < 0.7 else own or ["x"])
        made[i] = [" ".join(b) for b in blocks]
    made[14] = made[3]  # an exact copy is no further page
    data = [(i, "http://h.org/", "".join(f"<p>{b}</p>" for b in blocks)) for i, blocks in made.items()]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    covered = slow_repeats(made, pages.MANY, pages.SHARE, pages.RUN, pages.BLOCK_RUN)
    assert covered
    for i, blocks in made.items():
        want, at = [], 0
        for b in blocks:
            kept = [w for j, w in enumerate(b.split(" ")) if (i, at + j) not in covered]
            at += b.count(" ") + 1
            want += [" ".join(kept)] if kept else []
        assert got[i] == "\n".join(want)


def test_quality_score(spark, monkeypatch):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    text = lambda words: " ".join(rng.choice(words) for _ in range(70))
    data = [(i, text(good if i % 3 else bad)) for i in range(90)] + [(None, None), (91, ""), (92, "### |x| &&")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    half = {r.trusted_id: r.half for r in quality.trusted_ids(labels).collect()}
    bucket = lambda *w: spark.range(1).select(F.pmod(F.xxhash64(*[F.lit(x) for x in w]), F.lit(quality.BUCKETS))).first()[0]
    grams = {i: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:], strict=False)) for i, t in data if t}
    distinct = sorted({g for x in grams.values() for g in x})
    rows = spark.createDataFrame([(k, list(g)) for k, g in enumerate(distinct)], "k int, g array<string>")
    one = F.when(F.size("g") == 1, F.xxhash64(F.col("g")[0])).otherwise(F.xxhash64(F.col("g")[0], F.get("g", 1)))
    of = {distinct[r.k]: r.b for r in rows.select("k", F.pmod(one, F.lit(quality.BUCKETS)).alias("b")).collect()}
    assert of[distinct[0]] == bucket(*distinct[0])
    raw, trusted = Counter(), Counter()
    for i, x in grams.items():
        raw.update(of[g] for g in x)
        if half.get(i) == 0:
            trusted.update(of[g] for g in x)
    all_n, all_g, a = sum(raw.values()), sum(trusted.values()), quality.ALPHA
    ratio = lambda b: math.log((trusted[b] + a) / (all_g + a * quality.BUCKETS)) - math.log((raw[b] + a) / (all_n + a * quality.BUCKETS))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).select("doc_id", "quality.*").collect()}
    score = {i: sum(ratio(of[g]) for g in x) / len(x) for i, x in grams.items()}
    assert all(got[i].score == pytest.approx(s, abs=1e-5) for i, s in score.items()) and got[None].score == 0
    threshold = model.first().threshold
    kept_back = sorted(score[i] for i, h in half.items() if h == 1)
    assert kept_back[0] - 1e-5 <= threshold <= 0
    assert all(got[i].kept == (not got[i].base_failed and got[i].score >= threshold) for i in grams)
    assert [got[i].kept for i in range(1, 80)].count(True) >= 52 and not any(got[i].kept for i in range(0, 80, 3))
    assert got[92].n_symbols == 7 and got[None].n_symbols == 0
    none = quality.judge(docs, quality.fit(docs, labels.limit(0))).select("quality.*").collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in none)


def test_shards_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 50)
    data = [(None, None)] * 700 + [(7, "same")] * 300 + [(i, f"text {i}") for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sharding.external_shuffle(docs, 8, bucket_bytes=100).select("doc_id", "shard", "slot").collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in data)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.external_shuffle(docs.repartition(3), 8, bucket_bytes=100).select("doc_id", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    place = sorted(8 * r.slot + r.shard for r in got if r.doc_id is None)
    assert np.mean(place) == pytest.approx(750, abs=60)  # scattered, not in one bucket
    assert np.std(place) == pytest.approx(1500 / 12**0.5, rel=0.1)


def test_heads_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 7)
    base = [f"w{i}" for i in range(200)]
    data = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 0.85).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60


def test_notices_are_operands():
    auto = licenses.automaton()
    of = lambda t: licenses.scan_text(auto, t)[7:]
    assert of("under the MIT license or (the ISC license and CC0)") == (["mit isc cc0 and or"], True)
    assert of("Under the MIT license, and the GNU General Public License") == (["mit gpl and"], False)
    assert of("(under the mit license and cc by nc) or the isc license. Words between. CC0") == (["mit cc-by-nc and isc or", "cc0"], True)
    assert of("cc by nc or else cc0") == (["cc-by-nc", "cc0"], False)
    assert of("SPDX-License-Identifier: (MIT OR\n // Apache-2.0)\nAND GPL-3.0-only") == (["MIT Apache-2.0 or"], True)
    assert of("SPDX-License-Identifier: " + "MIT AND " * 70 + "GPL-3.0-only")[1] is False
    assert of("no licence") == ([], None) == of(None)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(empty, labels).count() == langid.keep_known(empty).count() == neardup.keep_one(empty).count() == 0
    common.drop_all(spark)
