"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import bisect
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import bpe, chat, common, components, fingerprint, langid, media, nearcopies, packing, quality, sharding, simhash, urlfilter

DIR = "/root/testdata/sf0.001"
WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that operators use inside.
CLASH = ("fp", "key", "bucket", "score", "rank", "class", "window", "slot", "place", "row", "h", "size", "component", "media", "label", "start")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity; doc_id 5 is repeated, 7 has no id."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(60_000))
    rows = [(1, "A short text.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, long, "de", "s"), (5, "same text here now", "en", "s"), (5, "same text here now", "en", "s"),
            (6, "same text here now", "fr", "t"), (None, "no id at all", "en", "s"), (8, "\t \n", "en", None), (9, "x" * 300_000, "es", "s"), (10, "éÉ … 12 😀\r\n\0", "fr", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("n_chars", F.length("text").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def language_model(spark):
    return langid.train(spark.read.parquet(f"{DIR}/documents.parquet"))


@pytest.fixture(scope="module")
def quality_model(spark):
    return quality.train(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))


def test_packing(odd, none):
    out = packing.pack_documents(odd, WORDS).toPandas()
    whole = out.groupby(out.doc_id.fillna(-1)).length.sum()
    assert whole[2] == whole[3] == whole[8] == 1 and whole[5] == 2 * whole[6]
    assert set(out.doc_id.fillna(-1)) == {-1, 1, 2, 3, 4, 5, 6, 8, 9, 10}
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()
    power = out.sequence_tokens.map(lambda n: n & (n - 1) == 0)
    assert (out.padded_tokens == out.sequence_tokens.where(power, 4096)).all()
    assert packing.pack_documents(none, WORDS).count() == 0
    assert packing.solve_patterns({}, 256) == []


def test_short_documents_are_packed_tightly(spark):
    """Pieces of a few tokens, all with one id or none, fill their sequences."""
    rows = [(None if k % 2 else 7, 0, 4 + k * k % 16) for k in range(20_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long").repartition(4).checkpoint()
    out = packing.pack_pieces(pieces, rank_rows=300).toPandas()
    assert len(out) == len(rows) and sorted(out.length) == sorted(x for _, _, x in rows)
    assert out.length.sum() / out.groupby("sequence_id").padded_tokens.first().sum() > 0.97
    assert (out.sort_values("offset").groupby("sequence_id").length.apply(lambda x: x.cumsum().shift(fill_value=0)).to_numpy() == out.sort_values(["sequence_id", "offset"]).offset.to_numpy()).all()


def test_joined_classes_pad_little():
    rng = random.Random(7)
    for demand in ({rng.randint(1, 4096): rng.randint(1, 900) for _ in range(500)}, {1: 10**6, 4096: 5}, {k: 1 for k in range(1, 33)}, {}):
        joined = packing.joined_classes(demand)
        assert joined.keys() == demand.keys() and all(k <= v < k + 16 for k, v in joined.items())
        assert sum((joined[k] - k) * n for k, n in demand.items()) <= 0.002 * sum(k * n for k, n in demand.items())


def test_size_classes(spark):
    found = spark.range(1, 4097).select("id", packing.class_size(F.col("id"), 4096).alias("c")).toPandas()
    assert (found.c >= found.id).all() and (found.c <= found.id * 33 / 32 + 15).all() and (found.c[:32] == found.id[:32]).all() and found.c.nunique() == 320 and found.c.max() == 4096



def test_media(odd, none, spark):
    out = media.carve(media.store_as_samples(odd)).toPandas()
    assert len(out) == 11 and (out.media_type == "audio/wav").all()
    assert sorted(out[out.key.isin([2, 3])].n_samples) == [0, 0] and (out.samples.map(len) % 64 == 0).all() and (out.samples.map(len) > 0).all()
    assert media.carve(media.store_as_samples(none)).count() == 0
    png = bytes.fromhex("89504e470d0a1a0a0000000d4948445200000001000000010806000000" + "1f15c4890000000a49444154789c63000100000500010d0a2db40000000049454e44ae426082")
    wav = media.wav_file(b"RIFF fake GIF89a %PDF-1.4 BM inside")
    rows = [(1, "image/gif", png), (2, "image/png", b"junk" + wav + b"xx" + png), (3, "image/png", None), (4, None, b""), (5, "text/plain", b"RIFF\0\0\0\0WAVE"), (6, "image/png", png[:-3])]
    data = spark.createDataFrame(rows, "key long, declared_type string, media binary")
    found = {(r.key, r.ordinal): r for r in media.carve(data).collect()}
    assert found[1, 0].media_type == "image/png" and found[1, 0].length == len(png)
    assert (found[2, 0].offset, found[2, 0].length, bytes(found[2, 0].samples)) == (4, len(wav), b"RIFF fake GIF89a %PDF-1.4 BM inside")
    assert bytes(found[2, 1].media) == png and (2, 2) not in found
    assert all(found[k, -1].media is None for k in (3, 4, 5, 6)) and found[5, -1].media_type == "text/plain" and found[6, -1].media_type == media.UNKNOWN
    fixed = {r.key: (r.media_type, r.corrected) for r in media.corrected_types(data).collect()}
    assert fixed[1] == ("image/png", True) and fixed[5] == ("text/plain", False)


def test_media_validators():
    import gzip
    import io
    import zipfile

    packed = gzip.compress(b"some text" * 50)
    assert media.sniff(b"__" + packed + b"tail") == [media.Found("application/gzip", 2, len(packed))]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("a.txt", "hello")
    assert media.sniff(book.getvalue() + b"zz") == [media.Found("application/zip", 0, len(book.getvalue()))]
    gif = b"GIF89a\x01\0\x01\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    bmp = b"BM" + (58).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(40)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd data \xff\xd9"
    pdf = b"%PDF-1.4 body startxref 9 %%EOF"
    for raw, kind in ((gif, "image/gif"), (bmp, "image/bmp"), (jpeg, "image/jpeg"), (pdf, "application/pdf")):
        assert media.sniff(b"--" + raw + b"--") == [media.Found(kind, 2, len(raw))]
        assert media.sniff(raw[:-1]) == []


def test_pdf_of_several_revisions():
    """Updated and linearised files end at their last section, which does not reach into another file."""
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd data \xff\xd9"
    first = b"%PDF-1.4 body xref trailer startxref\n14\n%%EOF\n"
    updated = first + b"5 0 obj stream " + jpeg + b" endstream xref trailer startxref\r\n50\r\n%%EOF"
    linear = b"%PDF-1.5 first xref startxref\n0\n%%EOF\nrest " + jpeg + b" startxref\n15\n%%EOF"
    for raw in (updated, linear, updated + b" 6 0 obj startxref 70 %%EOF"):
        assert media.sniff(b"--" + raw + b"--") == [media.Found("application/pdf", 2, len(raw))]
    two = media.sniff(updated + b"\n" + linear)
    assert two == [media.Found("application/pdf", 0, len(updated)), media.Found("application/pdf", len(updated) + 1, len(linear))]
    beside = media.sniff(first + jpeg + b" startxref 99999 %%EOF")
    assert beside == [media.Found("application/pdf", 0, len(first) - 1), media.Found("image/jpeg", len(first), len(jpeg))]


@pytest.mark.parametrize("unit", [b"%PDF-1.4 ", b"PK\x03\x04 ", b"\xff\xd8\xff\xda\0\x02", b"GIF89a" + bytes(7) + b"!\xff\x01a\0", b"\x1f\x8b\x08\0", b"%PDF-1.4 startxref 5 "])
def test_sniffing_takes_linear_time(unit):
    import time

    def seconds(n):
        data, began = unit * n, time.process_time()
        media.sniff(data)
        return time.process_time() - began

    seconds(1000)
    assert min(seconds(40_000) for _ in range(3)) < 14 * max(min(seconds(8000) for _ in range(3)), 0.004)


def test_stored_form_and_features(spark):
    """The file byte by byte, and the features by their definitions."""
    import math
    import struct

    for text in ("", "aé" * 50, "x" * 64):
        raw = text.encode()
        samples = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        row = media.carve(media.store_as_samples(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
        head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"fact" + struct.pack("<II", 4, len(raw)) + b"data" + struct.pack("<I", len(samples))
        assert bytes(row.media) == b"RIFF" + struct.pack("<I", len(head) + len(samples)) + head + samples
        mean = sum(samples) / len(samples)
        sd = math.sqrt(max(0, sum(x * x for x in samples) / len(samples) - mean**2))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(samples, samples[1:], strict=False))
        shares = [samples.count(v) / len(samples) for v in set(samples)]
        entropy = -sum(p * math.log2(p) for p in shares)
        assert row.feature.replace("-0.0000", "0.0000") == f"n={len(samples)};mean={mean:.4f};sd={sd:.4f};crossings={crossings};entropy={abs(entropy):.4f}"


def test_corrected_types_with_clashing_columns(spark):
    rows = [(1, "text/plain", media.wav_file(b"ab" * 32), "x"), (None, None, None, "y"), (2, "image/png", b"", "z")]
    data = spark.createDataFrame(rows, "key long, declared_type string, media binary, media_type string").withColumn("offset", F.lit("x")).withColumn("corrected", F.lit("x"))
    found = {r.key: (r.media_type, r.corrected) for r in media.corrected_types(data).collect()}
    assert found == {1: ("audio/wav", True), None: (None, False), 2: (media.UNKNOWN, True)}
    assert media.corrected_types(data.limit(0)).count() == 0


def test_url_filters(spark):
    rules = spark.createDataFrame([("a.b", "/", "block"), ("B", "/x/", "allow"), ("a.b", "/", "allow"), (None, "/", "block"), ("c", "", "block")], "host string, path string, verdict string")
    urls = ["http://a.b/x/1", "HTTP://A.B", "http://z.a.b/?q", "http://ab/", "http://b/x/y#f", "http://xb/x/", None, "", "no scheme", "http://c?x", "http://q.c", "http://B/x", "http://a.b:80/"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(urls)] + [(0, urls[0], "h", "p"), (None, urls[0], "h", "p")], "page_id long, url string, key string, host string")
    out = urlfilter.judge_urls(pages, rules, sweep_rows=2).collect()
    assert len(out) == len(urls) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    # a.b/ and b/x/ are equally long: the longer host wins
    assert got[0] == ("a.b", "/x/1", "a.b/", "block")
    assert got[1] == ("a.b", "", None, "allow") and got[2] == ("z.a.b", "/", "a.b/", "block") and got[3][2] is None
    assert got[4] == ("b", "/x/y", "b/x/", "allow")
    assert got[5][2] is None and got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("c", "", "c", "block") and got[10] == ("q.c", "", "c", "block") and got[11][2] is None and got[12][2] is None
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filters_against_brute_force(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "c", "aa", "a-b"])
    host = lambda n: ".".join(label() for _ in range(rng.randint(1, n)))
    path = lambda n: "/" + "".join(label() + "/" for _ in range(rng.randint(0, n)))
    rules = sorted({(host(2), path(2)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    pages = [(k, host(4), path(4)) for k in range(2000)]
    out = urlfilter.judge_urls(
        spark.createDataFrame([(k, f"http://{h}{p}") for k, h, p in pages], "page_id long, url string"),
        spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"), sweep_rows=100,
    )
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    for k, h, p in pages:
        fits = [(len(rh + rp), len(rh), rh + rp, v) for (rh, rp), v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        assert got[k] == (max(fits)[2:] if fits else (None, "allow"))


def test_fingerprints(odd, none):
    out = fingerprint.edit_likeness(odd).toPandas()
    assert len(out) == 11 and out.doc_id.isna().sum() == 1
    assert out.fingerprint[out.doc_id.isin([2, 3, 8])].eq("").all() and out.near_edited.between(0, 1).all()
    last = out[out.doc_id.isna()].iloc[0]
    assert last.n_chars == 12  # its successor is the greatest id's text
    assert fingerprint.edit_likeness(none).count() == 0
    one = odd.where("doc_id = 1")
    assert fingerprint.edit_likeness(one).first().edited_sha256 == __import__("hashlib").sha256(b"A short tA sh").hexdigest()


def test_fingerprint_estimates():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 4000, 9000)]
    a, b = " ".join(words[:6000]), " ".join(words[3000:])
    sa, sb = fingerprint.sketch(a), fingerprint.sketch(b)
    sets = [{tuple(x.split()[i : i + 5]) for i in range(len(x.split()) - 4)} for x in (a, b)]
    assert abs(fingerprint.resemblance(sa, sb) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.15
    assert abs(fingerprint.containment(sa, sb) - len(sets[0] & sets[1]) / len(sets[0])) < 0.2
    assert abs(fingerprint.distinct_shingles(sa) / len(sets[0]) - 1) < 0.3
    assert (fingerprint.merge(sa, sb) == np.unique(np.r_[sa, sb])[:128]).all()
    assert (fingerprint.from_text(fingerprint.to_text(sa)) == sa).all()


def test_merged_sketches_are_those_of_the_whole(spark):
    """Parts by key, one key with most of them, merge into the sketch of all their shingles."""
    rng = random.Random(4)
    rows = [(None if k % 9 == 0 else k % 2 and k % 5, "k", " ".join(str(rng.randint(0, 900)) for _ in range(rng.choice([0, 3, 200])))) for k in range(400)]
    parts = spark.createDataFrame(rows, "key long, held string, text string").repartition(6).select("key", "held", fingerprint.fingerprint(F.col("text")).alias("fp"))
    found = {r.key: r.fp for r in fingerprint.merge_sketches(parts, "key", col="fp").collect()}
    want = {}
    for key, _, text in rows:
        want.setdefault(key, set()).update(fingerprint.shingle_hashes(text).tolist())
    assert found == {k: fingerprint.to_text(np.sort(np.array(list(v), np.uint64))[:128]) for k, v in want.items()}
    assert fingerprint.merge_sketches(parts.limit(0), "key", col="fp").count() == 0
    assert len(fingerprint.merge_sketches(parts, col="fp").collect()) == 1


def test_fingerprint_likeness_columns(odd):
    pair = odd.where("doc_id = 6").select(fingerprint.fingerprint(F.col("text")).alias("a"))
    found = pair.select(fingerprint.likeness(F.col("a"), F.col("a")).alias("x")).first()["x"]
    assert found["resemblance"] == 1.0 and found["containment"] == 1.0 and found["distinct"] == 1.0


def test_language(odd, none, language_model, spark):
    out = langid.identify_languages(odd, language_model).toPandas()
    assert len(out) == 11 and out.score.between(0, 1).all()
    assert set(out.lang_pred[out.doc_id.isin([2, 3, 8])]) == {"und"} and "und" not in set(out.lang_pred[out.doc_id == 10])
    assert langid.identify_languages(none, language_model).count() == 0
    with pytest.raises(ValueError):
        langid.train(none)
    with pytest.raises(ValueError):
        langid.train(odd.withColumn("lang", F.lit(None).cast("string")))


def test_long_texts_are_marked_whole():
    text = "ab " * 200_000 + "zq"
    flags, tail = np.zeros(langid.BUCKETS, np.uint8), np.zeros(langid.BUCKETS, np.uint8)
    langid.mark(text, flags)
    langid.mark("zq", tail)
    assert (flags[tail > 0] == 1).sum() >= tail.sum() - 2


def _tongues(rng):
    """Four invented languages of unlike letters, two of them with thousands of signs, as functions from a length to a text."""

    def words(alphabet):
        share = [rng.random() ** 3 for _ in alphabet]
        known = ["".join(rng.choices(alphabet, share, k=rng.randint(2, 9))) for _ in range(60_000)]
        return lambda n: " ".join(rng.choices(known, k=n // 6))

    han, kana = [chr(0x4E00 + k) for k in range(3000)], [chr(0x3042 + k) for k in range(70)]
    share = [1 / (k + 10) for k in range(3000)]
    chinese = lambda n: "".join(rng.choices(han, share, k=n))
    japanese = lambda n: "".join(x if rng.random() < 0.4 else rng.choice(kana) for x in rng.choices(han, share, k=n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {"xa": words(letters), "xb": words(letters), "zh": chinese, "ja": japanese}


def test_very_long_texts_keep_their_language(spark):
    """Texts with enough n-grams to set every place are told apart as short ones are."""
    tongues = _tongues(random.Random(8))
    rows = [(name, f(rnd)) for name, f in tongues.items() for rnd in (300, 900, 2500) * 20]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    names, sizes = list(tongues), {"xa": 2_000_000, "xb": 2_000_000, "zh": 400_000, "ja": 400_000}
    assert langid.predict(model, [tongues[x](600) for x in names])[0] == names
    found, scores = langid.predict(model, [tongues[x](sizes[x]) for x in names])
    assert found == names and scores.min() > 0.5


def test_every_language_is_learned(spark):
    """More languages than a fixed number, each of few texts, and a sample that would miss some."""
    rng = random.Random(9)
    own = {f"l{k:03}": [chr(0x4E00 + 20 * k + j) for j in range(20)] for k in range(230)}
    text = lambda name: " ".join("".join(rng.choices(own[name], k=4)) for _ in range(30))
    rows = [(name, text(name)) for name in own for _ in range(5)] + [("l000", "12 34"), (None, "none")]
    data = spark.createDataFrame(rows, "lang string, text string")
    for each in (400, 1):
        model = langid.train(data, sample_per_language=each)
        assert model.languages == list(own)
        assert langid.predict(model, [text(x) for x in own])[0] == list(own)


def test_copies_do_not_crowd_out_languages(spark):
    """One text copied very often beside few others: all languages are learned, and a text's copies count once."""
    words = {"en": "the cat sat on this mat with that hat", "fr": "le chat est sous une table avec des amis"}
    rng = random.Random(1)
    some = lambda x: " ".join(rng.choices(words[x].split(), k=12))
    few = [(x, some(x)) for x in words for _ in range(50)]
    copied = spark.range(30_000).select(F.lit("fr").alias("lang"), F.lit("le chat est ici " * 3).alias("text"))
    model = langid.train(copied.unionByName(spark.createDataFrame(few, "lang string, text string")))
    assert model.languages == ["en", "fr"] and len(model.landmarks) == 32
    assert langid.predict(model, ["the cat with that hat", "le chat est ici"])[0] == ["en", "fr"]


def test_kernel_counts_common_n_grams():
    """The kernel of two short texts against sets of their n-grams; hashing may lose few."""
    def grams(text):
        text = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
        return {text[i : i + n] for n in (1, 2, 3, 4) for i in range(len(text) - n + 1)}

    rng, errors = random.Random(6), []
    for _ in range(40):
        a, b = (" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(30)) + "!" for _ in range(2))
        maps = np.zeros((2, langid.BUCKETS), np.uint8)
        assert langid.mark(a, maps[0]) and langid.mark(b, maps[1])
        x = maps.astype(np.float32)
        got = langid._kernel(x[:1], x[:1].sum(axis=1), x[1:].T, x[1:].sum(axis=1))[0, 0]
        errors.append(abs(got - len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))))
    assert np.mean(errors) < 0.01 and max(errors) < 0.04


def test_more_languages_than_landmarks(monkeypatch):
    """Landmarks are bounded and handled in parts, languages aren't bounded."""
    rng = np.random.default_rng(3)
    own = [rng.random(langid.BUCKETS) < 0.02 for _ in range(40)]
    maps = np.array([np.packbits(own[k % 40] & (rng.random(langid.BUCKETS) < 0.7)) for k in range(400)])
    whole = langid.fit(maps, [f"{k % 40:02}" for k in range(400)])
    monkeypatch.setattr(langid, "_HELD", 7)
    parts = langid.fit(maps, [f"{k % 40:02}" for k in range(400)], chunk=33)
    assert np.allclose(whole.weights, parts.weights, atol=1e-3) and len(whole.languages) == 40
    monkeypatch.setattr(langid, "LANDMARKS", 25)
    few = langid.fit(maps, [f"{k % 40:02}" for k in range(400)])
    assert len(few.landmarks) == 25 and few.weights.shape == (26, 40)


def test_sharding(odd, none):
    out = sharding.hilbert_shards(odd, 3, chunk_rows=2).toPandas()
    assert len(out) == 11 and sorted(out.groupby("shard").size()) == [3, 4, 4]
    assert all(sorted(r.slot) == list(range(len(r))) for _, r in out.groupby("shard"))
    assert out["size"][out.doc_id == 2].tolist() == [1] and out.text_crc32[out.doc_id == 2].tolist() == [0]
    assert sharding.hilbert_shards(none).count() == 0
    assert sharding.hilbert_shards(odd.limit(1)).count() == 1


@pytest.mark.parametrize("few", [10_000, 40])
def test_sharding_tells_values_with_a_common_beginning_apart(spark, monkeypatch, few):
    """Shards cover ranges of sources that differ after their sixth byte only."""
    monkeypatch.setattr(sharding, "CUT_VALUES", few, raising=False)
    rows = [(k, "same size", ("zh-Hans-a", "zh-Hans-b")[k % 2], f"https://host{k % 160:03}.example/") for k in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.hilbert_shards(docs, 8).join(docs, "doc_id").toPandas()
    assert out.hilbert.nunique() >= 16
    # a shard of an eighth of all rows holds about a quarter of one language's sources
    assert out.groupby("shard").source.nunique().max() <= 80 and out.groupby("shard").lang.nunique().mean() < 2


def test_sharding_cuts_many_values_exactly(spark):
    """Steps of 24,000 distinct sources, some of them common, are those of all rows, whatever tasks hold them."""
    source = "CASE WHEN id % 9 = 0 THEN NULL WHEN id % 5 = 0 THEN 'https://7' ELSE concat('https://', md5(string(id))) END"
    docs = spark.range(36_000).selectExpr("id AS doc_id", "repeat('t', int(id * 7919 % 997)) AS text", "concat('l', id % 3) AS lang", f"{source} AS source")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        out = {r.doc_id: r.hilbert for r in sharding.hilbert_shards(docs).collect()}
    finally:
        spark.conf.unset(name)

    def steps(values):
        ranked = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
        cuts = sorted({ranked[-(-len(ranked) * k // 16) - 1] for k in range(1, 16)} - {None})
        return [0 if v is None else bisect.bisect_right(cuts, v) for v in values]

    rows = docs.orderBy("doc_id").collect()
    columns = [steps([r.lang for r in rows]), steps([r.source for r in rows]), steps([len(r.text) for r in rows])]
    table = sharding.curve_table()
    assert len({r.source for r in rows}) > 24_000
    assert [out[r.doc_id] for r in rows] == [table[(a * 16 + b) * 16 + c] for a, b, c in zip(*columns, strict=True)]


def test_written_shards_are_pruned(spark, odd, tmp_path):
    """Every row is written once, null and repeated ids too, and file statistics tell most files out of a small box."""
    import pyarrow.parquet as pq

    sharding.write_shards(odd, sharding.hilbert_shards(odd, 3), str(tmp_path / "odd"))
    back = spark.read.parquet(str(tmp_path / "odd"))
    order = lambda df: sorted(str(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars", "key").collect())
    assert order(back) == order(odd) and set(back.columns) == set(odd.columns) | {"shard", "run"}
    sharding.write_shards(odd.limit(0), sharding.hilbert_shards(odd.limit(0), 3), str(tmp_path / "none"))
    rows = [(k, "t" * (1 + k * 7919 % 997), f"l{k % 16:02}", f"s{k // 16 % 16:02}") for k in range(4096)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    sharding.write_shards(docs, sharding.hilbert_shards(docs), str(tmp_path / "w"))
    files = list((tmp_path / "w").rglob("*.parquet"))
    hit = 0
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
        hit += stats["lang"].min <= "l05" <= stats["lang"].max and stats["source"].min <= "s05" <= stats["source"].max
    assert len(files) == 128 and hit < 40


def test_hilbert_cell_of_a_row(spark):
    """Cells by exact quantiles of whole columns, indexed by the published algorithm's other form."""
    rows = [(k, "t" * (k * 31 % 800), f"lang{k % 7}", None if k % 11 == 0 else f"source{k % 13}") for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r.hilbert for r in sharding.hilbert_shards(docs).collect()}

    def steps(values):
        ranked = sorted(values, key=lambda v: (v is not None, v if v is not None else 0))
        cuts = {ranked[-(-len(ranked) * k // 16) - 1] for k in range(1, 16)} - {None}
        return [0 if v is None else sum(c <= v for c in cuts) for v in values]

    columns = [steps([r[2] for r in rows]), steps([r[3] for r in rows]), steps([len(r[1]) + 1 for r in rows])]
    table = sharding.curve_table()
    want = [table[(a * 16 + b) * 16 + c] for a, b, c in zip(*columns, strict=True)]
    assert [out[k] for k in range(2400)] == want


def test_bpe_with_another_pattern():
    """Pre-tokens that hold spaces are encoded as the pattern cuts them; arrays give what lists do."""
    ranks = {bytes([b]): b for b in range(256)} | {b"a ": 256, b" b": 257, b"a b": 258}
    coder = bpe.ByteBPE(ranks, "[ab ]+")
    assert coder.encode("a b") == [258] and coder.encode("a b\na b") == [258, 258]


def test_long_pre_tokens_in_arrays(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 256, b"aa": 258, b"aaa": 257, b"abc": 299, b"cab": 260}
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    want = bpe.ByteBPE(ranks, r"\S+").merge_all(pieces)
    monkeypatch.setattr(bpe, "_MANY", 1)
    assert bpe.ByteBPE(ranks, r"\S+").merge_all(pieces) == want


def test_bpe(odd, none):
    texts = {r.doc_id: r.text or "" for r in odd.select("doc_id", "text").collect()}
    out = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == 11 and all(bytes(r.decoded) == texts[r.doc_id].encode() for r in out)
    assert all(len(r.ids) == 0 for r in out if r.doc_id in (2, 3))
    assert bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_matches_a_plain_merge_loop():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 256, b"aa": 258, b"aaa": 257, b"abc": 299, b"cab": 260}
    coder = bpe.ByteBPE(ranks, r"\S+|\s+")
    rng = random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        parts = [bytes([b]) for b in piece]
        if piece in ranks:
            parts = [piece]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert coder.encode(piece.decode()) == [ranks[p] for p in parts]


CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "<|end|>", "~0~1<|x|>", "<", "|>", "", "a<|", "~"]


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["system", "user", "assistant"] * 3, CONTROL_TEXTS + [None], strict=True))]
    rows += [(2, 0, "user", "x" * 5000), (2, 1, "assistant", "y" * 9000), (2, 2, "user", "z")] + [(3, 0, None, "q"), (3, 0, None, "q"), (3, None, "assistant", "first"), (None, 1, "assistant", "lost")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 7)) for k in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("n", "s", "block", "tokens", "window", "parts", "system"):
        df = df.withColumn(name, F.lit("x"))
    return df


def _windows_by_hand(turns, budget, history_turns, history_tokens):
    """First turn, repeated turns' numbers and new turns' numbers of every window of one conversation."""
    turns = sorted(turns)
    size = [-(-len(text.encode()) // chat.TOKEN_CHARS) + chat.TURN_TOKENS for _, _, text in turns]
    system = turns[0][1] == "system"
    room = max(2, budget - history_tokens - (size[0] if system else 0))
    blocks = [number // chat.BLOCK_TURNS for number, _, _ in turns]
    longest = {b: max(s for s, c in zip(size, blocks, strict=True) if c == b) for b in blocks}
    cells, before, block = {}, 0, None
    for n, b in enumerate(blocks):
        if b != block:
            before, block = 0, b
        cells.setdefault((b, before // (room - min(room // 2, longest[b])), size[n] > room // 2), []).append(n)
        before += size[n]
    out = []
    for new in sorted(cells.values()):
        past, left = [], history_tokens
        for n in range(new[0] - 1, max(-1, new[0] - 1 - history_turns), -1):
            left -= size[n]
            if left < 0 or (system and n == 0):
                break
            past.insert(0, n)
        out.append((new[0], ([0] if system and new[0] else []) + past, new))
    return turns, out


@pytest.mark.parametrize("history_turns", [0, 2, 3])
def test_chat_history_crosses_blocks(spark, history_turns):
    rows = []
    for conv, step, opening in ((1, 1, "system"), (2, 300, "system"), (3, 300, "user"), (4, 86_400, "user"), (5, 100, "system")):
        for i in range(520 if step == 1 else 12):
            role = opening if i == 0 else ("user", "assistant")[i % 2]
            # conversation 5 has turns of over half the room
            rows.append((conv, i * step, role, f"{conv} {i} " + "word " * (i % 7 * (12 if conv == 5 else 1))))
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, history_turns, 60)
    found = sorted(made.collect(), key=lambda r: (r.conv_id, r.first_turn))
    expected = []
    for conv in range(1, 6):
        turns, cut = _windows_by_hand([r[1:] for r in rows if r[0] == conv], 200, history_turns, 60)
        for first, old, new in cut:
            assert new == list(range(new[0], new[-1] + 1))
            text = "".join(f"<|{turns[n][1]}|>{turns[n][2]}<|end|>" for n in old + new)
            expected.append((conv, first, len(old), len(new), text))
    assert [(r.conv_id, r.first_turn, r.n_repeated, r.n_turns, r.formatted) for r in found] == expected


def test_chat_counts_given_tokens(spark):
    rows = [(1, i, "user", "x" * 400, None if i == 3 else 6) for i in range(8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, size int")
    made = chat.windows(turns, 50, 0, 0, tokens_col="size").orderBy("first_turn").collect()
    # turns of 10 tokens begin within steps of 40
    assert [(r.first_turn, r.n_turns, r.n_tokens) for r in made] == [(0, 5, 44), (5, 3, 30)]


def test_chat(odd_turns):
    made = chat.windows(odd_turns, budget=200, history_tokens=40).cache()
    rows = made.collect()
    assert all(r.n_tokens <= 200 or r.n_turns == 1 for r in rows)
    assert all("</s>" not in r.formatted and "[INST]" not in r.formatted for r in rows)
    back = {}
    for r in sorted(chat.read_back(made).collect(), key=lambda r: (r.conv_id or 0, r.first_turn)):
        turns, targets = back.setdefault(r.conv_id, ([], []))
        assert r.first_turn == len(turns)
        turns += [(t.role, t.text) for t in r.turns]
        targets += r.targets
    source = {}
    order = lambda r: (r.conv_id or 0, r.turn is not None, r.turn or 0, r.role or "", r.text or "")
    for r in sorted(odd_turns.collect(), key=order):
        source.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert {k: t for k, (t, _) in back.items()} == source
    assert {k: x for k, (_, x) in back.items()} == {k: [t for r, t in v if r == "assistant"] for k, v in source.items()}
    one = [r for r in rows if r.conv_id == 1 and r.first_turn > 0]
    assert all(r.formatted.startswith("<|system~2") or r.formatted.startswith("<|system|>") for r in one)
    assert chat.windows(odd_turns.limit(0)).count() == 0


def test_quality(odd, none, quality_model, spark):
    out = quality.score_documents(odd, quality_model).toPandas()
    assert len(out) == 11 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.7)).all()
    assert out.score[out.doc_id.isin([2, 3])].nunique() == 1
    assert quality.score_documents(none, quality_model).count() == 0
    with pytest.raises(ValueError):
        quality.train(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))


def test_a_very_long_line_is_one(monkeypatch):
    """Counted block by block it has the bins of the line as a whole, wherever the borders fall."""
    assert len(quality.line_bins("x" * 520_000)[0]) == 1 and quality.line_bins("x" * 520_000)[1].tolist() == [520_000]
    rng = random.Random(2)
    for _ in range(60):
        words = rng.choices(["aa", "b", "...", "Éa", "!!!!", "12", "aa"], k=60)
        line = "".join(w + rng.choice([" ", "  ", "\t"]) for w in words).strip() + rng.choice(["", " "])
        whole = quality._count([line])
        monkeypatch.setattr(quality, "_BLOCK", rng.randint(3, 40))
        assert (quality._count_long(line) == whole).all()
        text = f"short\n{line}\n\nend"
        parts = quality.line_bins(text)
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(parts, quality.line_bins(text), strict=True))


def test_score_by_its_definition(quality_model):
    """Line measures, features, marginals and curve against loops over characters and label sequences."""
    import itertools
    import math

    def bins(line):
        words, n = line.split(), len(line)
        kind = [("U" if c.isupper() else "L") if c.isalpha() else "D" if c.isdigit() else "B" if c.isspace() else "P" if c in ".,;:!?'\"()-" else "S" for c in line]
        count = {k: kind.count(k) for k in "ULDBPS"}
        size, some, letters = max(n, 1), max(len(words), 1), count["U"] + count["L"]
        doubled = sum(a == b and k in "PS" for a, b, k in zip(line, line[1:], kind[1:], strict=False))
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        measures = (letters / size, count["U"] / max(letters, 1), count["D"] / size, count["P"] / size, count["S"] / size, count["B"] / size,
                    (n - count["B"]) / some, len(set(words)) / some, repeats / some, len(words), doubled / size, n)
        return [sum(e <= m for e in edges) for edges, m in zip(quality.EDGES, measures, strict=True)]

    m = quality_model
    for text in ("One line here.", "BUY!!! now now\n\nA decent line, with words in it.\n$$$ 12", "", "a\nb\nc d\n1 1 1"):
        lines = text.split("\n")
        own = [bins(x) for x in lines]
        edge = [quality.BINS - 1] * len(quality.EDGES)
        weight = m.weights.reshape(3, len(quality.EDGES), quality.BINS)
        evidence = [
            sum(weight[w][k][b[k]] for w, b in enumerate((own[t], own[t - 1] if t else edge, own[t + 1] if t + 1 < len(own) else edge)) for k in range(len(edge))) + m.bias
            for t in range(len(own))
        ]
        good, total = [0.0] * len(lines), 0.0
        for y in itertools.product((0, 1), repeat=len(lines)):
            p = math.exp(sum(e for e, v in zip(evidence, y, strict=True) if v) + m.couple * sum(1 if a == b else -1 for a, b in zip(y, y[1:], strict=False)))
            total += p
            good = [g + p * v for g, v in zip(good, y, strict=True)]
        sizes = [max(len(x), 1) for x in lines]
        raw = min(max(sum(g / total * n for g, n in zip(good, sizes, strict=True)) / sum(sizes), 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(m.slope * math.log(raw / (1 - raw)) + m.shift)))
        assert quality.score(m, text) == pytest.approx(want, abs=1e-9)


def test_quality_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    evidence, couple = rng.normal(size=6), 0.7
    weights = {}
    for k in range(64):
        y = [k >> t & 1 for t in range(6)]
        weights[k] = np.exp(sum(e for e, v in zip(evidence, y, strict=True) if v) + couple * sum(1 if a == b else -1 for a, b in zip(y, y[1:], strict=False)))
    total = sum(weights.values())
    want = [sum(w for k, w in weights.items() if k >> t & 1) / total for t in range(6)]
    assert np.allclose(quality.marginals(evidence, couple), want)
    node, _ = quality._expected(evidence[None, :], couple, np.ones((1, 6)))
    assert np.allclose(node[0], want)


def test_near_duplicates(odd, none):
    out = simhash.near_duplicates(odd).toPandas()
    by = {k: set(v.component_id) for k, v in out.groupby(out.doc_id.fillna(-1))}
    assert len(out) == 11 and by[5] == by[6] == {5} and by[2] == by[3] == by[8] == {2} and out.fingerprint[out.doc_id.isin([2, 3, 8])].eq("0" * 16).all()
    assert out.component_id[out.doc_id.isna()].isna().all()
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = list(base)
    for x in base:
        for _ in range(12):
            x = x ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
            prints.append(x)
    prints = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(df)).collect()}
    parent = {int(x): int(x) for x in prints.view(np.int64)}
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(a, b) and parent[a] != parent[b]:
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    assert {k: found.get(k, k) for k in ids} == parent


def _connected(spark, prints, **bounds):
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = {r.node: r.component for r in components.connected_components(simhash.link_fingerprints(df, **bounds)).collect()}
    return {int(x): found.get(int(x), int(x)) for x in prints.view(np.int64)}


def test_large_groups_agree_with_small(spark):
    """Members of a key with too many rows for a task meet by values one bit away."""
    rng = np.random.default_rng(7)
    bit = lambda: np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    group = np.unique(np.r_[np.uint64(12345) ^ bit() ^ bit(), np.uint64(1 << 50) ^ bit() ^ bit() ^ bit()])
    whole = _connected(spark, group)
    assert len(set(whole.values())) < len(group) - 300 and _connected(spark, group, group_rows=3) == whole


def test_groups_come_whole_or_in_pieces():
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(2).integers(0, 40, 3000) ** 2 // 40)
    keys = np.r_[keys, np.full(900, 99)]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[at : at + 70]), pa.array(np.arange(at, min(at + 70, len(keys))))], names=["k", "v"]) for at in range(0, len(keys), 70)]
    seen, whole = [], set()
    for (k, v), piece in common.keyed_groups(iter(batches), 100):
        assert len(k) <= 400 and (not piece or len(set(k)) == 1)
        seen += v.tolist()
        if not piece:
            assert not whole & set(k.tolist())
            whole |= set(k.tolist())
    assert seen == list(range(len(keys))) and 99 not in whole and len(whole) > 20


def _edited(rng, words, share, lexicon):
    words = list(words)
    for i in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = rng.choice(lexicon)
    return words


def _near_copies(seed=13):
    """Rows of texts and copies with more and less of their words changed, some long, some of few words."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = [rng.choices(lexicon, k=rng.choice([1, 3, 6, 40, 150, 400])) for _ in range(160)]
    texts += [_edited(rng, t, share, lexicon) for t in texts[:120] for share in (0.01, 0.02, 0.03, 0.05)]
    hub = rng.choices(lexicon, k=200)
    texts += [hub, *(_edited(rng, hub, 0.02, lexicon) for _ in range(90))]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def _by_brute_force(rows, similarity=0.8):
    """The least id of each text's group over all pairs of five-word shingle sets."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else {()} for _, t in rows]
    parent = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b) and parent[i] != parent[j]:
                low, high = sorted((parent[i], parent[j]))
                parent = [low if p == high else p for p in parent]
    return {rows[p][0] for p in parent}


@pytest.mark.parametrize("bounds", [{}, {"group_rows": 5}, {"block_shingles": 1500}], ids=["whole", "large keys", "several blocks"])
def test_near_copies_against_brute_force(spark, bounds):
    """All groups at a similarity of 0.8, also where keys and components are too large for one task."""
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.select("doc_id", *nearcopies.row_key())
    kept = {r.doc_id for r in keyed.join(nearcopies.representatives(docs, **bounds), ["key_a", "key_b"]).collect()}
    want = _by_brute_force(rows)
    assert len(rows) - len(want) > 150 and kept == want


def test_exact_links_are_all_found():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(300)]
    forest = components.Forest()
    for a, b in nearcopies.exact_links(sets, 0.6):
        assert len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9 and forest.union(a, b)
    for a in range(300):
        for b in range(a):
            alike = len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9
            assert not alike or forest.find(a) == forest.find(b)
    assert nearcopies.exact_links([], 0.8) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(400)] + [(1000, 1000), (2000, 2001)], "a long, b long").repartition(5)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(found[k] == 0 for k in range(401)) and found[2001] == 2000 and 1000 not in found
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, odd, none, stage):
    name, f = stage
    out = f(spark, odd, DIR)
    if name != "packing":
        assert out.columns == odd.columns
    assert out.count() <= (11 if name != "packing" else 1000)
    assert f(spark, none, DIR).count() == 0
    if name == "near_dedup":
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert sorted(x for x in kept if x is not None) == [1, 2, 4, 5, 9, 10] and kept.count(None) == 1


def test_near_dedup_keeps_one_of_each_component(spark):
    """Ids don't identify rows: many are null, and some are on two texts."""
    rng = random.Random(11)
    prose = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40)) for _ in range(9)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[2]), (None, prose[2]), (1, prose[3]), (None, prose[3]), (2, prose[4]), (2, prose[5]), (3, prose[6]), (4, prose[6].upper()), (4, prose[7]), (5, None), (None, ""), (6, prose[8]), (6, prose[8])]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, DIR).collect()))
    assert kept == sorted([(0, prose[0]), (0, prose[1]), (0, prose[2]), (1, prose[3]), (2, prose[4]), (2, prose[5]), (3, prose[6]), (4, prose[7]), (5, ""), (6, prose[8])])


def test_pipeline_by_hand(spark, language_model):
    """The whole run equals its stages in memory, decision by decision."""
    out = corpus_pipeline.run(spark, DIR).toPandas()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").toPandas()
    langs, scores = langid.predict(language_model, docs.text.tolist())
    docs = docs[[x != "und" and s >= corpus_pipeline.LANGUAGE_SCORE for x, s in zip(langs, scores, strict=True)]]
    model = quality.train(spark.createDataFrame(docs), spark.read.parquet(f"{DIR}/labels.parquet"))
    docs = docs[[quality.score(model, t) >= quality.THRESHOLD for t in docs.text]]
    assert set(out.doc_id) == _by_brute_force(sorted(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)))


def test_components_of_random_graphs(spark):
    """Stars, chains and tangles against union-find, each node once."""
    rng = random.Random(21)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(2000 + k, 2001 + k) for k in range(30)]
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    found = [(r.node, r.component) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert len(found) == len(nodes) and dict(found) == {x: forest.find(x) for x in nodes}
