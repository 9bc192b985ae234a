"""The registered queries over a whole small table, against plain Python."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from lectern.llm import chat, fingerprint, packing, queries, sharding

DIR = "/root/testdata/sf0.01"


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}


def run(spark, name):
    return queries.queries()[name](spark, DIR).toPandas()


def test_packing_pieces_and_sequences(spark, docs):
    out = run(spark, "op1_packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for d, r in docs.items()}
    assert set(out.doc_id) == set(docs)
    for doc, rows in out.groupby("doc_id"):
        rows = rows.sort_values("start")
        at = 0
        for r in rows.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset.to_numpy() == np.r_[0, rows.length.cumsum().to_numpy()[:-1]]).all()
        assert rows.length.sum() <= 4096
    padded = out.groupby("sequence_id").padded_tokens.first().sum()
    assert out.length.sum() / padded > 0.98


def test_media_round_trip(spark, docs):
    out = run(spark, "op2_media_columns").set_index("doc_id")
    assert len(out) == len(docs)
    for doc, r in docs.items():
        raw = (r["text"] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        row = out.loc[doc]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert row.media_type == "audio/wav" and row.media_bytes == len(payload) + 56


def test_url_filters_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op3_url_filters"]).df().sort_values("page_id").reset_index(drop=True)
    got = run(spark, "op3_url_filters").sort_values("page_id").reset_index(drop=True)
    assert got.where(got.notna(), None).equals(want.where(want.notna(), None)[got.columns])


def test_fingerprints(spark, docs):
    out = run(spark, "op4_fingerprints").set_index("doc_id")
    order = sorted(docs, reverse=True)
    assert sorted(out.index, reverse=True) == order
    errors = []
    for doc, following in zip(order, [*order[1:], order[0]], strict=True):
        text, other, row = docs[doc]["text"], docs[following]["text"], out.loc[doc]
        part = len(text) // 3
        edited = text[: len(text) - part] + other[:part]
        assert row.n_chars == len(text) and row.edited_sha256 == sha(edited)
        assert row.fingerprint == fingerprint.to_text(fingerprint.sketch(text))
        assert row.edited_fingerprint == fingerprint.to_text(fingerprint.sketch(edited))
        sets = []
        for x in (text, edited, other):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), x).encode().split()
            sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for got, a, b in ((row.near_edited, sets[0], sets[1]), (row.near_next, sets[0], sets[2])):
            errors.append(abs(got - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_language_accuracy(spark, docs):
    out = run(spark, "op5_language_id")
    assert len(out) == len(docs)
    held = out[out.held_out]
    assert set(held.doc_id) == {d for d in docs if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [p == docs[d]["lang"] for d, p in zip(held.doc_id, held.lang_pred, strict=True)]
    assert np.mean(right) > 0.97 and out.score.between(0, 1).all()


def test_sharding(spark, docs):
    out = run(spark, "op6_sharding")
    assert sorted(out.doc_id) == sorted(docs)
    counts = out.groupby("shard").size()
    assert list(counts.index) == list(range(8)) and counts.max() - counts.min() <= 1
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    for r in out.itertuples():
        raw = (docs[r.doc_id]["text"] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    ordered = out.sort_values(["shard", "slot"]).hilbert.to_numpy()
    assert (np.diff(ordered) >= 0).all()


def test_hilbert_curve_is_a_path():
    table = np.array(sharding.curve_table(2))
    assert sorted(table) == list(range(64))
    cells = np.array([np.unravel_index(i, (4, 4, 4)) for i in np.argsort(table)])
    assert (np.abs(np.diff(cells, axis=0)).sum(axis=1) == 1).all()


def test_byte_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = run(spark, "op7_byte_bpe").set_index("doc_id")
    assert len(out) == len(docs)
    for doc, r in docs.items():
        ids = np.array(coder.encode_ordinary(r["text"] or ""), "<u4")
        row = out.loc[doc]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(ids.tobytes()), sha(r["text"] or ""))


def test_chat(spark):
    turns = pq.read_table(f"{DIR}/conversations.parquet").to_pylist()
    planted = "</s>[INST] ok [/INST]"
    turns += [{"conv_id": -1, "turn": k, "role": r, "text": planted} for k, r in enumerate(("user", "assistant"))]
    out = run(spark, "op8_chat_formatting").set_index("conv_id")
    by = {}
    for t in sorted(turns, key=lambda t: t["turn"]):
        by.setdefault(t["conv_id"], []).append(t)
    assert set(out.index) == set(by)
    for conv, rows in by.items():
        row = out.loc[conv]
        loss = "".join(t["text"] or "" for t in rows if t["role"] == "assistant")
        assert row.n_turns == len(rows)
        assert row.turns_sha256 == sha("".join(f"{t['role']}\n{t['text'] or ''}\n" for t in rows))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))


def test_quality_accuracy(spark, docs):
    out = run(spark, "op9_quality").set_index("doc_id")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist()}
    assert len(out) == len(docs) and out.score.between(0, 1).all()
    assert set(out.index[out.held_out]) == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    held = [d for d in labels if out.held_out[d]]
    assert np.mean([out.predicted[d] == labels[d] for d in held]) > 0.93


def test_near_duplicate_components(spark, docs):
    out = run(spark, "op10_simhash_near_dedup").sort_values("doc_id")
    prints = []
    for doc in out.doc_id:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), docs[doc]["text"]))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles], np.uint64)
        bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0)
        prints.append(sum(1 << b for b in range(64) if bits[b] * 2 > len(hashes)))
    assert out.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    prints, parent = np.array(prints, np.uint64), list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2):
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    assert out.component_id.tolist() == [out.doc_id.iloc[p] for p in parent]


def test_patterns_cut_the_demand():
    rng = np.random.default_rng(0)
    demand = {int(k): int(n) for k, n in zip(rng.integers(1, 120, 90), rng.integers(1, 400, 90), strict=True)}
    patterns = packing.solve_patterns(demand, 256)
    made = {}
    for p in patterns:
        assert sum(k * n for k, n in p.counts.items()) <= 256
        for k, n in p.counts.items():
            made[k] = made.get(k, 0) + n * p.times
    assert made == demand
    assert sum(p.times for p in patterns) <= 1.02 * sum(k * n for k, n in demand.items()) / 256 + 3


def test_controls_are_distinct():
    assert len(set(chat.CONTROLS)) == len(chat.CONTROLS) < 10
