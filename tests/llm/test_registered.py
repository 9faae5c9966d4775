"""The registered queries themselves, over the smallest tables: columns of their contracts, and their rows against brute force."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from mnemora.llm import media, queries

from .test_operators import BYTE, WORD, brute_fingerprint

CONTRACT = {
    "op1_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op2_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op6_chat": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_token_counts": ["length", "n_docs", "docs_up_to", "docs_longer", "tokens_up_to", "truncated_total", "total_docs", "total_tokens", "quantile"],
    "media_clips": ["doc_id", "clip", "first_frame", "end_frame", "start_s", "end_s"],
}


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns[: len(CONTRACT[name])] == CONTRACT[name]


def test_op2_op4_op5(spark, sf, documents):
    from tokenizers import Tokenizer

    prints = {i: brute_fingerprint(t) for i, t in documents.items()}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[a] > group[b] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a], changed = group[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", group[i]) for i, p in prints.items()}
    t = Tokenizer.from_file(BYTE)
    for r in queries.op4_bpe(spark, sf).collect():
        ids = t.encode(documents[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = queries.op5_media(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        data = documents[r["doc_id"]].encode()
        payload = media.padded(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_op3_and_op6(spark, sf, documents):
    from tokenizers import Tokenizer

    t, mine, level = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(int)
    for r in queries.op3_packing(spark, sf).orderBy("sequence_id", "offset").collect():
        assert level[r["sequence_id"]] == r["offset"]
        level[r["sequence_id"]] += r["length"]
        mine[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert max(level.values()) <= 4096 and set(mine) == set(documents)
    for i, text in documents.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        parts = [(k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted(mine[i]) == parts
    added = {r["conv_id"]: r for r in queries.op6_chat(spark, sf).collect()}[-7]
    assert (added["n_turns"], added["loss_chars"], added["loss_sha256"]) == (2, len(queries.HARD_TEXT), sha256(queries.HARD_TEXT.encode()).hexdigest())
    assert added["turns_sha256"] == sha256(f"user\n{queries.HARD_TEXT}\nassistant\n{queries.HARD_TEXT}\n".encode()).hexdigest()


def test_op8(spark, sf, documents):
    rows = {r["doc_id"]: r for r in queries.op8_quality(spark, sf).collect()}
    assert set(rows) == set(documents)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    by_text = defaultdict(set)
    for i, text in documents.items():
        by_text[text].add(rows[i]["score"])
    assert all(len(scores) == 1 for scores in by_text.values())


def test_op9(spark, sf, documents):
    from collections import Counter

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    lengths = Counter(len(t.encode(x, add_special_tokens=False).ids) for x in documents.values())
    total = sum(n * k for n, k in lengths.items())
    got = {r["length"]: r for r in queries.op9_token_counts(spark, sf).collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == dict(lengths)
    for limit, r in got.items():
        cut = sum(min(n, limit) * k for n, k in lengths.items())
        fit = sum(k for n, k in lengths.items() if n <= limit)
        assert (r["truncated_total"], r["docs_up_to"], r["docs_longer"], r["total_docs"], r["total_tokens"]) == (cut, fit, len(documents) - fit, len(documents), total)
        assert r["tokens_up_to"] == sum(n * k for n, k in lengths.items() if n <= limit) and abs(r["quantile"] - fit / len(documents)) < 1e-12


def brute_shots(payload):
    """Frames of 576 coefficients, each a byte less 128; samples, histograms and differences in plain loops over frames."""
    frames = media.read_avi(media.store(payload))[1]
    shares = []
    for header, coefficients in media.read_frames(frames):
        for picture in media.pictures(header, coefficients):
            level = np.asarray(picture).ravel() // (256 // media.BINS)
            shares.append([float((level == k).sum()) / level.size for k in range(media.BINS)])
    d = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 2 for x, y in zip(shares, shares[1:], strict=False)]
    starts = [0]
    for i, x in enumerate(d):
        near = [d[j] for j in range(max(0, i - media.AROUND), min(len(d), i + media.AROUND + 1)) if j != i]
        mean = sum(near) / max(1, len(near))
        spread = max(0.0, sum(v * v for v in near) / max(1, len(near)) - mean * mean) ** 0.5
        if x >= media.LEAST and x > mean + media.DEVIATIONS * spread + 1e-9:
            starts.append(i + 1)
    return list(zip(starts, [*starts[1:], len(frames)], strict=True))


def test_clips(spark, sf, documents):
    got = defaultdict(list)
    for r in queries.media_clips(spark, sf).orderBy("doc_id", "clip").collect():
        assert r["clip"] == len(got[r["doc_id"]]) and abs(r["start_s"] * media.FPS - r["first_frame"]) < 1e-6 and abs(r["end_s"] * media.FPS - r["end_frame"]) < 1e-6
        got[r["doc_id"]].append((r["first_frame"], r["end_frame"]))
    assert set(got) == set(documents)
    for i in sorted(documents)[:60]:
        assert got[i] == brute_shots(documents[i].encode()), i
