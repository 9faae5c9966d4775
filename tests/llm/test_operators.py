"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import bpe, chat, components, exact_dedup, licenses, line_dedup, media, packing, quality, queries, simhash, token_counts

BYTE, WORD = queries.tokenizer(queries.BYTE_VOCABULARY), queries.tokenizer(queries.WORD_VOCABULARY)
SPECIAL = ["", None, " ", "\t\n ", "a", "a b", "A  B", "x" * 5000, "wörd " * 3000, "ß Σ ΑΣ é é ﬁ", "<|endoftext|> a<|endoftext|>b ", "<|startoftext|>", " lead", "trail ", "two  spaces\n\n\nlines\r\n", "\x1c\x85  it's we'LL 123,456   日本語 🙂🙂"]


@pytest.fixture(scope="module")
def texts(spark):
    """Edge cases, repeated rows and ids, and columns named like results."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(SPECIAL)] + [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, t.replace(" ", "\n", 1) + " ") for i, t in enumerate(base[:20])] + [(300 + i, t + " " + vocabulary[i]) for i, t in enumerate(base[:20])]
    rows += [(None, base[0]), (None, "only here"), rows[20], rows[20], (7, "another text of that id")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    frame = spark.createDataFrame([(a, b, "en", "kept?") for a, b in texts], "doc_id long, text string, lang string, kept string")
    return frame.withColumns({c: F.lit(1) for c in ("fingerprint", "id", "norm", "h", "w", "sh", "score", "ids", "segment", "media", "n_lines", "place", "length", "group_size")}).repartition(3)


def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups["".join(c for c in t or "" if c not in "\x20\t\n\x0b\x0c\r")].append((i, len(t or "")))
    want = []
    for norm, members in groups.items():
        known = [m for m in members if m[0] is not None]
        keep = min((m for m in known), key=lambda m: (-m[1], m[0]))[0] if known else None
        want += [(i, keep, len(members), i == keep, sha256(norm.encode()).hexdigest()) for i, _ in members]
    got = [tuple(r)[:5] for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(empty(docs)).count() == 0


def test_exact_dedup_is_native(docs):
    assert "Python" not in docs.sparkSession._jvm.PythonSQLUtils.explainString(exact_dedup.exact_dedup(docs)._jdf.queryExecution(), "simple")


def brute_fingerprint(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("hot", [2048, 1])
def test_simhash_components(docs, texts, hot):
    prints = [brute_fingerprint(t) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [k for k, (i, _) in enumerate(texts) if i is not None]
    for a, b in combinations(known, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 or texts[a][0] == texts[b][0]:
            parent[root(a)] = root(b)
    least = {}
    for k in known:
        least[root(k)] = min(least.get(root(k), 1 << 60), texts[k][0])
    by_print = {prints[k]: least[root(k)] for k in known}
    want = [(i, f"{p:016x}", by_print.get(p)) for (i, _), p in zip(texts, prints, strict=True)]
    assert sorted(map(tuple, simhash.simhash_components(docs, hot_shard=hot).collect()), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(empty(docs)).count() == 0


def test_bk_tree_finds_all():
    rng = random.Random(1)
    values = [sum(1 << b for b in rng.sample(range(10), rng.randint(0, 10))) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert set(tree.within(v, 2)) == {x for x in values if (x ^ v).bit_count() <= 2}


def test_near_links_at_every_pair_of_bits(spark):
    base = 0x0123456789ABCDEF
    pairs = [(base, 0)] + [(base ^ (1 << i) ^ (1 << j), 1 + k) for k, (i, j) in enumerate(combinations(range(0, 64, 3), 2))]
    signed = [(v - (1 << 64) if v >> 63 else v, n) for v, n in pairs]
    nodes = spark.createDataFrame(signed, "fp long, node long")
    for hot in (2048, 2):
        linked = components.connected_components(simhash.near_links(nodes, hot))
        assert linked.where("component = 0").count() == len(pairs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a)
            label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == label


def test_packing_matches_tokenizers(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    want = []
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.packed_pieces(docs, WORD, capacity=256).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 256) + 3
    assert packing.packed_pieces(empty(docs), WORD).count() == 0


def test_sum_of_squares_chooses_the_least_sum():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 30, 400), 30
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    level = defaultdict(int)
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        def score(x):
            after = dict(level) | {x: level.get(x, 0) + n}
            counts = defaultdict(int)
            for v in after.values():
                counts[v] += v < capacity
            return sum(c * c for c in counts.values())

        choices = [x for x in level if level[x] + n <= capacity] + ["new"]
        assert score(b if b in level else "new") == min(map(score, choices))
        assert o == level.get(b, 0)
        level[b] += n
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([31]), 30)


def test_bpe_matches_tokenizers(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    want = sorted(((i, np.array(e.ids, "<u4").tobytes(), t.decode(e.ids, skip_special_tokens=False)) for i, e in ((i, t.encode(x or "", add_special_tokens=False)) for i, x in texts)), key=str)
    got = sorted(((r["doc_id"], bytes(r["ids"]), r["text"]) for r in bpe.bpe_decode(bpe.bpe_encode(docs, BYTE), BYTE).collect()), key=str)
    assert got == want
    assert bpe.bpe_encode(empty(docs), BYTE).count() == 0


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(BYTE), bpe._loaded(open(BYTE, "rb").read()), random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "1", "²", "é", "ß", "中", "🙂", "́", "\x1c", "\x85", " ", "　", "​", "!", "...", "<|endoftext|>", "<|", "_", "ǅ", "Ⅷ"]
    for _ in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s
    for n in (95, 96, 97, 3000):
        s = "".join(rng.choices("abcdefgh", k=n))
        assert own._scan([own.byte_id[b] for b in s.encode()]) == own._heap([own.byte_id[b] for b in s.encode()])
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


def test_bpe_knows_every_code_point():
    """Words around every fourth code point, and all the newest letters, as the library splits them."""
    from tokenizers import Tokenizer

    split, own = Tokenizer.from_file(BYTE).pre_tokenizer.pre_tokenize_str, bpe._loaded(open(BYTE, "rb").read())
    for cp in (*range(0, 0x3000), *range(0x3000, 0xD800, 4), *range(0xE000, 0x110000, 16), 0x558, 0xC5C, 0xA7CE, 0x10940, 0x323B0, 0x3D000):
        s = f"a{chr(cp)}1 {chr(cp)}!"
        assert own.find(s) == [s[x:y] for _, (x, y) in split(s)], hex(cp)


def test_word_encoder_on_random_strings():
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(WORD), packing._encoder(open(WORD, "rb").read()), random.Random(9)
    alphabet = ["a", "The", " ", "\n", "\t", "'s", "'LL", "1", "²", "É", "ß", "Σ", "ΑΣ", "中", "🙂", "́", "\x1c", "\x85", " ", "　", "!", "...", "<|endoftext|>", "<|", "_", "ǅ", "Ⅷ", "İ"]
    for _ in range(3000):
        s = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert np.frombuffer(next(own.encode_batch([s])), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


def test_media_round_trip(docs, texts):
    rows = media.media_digests(media.media_column(docs)).collect()
    want = sorted(((i, sha256(p := media.padded((t or "").encode())).hexdigest(), len((t or "").encode()), len(p)) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["payload_sha256"], r["n_bytes"], r["payload_bytes"]) for r in rows), key=str) == want
    assert all(r["payload_bytes"] % 576 == 0 < r["payload_bytes"] for r in rows)
    shots = media.clips(media.media_column(docs))
    assert shots.where("end_frame <= first_frame").count() == 0
    assert media.media_digests(media.media_column(empty(docs))).count() == 0


def test_media_scalar_decoder_agrees():
    data = bytes(random.Random(4).randbytes(576 * 3))
    frames = list(media.write_frames(data))
    fast = np.concatenate([c for _, c in media.read_frames(frames)])
    slow = np.stack([media.decode_scalar(media.parse_header(h), d) for h, d in map(media.split_frame, frames)])
    assert (fast == slow).all() and media.payload_of(fast) == data
    assert sorted(media.ZIGZAG.tolist()) == list(range(64)) and media.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_media_run_lengths():
    """Standard-style tables with runs and end-of-block codes go symbol by symbol."""
    table = media.canonical([0, 2, 2] + [0] * 13, [0x00, 0x01, 0x21, 0xF0])
    header = media.Header(8, 8, tuple([1] * 64), tuple(media.canonical([0, 2] + [0] * 14, [0, 2]).items()), tuple(table.items()))
    # DC size 2 (01), value 3 (11); AC: run 2 then 1 (100 1); end of block (00)
    data = int("01" + "11" + "100" + "1" + "00" + "111111", 2).to_bytes(2, "big")
    got = media.decode_scalar(header, data)[0]
    assert got[0] == 3 and got[3] == 1 and np.count_nonzero(got) == 2


def test_clips_of_ordinary_jpeg(spark):
    """Frames of the standard luminance tables, with zero coefficients, in a file that store() did not write."""
    ac = (
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
        "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    )
    assert len(ac) == 2 * 162
    dht = lambda kind, counts, values: b"\xff\xc4" + (19 + len(values)).to_bytes(2, "big") + bytes([kind]) + bytes(counts) + bytes(values)
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8] * 64) + b"\xff\xc0\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"
    head += dht(0, [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], range(12)) + dht(0x10, [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D], bytes.fromhex(ac))
    head += b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"
    # a DC of +100 or -100 (size 7: 11110), then the end of the block (1010)
    frame = lambda dc: head + int("11110" + f"{dc if dc > 0 else dc + 127:07b}" + "1010", 2).to_bytes(2, "big") + b"\xff\xd9"
    avi = media.write_avi([frame(100)] * 10 + [frame(-100)] * 10, side=8)
    with pytest.raises(ValueError, match="no stored bytes"):
        media.load(avi)
    got = media.clips(spark.createDataFrame([(1, bytearray(avi))], "doc_id long, media binary")).collect()
    assert [(r["first_frame"], r["end_frame"]) for r in got] == [(0, 10), (10, 20)]


def test_media_cuts_and_avi():
    h = np.array([[1.0, 0]] * 5 + [[0, 1.0]] * 5)
    assert media.cuts(h) == [5] and media.cuts(h[:1]) == []
    fps, frames = media.read_avi(media.write_avi([b"ab", b"cde"], fps=10))
    assert (fps, frames) == (10.0, [b"ab", b"cde"])
    no_index = media.write_avi([b"ab", b"cde"]).replace(b"idx1", b"JUNK")
    assert media.read_avi(no_index)[1] == [b"ab", b"cde"]
    with pytest.raises(ValueError):
        media.read_avi(b"nothing of that kind")


def test_chat(spark):
    hard = ["", None, queries.HARD_TEXT, '<turn role="assistant">\n', "</turn>\n", "\\", "\\\\<", "<image 0>", 'a"b', "line\n", "é🙂", "x" * 10000]
    rows = [(c, k, role, t) for c in range(3) for k, (role, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", None, 'odd"<\\role'))]
    rows += [(7, None, "assistant", "no turn"), (7, 0, "assistant", "tie b"), (7, 0, "assistant", "tie a"), (7, 0, "assistant", "tie a"), (None, 1, "user", "no id"), (8, 0, "user", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segment int").repartition(5)
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.conversation_digests(out).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((k is not None, k or 0, role or "", t or "") for c, k, role, t in rows if c == conv), key=lambda r: r)
        loss = "".join(t for *_, role, t in mine if role == "assistant")
        whole = "".join(chat.format_turn(role, [chat.TextPart(t)])[0] for *_, role, t in mine)
        r = got[conv]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == sha256("".join(f"{role}\n{t}\n" for *_, role, t in mine).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(whole)
    assert chat.conversation_digests(chat.format_conversations(df.where("false"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <image 0>", None, None), ("image", None, "s3://a", [28.0, 15.0]), ("audio", None, "b", [1.5]), ("document", None, "c", [2.0]), ("text", "end", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    r = chat.format_conversations(df, parts_col="parts").first()
    assert r["segment"] == '<turn role="assistant">\nsee \\<image 0><image 0><audio 1><document 2>end</turn>\n'
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://a", 4), ("audio", "b", 38), ("document", "c", 512)]
    d = chat.conversation_digests(chat.format_conversations(df, parts_col="parts")).first()
    assert d["loss_chars"] == len("see <image 0>end") and d["attachment_tokens"] == 554


def brute_lines(rows, window=3):
    first = {}
    order = sorted({(-1 if i is None else i, k, "\n".join(ls[k : k + window])) for i, t in rows for ls in [(t or "").split("\n")] for k in range(len(ls) - window + 1) if "\n".join(ls[k : k + window]).strip("\x20\t\n\x0b\x0c\r")})
    for i, k, w in order:
        first.setdefault(w, (i, k))
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        gone = set()
        for k in range(len(ls) - window + 1):
            w = "\n".join(ls[k : k + window])
            if w in first and first[w] < (-1 if i is None else i, k):
                gone |= set(range(k, k + window))
        out.append((i, "\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choices("abcd", k=rng.randint(0, 9)))) for i in range(120)]
    rows += [(None, "a\nb\nc\nd"), (500, None), (501, ""), (502, "\n" * 6), (503, "x\n" * 500), (504, "same\nthree\nlines"), (505, "same\nthree\nlines"), (505, "same\nthree\nlines"), (505, "same\nthree\nlines\nmore"), (506, "two\nlines"), (507, "two\nlines")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, w string, place int").repartition(4)
    got = sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(df).collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert line_dedup.line_dedup(df).columns == [*df.columns, "n_lines", "n_removed"]
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum((r["predicted"] == 1) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) >= 0.93
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0), 1) for i in range(60)] + [(None, 1, 1), (101, None, 1), (99999, 0, 1)], "doc_id long, quality int, score int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.quality_scores(empty(docs), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_quality_never_learns_held_out_labels(spark, docs):
    labels = spark.createDataFrame([(100 + i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.quality_scores(docs, x).collect()), key=str) for x in (labels, flipped))
    assert a == b


def test_shapes():
    assert [quality.shape(w) for w in ("Word***", "WORD!!", "word.", "x12y", "A")] == ["Aa*", "AA!", "a.", "a0a", "A"]


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    lengths = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x in texts]
    h = token_counts.length_histogram(docs, BYTE)
    report = {r["length"]: r for r in token_counts.context_report(h).collect()}
    assert set(report) == set(lengths)
    for n, r in report.items():
        assert r["truncated_total"] == sum(min(n, x) for x in lengths)
        assert (r["n_docs"], r["docs_up_to"], r["docs_longer"]) == (lengths.count(n), sum(x <= n for x in lengths), sum(x > n for x in lengths))
        assert (r["tokens_up_to"], r["total_tokens"], r["total_docs"]) == (sum(x for x in lengths if x <= n), sum(lengths), len(lengths))
    for r in token_counts.at_limits(h, [0, 3, 100, 10**6]).collect():
        assert r["truncated_total"] == sum(min(r["context_limit"], x) for x in lengths)
        assert r["docs_cut"] == sum(x > r["context_limit"] for x in lengths)
    got = {r["share"]: r["length"] for r in token_counts.length_quantiles(token_counts.context_report(h), [0.5, 1.0]).collect()}
    assert got == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert token_counts.context_report(token_counts.length_histogram(empty(docs), BYTE)).count() == 0


def brute_licenses(text):
    """Each window of three times a template's length, starting every length of it, by counting shingles."""
    words = licenses.words_of(text or "")
    shingles = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, template in licenses.TEMPLATES.items():
        t = licenses.words_of(template)
        if len(t) < 5:
            if any(words[i : i + len(t)] == t for i in range(len(words))):
                out[name] = 1.0
            continue
        own, n = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}, len(t) - 4
        best = max((len(own & set(shingles[s : s + 3 * n])) / len(own) for s in range(0, len(shingles), n)), default=0)
        if best >= licenses.CONTAINMENT:
            out[name] = best
    return out


def test_retrieval_misses_nothing():
    """Edited templates that stand among other words, over the bands' values alone."""
    rng, asked, missed = random.Random(11), 0, 0
    for name, text in licenses.TEMPLATES.items():
        words = licenses.words_of(text)
        own, n = set(licenses.template_shingles(text)), len(words) - 4
        if n < 1:
            continue
        masks, hashes = licenses.band_masks(), [licenses.shingle_hash(x) for x in own]
        for _ in range(250):
            edited = list(words)
            for _ in range(rng.randrange(0, max(2, n // 15))):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            window = [f"w{rng.randrange(10**6)}" for _ in range(n)] + edited + [f"w{rng.randrange(10**6)}" for _ in range(n)]
            shingles = {tuple(window[i : i + 5]) for i in range(len(window) - 4)}
            if len(own & shingles) >= licenses.CONTAINMENT * len(own):
                asked += 1
                seen = [licenses.shingle_hash(x) for x in shingles]
                missed += not any(min(h ^ m for h in seen) == min(h ^ m for h in hashes) for m in masks)
    assert asked > 2000 and missed == 0


def test_license_scan(spark, docs, texts):
    rng = random.Random(6)
    filler = lambda n: " ".join("".join(rng.choices("abcde", k=4)) for _ in range(n))
    rows = list(texts)
    for k, (name, t) in enumerate(licenses.TEMPLATES.items()):
        words = t.split()
        rows += [(1000 + 10 * k, t), (1001 + 10 * k, filler(37) + "\n" + t.upper() + ".\n" + filler(300)), (1002 + 10 * k, " ".join(words[: len(words) // 2])), (1003 + 10 * k, filler(999) + " " + t + " " + t)]
        if len(words) > 30:
            words[len(words) // 2] = "changed"
            rows.append((1004 + 10 * k, filler(5) + " " + " ".join(words)))
    rows += [(5000, "license " * 4000), (5001, "software license copyright " * 30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, w int, sh int").repartition(4)
    got = sorted(((r["doc_id"], {m["license"]: round(m["containment"], 9) for m in r["matches"]}) for r in licenses.license_scan(df).collect()), key=str)
    want = sorted(((i, {k: round(v, 9) for k, v in brute_licenses(t).items()}) for i, t in rows), key=str)
    assert got == want
    assert sum(bool(m) for _, m in got) >= 3 * len(licenses.TEMPLATES)
    assert licenses.license_scan(empty(docs)).count() == 0


def test_interrupted_licenses(spark):
    """A licence with words put into its middle is found wherever it starts: what any stretch of twice its length holds counts."""
    rows, want = [], {}
    for name in ("ISC", "MPL-2.0", "Unlicense", "BSD-clauses"):
        words = licenses.words_of(licenses.TEMPLATES[name])
        own, span = set(licenses.template_shingles(licenses.TEMPLATES[name])), len(words) - 4
        for extra in (10, 20, span - 8):
            text = words[: len(words) // 2] + [f"put{k}" for k in range(extra)] + words[len(words) // 2 :]
            share = len(own & set(zip(*(text[k:] for k in range(5)), strict=False))) / len(own)
            for offset in range(0, 2 * span, 3):
                want[len(rows)] = (name, share)
                rows.append((len(rows), " ".join([f"before{k}" for k in range(offset)] + text + ["after"] * 50)))
    assert sum(share >= licenses.CONTAINMENT for _, share in want.values()) > 100
    found = {r["doc_id"]: {m["license"]: m["containment"] for m in r["matches"]} for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, share) in want.items():
        assert found[i].get(name) == (pytest.approx(share) if share >= licenses.CONTAINMENT else None), (name, rows[i])


def test_line_dedup_without_ids(spark):
    df = spark.createDataFrame([(None, "a\nb\nc\nfirst"), (None, "a\nb\nc\nsecond"), (None, "a\nb\nc\nthird")], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in line_dedup.line_dedup(df).collect()) == [0, 3, 3]


def test_short_and_unanchored_templates(spark):
    own = {"reserved": "All rights reserved.", "fox": "the quick brown fox jumps over the lazy dog", "mit": licenses.TEMPLATES["MIT-notice"]}
    rows = [(1, "ALL rights, reserved"), (2, "x " * 50 + own["fox"] + " y" * 50), (3, "overall rights reserved"), (4, own["mit"] + ". All rights reserved."), (5, None)]
    found = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=own).collect()
    assert {r["doc_id"]: [m["license"] for m in r["matches"]] for r in found} == {1: ["reserved"], 2: ["fox"], 3: [], 4: ["mit", "reserved"], 5: []}


def test_license_hashes_agree(spark):
    words = ("released", "under", "the", "mit", "license")
    assert spark.range(1).select(F.xxhash64(*map(F.lit, words)).alias("a")).first()["a"] == licenses.shingle_hash(words)
    with pytest.raises(ValueError):
        licenses._prepared((("x", "the quick brown fox jumps over the lazy dog"),))


def test_md5_collisions_are_told_apart(spark, monkeypatch):
    """With a hash on which all texts collide, the bytes still separate them."""
    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit(md5(b"").hexdigest()))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a ")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect()) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_exact_dedup_at_both_ends_of_64_bits(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [(high, "ab cd "), (low, "ab cd"), (low, "x"), (high, "x"), (9 * 10**18, "ab cd"), (None, "x  ")]
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(high, high, 3, True), (low, high, 3, False), (9 * 10**18, high, 3, False), (low, low, 3, True), (high, low, 3, False), (None, low, 3, False)], key=str)


def test_packing_spreads_repeated_rows(spark):
    """Pieces that agree in all columns go in turn over the groups, and long ids without a number stay exact."""
    big = 2**60 + 1
    rows = [(None, "a b c")] * 3000 + [(7, "a b c")] * 1000 + [(big, "one two")] + [(k, f"word {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = packing.packed_pieces(docs, WORD, capacity=64, group_pieces=640).collect()
    assert len(out) == len(rows) and sum(r["doc_id"] == big for r in out) == 1
    groups = defaultdict(int)
    for r in out:
        groups[r["sequence_id"] >> 32] += 1
    assert len(groups) == 8 and max(groups.values()) < 1.2 * min(groups.values())
    placed = defaultdict(list)
    for r in out:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for bin_ in placed.values():
        assert sorted(o for o, _ in bin_) == [sum(n for _, n in sorted(bin_)[:k]) for k in range(len(bin_))]


def test_packing_names_and_empty_groups(spark):
    pieces = spark.createDataFrame([("x", 3, 1), ("y", 5, 1)], "`a.b` string, size int, c0 int")
    assert sorted(tuple(r) for r in packing.pack_sequences(pieces, "size", 8).collect()) == [("x", 3, 1, 0, 5), ("y", 5, 1, 0, 0)]
    with pytest.raises(Exception, match="does not fit"):
        packing.pack_sequences(pieces, "size", 4).collect()


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a\nb\nc\nd", 9, 9, 9, {"m": 1}, 9), (2, "a\nb\nc\ne", 9, 9, 9, {"m": 2}, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, `__id` int, starts int, m map<string,int>, `x.y` int")
    got = sorted((tuple(r) for r in line_dedup.line_dedup(df).collect()), key=str)
    assert line_dedup.line_dedup(df).columns == ["doc_id", "text", "__id", "starts", "m", "x.y", "n_lines", "n_removed"]
    assert got == [(1, "a\nb\nc\nd", 9, 9, {"m": 1}, 9, 4, 0), (2, "e", 9, 9, {"m": 2}, 9, 4, 3)]


def test_quality_fits_long_texts(spark):
    """Labelled texts of any length are fitted."""
    rows = [(k, ("GOOD prose here. " if k % 2 else "bad!!! ***junk*** ") * 15000) for k in range(24)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in quality.quality_scores(docs, labels).collect())


def test_quality_against_plain_loops(spark):
    """Word vectors, text vectors and the network's scores of ten texts, by loops over words."""
    rng = random.Random(12)
    words = ["River", "river", "boat.", "BOAT!!", "x12", "stone***", "the", "The", "é", "a-b"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 30))) + (" junk junk junk" if k % 2 else "")) for k in range(1, 31)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    model = quality.train(docs, labels)
    index = [quality.index_vectors(quality.WORD_BUCKETS, quality.SEED), quality.index_vectors(quality.SHAPE_BUCKETS, quality.SEED + 1)]
    around = [defaultdict(lambda: np.zeros(quality.DIM)) for _ in index]
    split = lambda w: divmod(quality.term_buckets(w), quality.SHAPE_BUCKETS)
    for k, text in rows:
        if zlib.crc32(str(k).encode()) % 5 == 0:
            continue
        tokens = text.split()
        for i, w in enumerate(tokens):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(tokens):
                    for t in (0, 1):
                        around[t][split(w)[t]] += index[t][split(tokens[j])[t]]

    def vector(t, bucket):
        v = around[t][bucket]
        return index[t][bucket] / np.sqrt(quality.NONZERO) + (v / np.linalg.norm(v) if v.any() else 0)

    a, b, c, d = model.layers
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, None, model=model).collect()}
    for k, text in rows[:10]:
        tokens = text.split()
        again = sum(x == y for x, y in zip(tokens, tokens[1:], strict=False))
        mine = np.concatenate([sum(vector(0, split(w)[0]) for w in tokens), sum(vector(1, split(w)[1]) for w in tokens) + again * vector(1, quality.AGAIN)]) / len(tokens)
        assert np.allclose(mine, model.vector(text), atol=1e-5)
        z = [(x - m) / s for x, m, s in zip(mine, model.mean, model.std, strict=True)]
        hidden = [np.tanh(sum(z[i] * a[i][h] for i in range(len(z))) + b[h]) for h in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, c, strict=True)) + d
        assert scores[k] == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=1e-4)


def test_shapes_of_long_words():
    assert quality.shape("a.b-c_d+" * 4 + "x") != quality.shape("a.b-c_d+" * 4 + "X")


# --- frames by an encoder of the tests' own, with the standard tables ---

AC_0 = (
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a"
    "838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
AC_0_COUNTS, DC_0_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D], [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
SCAN = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))


def codes(counts, symbols):
    out, code, symbols = {}, 0, iter(symbols)
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[next(symbols)] = f"{code:0{n}b}"
            code += 1
        code *= 2
    return out


def amplitude(v):
    size = abs(v).bit_length()
    return size, f"{v if v > 0 else v + 2**size - 1:0{size}b}" if size else ""


def block_bits(block, last, dc, ac):
    grid = [[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)]
    flat = np.rint(np.array(grid) @ (block - 128.0) @ np.array(grid).T).astype(int)
    values = [int(flat[r, c]) for r, c in SCAN]
    size, bits = amplitude(values[0] - last)
    out, run = dc[size] + bits, 0
    for v in values[1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size, bits = amplitude(v)
        out, run = out + ac[run << 4 | size] + bits, 0
    return out + (ac[0] if run else ""), values[0]


def foreign_frame(picture, sampling=None, interval=0, tables=True):
    """A frame of the picture's brightness; with sampling, of three components of which the others are grey."""
    h, w = picture.shape
    dc, ac = codes(DC_0_COUNTS, range(12)), codes(AC_0_COUNTS, bytes.fromhex(AC_0))
    sh, sv = sampling or (1, 1)
    across, down = -(-w // (8 * sh)), -(-h // (8 * sv))
    full = np.pad(picture, ((0, 8 * sv * down - h), (0, 8 * sh * across - w)), mode="edge")
    marker = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + bytes(body)
    head = b"\xff\xd8" + marker(0xDB, [0] + [1] * 64)
    parts = [1, sh << 4 | sv, 0] + ([2, 0x11, 0, 3, 0x11, 0] if sampling else [])
    head += marker(0xC0, [8, h >> 8, h & 255, w >> 8, w & 255, len(parts) // 3, *parts])
    if tables:
        head += marker(0xC4, [0, *DC_0_COUNTS, *range(12)]) + marker(0xC4, [0x10, *AC_0_COUNTS, *bytes.fromhex(AC_0)])
    if interval:
        head += marker(0xDD, [interval >> 8, interval & 255])
    grey = (0x00 if tables else 0x11, "00" + "1010" if tables else "00" + "00")  # no difference, end of block
    head += marker(0xDA, [3, 1, 0, 2, grey[0], 3, grey[0], 0, 63, 0] if sampling else [1, 1, 0, 0, 63, 0])
    out, bits, last = b"", "", 0
    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            bits += "1" * (-len(bits) % 8)
            out += int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])
            bits, last = "", 0
        y, x = divmod(unit, across)
        for k in range(sv):
            for m in range(sh):
                r, c = 8 * (y * sv + k), 8 * (x * sh + m)
                more, last = block_bits(full[r : r + 8, c : c + 8], last, dc, ac)
                bits += more
        bits += 2 * grey[1] if sampling else ""
    bits += "1" * (-len(bits) % 8)
    return head + out + int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0") + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [None, (1, 1), (2, 1), (2, 2), (1, 2)])
@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("tables", [True, False])
def test_media_reads_foreign_frames(sampling, interval, tables):
    rng = np.random.default_rng(5)
    for h, w in ((16, 24), (37, 50)):
        picture = np.clip(np.add.outer(np.arange(h) * 3, np.arange(w) * 2) % 256 + rng.integers(-30, 30, (h, w)), 0, 255)
        ((header, coefficients),) = media.read_frames([foreign_frame(picture, sampling, interval, tables)])
        got = media.pictures(header, coefficients)
        assert got.shape == (1, h, w) and np.abs(got[0].astype(int) - picture).max() <= 3


def test_media_clips_of_foreign_files(spark):
    dark, light = np.full((20, 30), 40), np.full((20, 30), 200)
    frames = [foreign_frame(dark + k % 3, (2, 2), tables=False) for k in range(9)] + [foreign_frame(light - k % 3, (2, 2), tables=False) for k in range(11)]
    plain = media.write_avi(frames, fps=10, side=24)
    movi = plain.index(b"movi")
    inside = plain[movi + 4 : plain.index(b"idx1")]
    lists = b"".join(media._chunk(b"LIST", b"rec " + media._chunk(b"00dc", f)) for f in frames)
    listed = plain[: movi - 4] + (4 + len(lists)).to_bytes(4, "little") + b"movi" + lists
    listed = listed[:4] + (len(listed) - 8).to_bytes(4, "little") + listed[8:]
    assert inside and media.read_avi(listed)[1] == frames
    none = media.write_avi([])
    rows = [(1, bytearray(plain)), (2, bytearray(listed)), (3, bytearray(none)), (None, bytearray(plain)), (1, bytearray(plain))]
    got = sorted((tuple(r) for r in media.clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()), key=str)
    cut = lambda i: [(i, 0, 0, 9, 0.0, 0.9), (i, 1, 9, 20, 0.9, 2.0)]
    assert got == sorted(cut(1) + cut(1) + cut(2) + cut(None), key=str)
    assert media.clips(spark.createDataFrame(rows[2:3], "doc_id long, media binary")).count() == 0
    for bad in (frames[0][:-30], b"\xff\xd8\xff\xc2" + frames[0][4:], b"junk"):
        with pytest.raises(ValueError):
            list(media.read_frames([bad]))


def test_cuts_against_plain_loops():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 20, 90):
        h = rng.dirichlet(np.ones(4), n)
        for start in range(0, n, 7):
            h[start : start + 7] = h[start] * 0.9 + h[start : start + 7] * 0.1
        d = [float(np.abs(h[i + 1] - h[i]).sum()) / 2 for i in range(n - 1)]
        want = []
        for i, x in enumerate(d):
            around = [d[j] for j in range(max(0, i - media.AROUND), min(len(d), i + media.AROUND + 1)) if j != i] or [0.0]
            mean = sum(d[j] for j in range(max(0, i - media.AROUND), min(len(d), i + media.AROUND + 1)) if j != i) / max(1, len(around))
            spread = (sum((y - mean) ** 2 for y in around) / len(around)) ** 0.5 if len(d) > 1 else 0.0
            if x >= media.LEAST and x > mean + media.DEVIATIONS * spread + 1e-9:
                want.append(i + 1)
        assert media.cuts(h) == want


def test_media_digest_columns(docs, texts):
    """Every digest, from the file that the text was stored as, and the features from its samples."""
    rows = sorted((tuple(r) for r in media.media_digests(media.media_column(docs)).collect()), key=str)
    want = []
    for i, t in texts:
        data = (t or "").encode()
        payload, file = media.padded(data), media.store(data)
        value = np.array([b - 128 if b < 128 else b - 127 for b in payload], float).reshape(-1, 64)
        block = np.zeros((len(value), 8, 8))
        for k, (r, c) in enumerate(SCAN):
            block[:, r, c] = value[:, k]
        grid = np.array([[(np.sqrt(0.125) if k == 0 else 0.5) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
        samples = np.clip(np.rint(grid.T @ block @ grid) + 128, 0, 255)
        want.append((i, len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), sha256(file).hexdigest(), samples.mean(), len(payload) // 576))
    for got, mine in zip(rows, sorted(want, key=str), strict=True):
        assert got[:7] == mine[:7]
        frames, brightness, clips = got[7].split(";")
        assert frames == f"frames={mine[8]}" and float(brightness.split("=")[1]) == pytest.approx(mine[7], abs=0.01)
        edges = [tuple(map(int, x.split("-"))) for x in clips.removeprefix("clips=").split(",")]
        assert edges[0][0] == 0 and edges[-1][1] == mine[8] and all(a[1] == b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_chat_parts_at_the_edges(spark):
    parts = [("image", None, None, None), (None, "no kind", None, None), ("audio", None, "a", [None]), ("document", None, "d", [])]
    rows = [(1, 0, "assistant", "ignored", parts), (1, 1, "user", "the text", None), (1, 2, "user", "not this", []), (2, 0, "user", "x", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, p {chat.PARTS}")
    out = chat.format_conversations(df, parts_col="p")
    segments = [r["segment"] for r in out.where("conv_id = 1").collect()]
    assert segments == ['<turn role="assistant">\n<image 0>no kind<audio 1><document 2></turn>\n', '<turn role="user">\nthe text</turn>\n', '<turn role="user">\n</turn>\n']
    digest = {r["conv_id"]: r for r in chat.conversation_digests(out).collect()}
    assert digest[1]["n_attachments"] == 3 and digest[1]["attachment_tokens"] == 0 and digest[1]["loss_chars"] == len("no kind")
    with pytest.raises(ValueError, match="unknown part kind"):
        chat.typed([{"kind": "video", "text": None, "ref": None, "size": None}], None)
    unrelated = df.withColumnRenamed("p", "parts").withColumn("parts", F.lit("a column of that name"))
    assert chat.conversation_digests(chat.format_conversations(unrelated)).count() == 2


def test_digests_refuse_rows_dealt_anew(spark):
    rows = [(c, k, "user", f"turn {k}") for c in range(5) for k in range(8)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat.conversation_digests(out).count() == 5
    for moved in (out.repartition(3), out.sortWithinPartitions(F.col("start").desc())):
        with pytest.raises(Exception, match="dealt anew"):
            chat.conversation_digests(moved).collect()


def test_very_long_text(spark):
    """A text above what a worker's slice takes, in every operator."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(500)]
    long = "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(150_000))
    assert len(long) > 8 << 20
    rows = [(1, long), (2, "short"), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect()) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]
    assert sorted((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()) == [(1, 1), (2, 2), (3, 1)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.line_dedup(df).collect()) == [(1, 0), (2, 0), (3, 150_000)]
    pieces = packing.packed_pieces(df, WORD).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("k")).collect()
    assert all(r["n"] > 1_000_000 and r["k"] == (r["n"] - 1) // 4096 for r in pieces if r["doc_id"] != 2)
    one = df.where("doc_id < 3")
    decoded = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(one, BYTE), BYTE).collect()}
    assert decoded == {1: long, 2: "short"}
    assert {r["doc_id"]: r["payload_sha256"] for r in media.media_digests(media.media_column(one)).collect()}[1] == sha256(media.padded(long.encode())).hexdigest()
    assert [r["matches"] for r in licenses.license_scan(df).collect()] == [[]] * 3
    turns = one.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r["conv_id"]: r["loss_chars"] for r in chat.conversation_digests(chat.format_conversations(turns)).collect()} == {1: len(long), 2: 5}
    scores = quality.quality_scores(one, spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")).collect()
    assert len(scores) == 2
