"""Personal data, hard negatives and phrases against brute force: nulls, empty and very long texts, ties, repeated
rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora.llm import hard_negatives, phrases, pii, queries

# --- personal data --------------------------------------------------------------------------------

# The contract's own expressions, for short texts.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and plain_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[-1] for x in sorted(out)]


HARD = [
    "", None, "a@b.c", "a@b@c.d", "x@y.z%w@v.u", "@a.b", "a@.b", "a@b.", "a.b@c-d.e-f.g_h@i.j", "é@b.c z@é.b", "a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.256.1.1 001.02.3.0255",
    "01.1.1.1", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "4111  1111 1111 1111", "4111111111111111", "4111111111111112", "x4111111111111111x", "0" * 12, "0" * 20, "4111 1111-1111 1111",
    "+1 (017) 555-7713", "+123456789", "+12345678", "+1 2 3 4 5 6 7 8 9 . ", "++123456789", "+1234567890123456", "+1((((((((((", "+12", "+1 2", "card 4111111111111111 ip 10.0.0.1 mail a@b.c +49 30 1234567",
    "🙂 a@b.c 🙂🙂 1.2.3.4", "1" * 5000, "9." * 3000, "a" * 4000 + "@" * 4000, "+1" * 2000, "1 " * 3000,
]


def test_base_spans_match_the_contract():
    rng = random.Random(11)
    made = ["".join(rng.choices("aZ09@@..-+% ()_é\n", k=rng.randint(1, 60))) for _ in range(3000)] + ["".join(rng.choices("0123456789  -..+", k=rng.randint(1, 60))) for _ in range(3000)]
    for text in [*HARD, *made]:
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text or "") if s.kind in pii.BASE]
        assert got == brute_base(text or ""), text


def kinds(text):
    return [s.kind for s in pii.find_spans(text)]


def test_added_kinds_need_validators_and_context():
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("FR1420041010050500013M02606") == ["iban"]
    assert "iban" not in kinds("IBAN DE88 3704 0044 0532 0130 00") and "iban" not in kinds("XX89370400440532013000")
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("123-45-6789") == [] and kinds("SSN 666-45-6789") == []
    assert kinds("DNI 12345678Z") == ["dni"] and kinds("12345678Z") == [] and kinds("DNI 12345678A") == [] and kinds("NIE X1234567L") == ["dni"]
    number = "1850578006084"
    nir = number + f"{97 - int(number) % 97:02d}"
    assert kinds(nir) == ["nir"] and kinds(number + "00") == []
    assert kinds("call (212) 555-0100") == ["national_phone"] and kinds("(212) 555-0100") == []
    # part of a phone number with a country code is not one of its own
    assert kinds("phone +1 (212) 555-0100") == ["phone"]
    plain, good, bad = (next(s.score for s in pii.find_spans(t)) for t in ("see 10.1.2.3", "server 10.1.2.3", "version 10.1.2.3"))
    assert bad < plain < good and kinds("version 10.1.2.3") == ["ip"]


def test_long_texts_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", "A1", "+", "1-"):
        pii.find_spans(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 60


def test_personal_data(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a@b.c"), (3, "1.2.3.4"), (3, "1.2.3.4"), (7, "mail a@b.c IBAN DE89370400440532013000" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "id": F.lit("x"), "kind": F.lit(2)}).repartition(3)
    got = sorted(map(tuple, pii.span_digests(pii.personal_data(docs)).collect()), key=str)
    want = []
    for i, t in rows:
        base = brute_base(t or "")
        everything = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(t or ""))
        want.append((i, *(sum(x.startswith(k) for x in base) for k in PLAIN), sha256(",".join(base).encode()).hexdigest(), everything))
    assert got == sorted(want, key=str)
    assert pii.personal_data(docs.where("false")).count() == 0
    hidden = {r["text"] for r in pii.masked(docs.where("text = 'card 4111111111111111 ip 10.0.0.1 mail a@b.c +49 30 1234567'")).collect()}
    assert hidden == {"card <card> ip <ip> mail <email> <phone>"}


def test_op11(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    frame = queries.op11_pii(spark, sf)
    assert frame.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {r["doc_id"]: r for r in frame.collect()}
    assert set(rows) == set(texts) and sum(r["n_email"] + r["n_card"] for r in rows.values()) > 0
    for i, text in texts.items():
        base = brute_base(text)
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k) for x in base) for k in PLAIN]
        assert rows[i]["base_sha256"] == sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(rows[i]["spans"].split(","))


# --- hard negatives -------------------------------------------------------------------------------


def brute_negatives(rows, every=100):
    known = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, q in known:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, w, strict=False)), j, other) for j, other, w in known))
        for s, j, _ in [x for x in scored if x[2] == lab and x[1] != i][:5]:
            within = [x for x in scored if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(within, 1)]
    return out


def made_vectors(rng, n, width=70):
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=width)) / 8], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [1.0] * width, None), (n + 3, [float("nan")] * width, 1), (n + 4, [float("inf")] + [0.0] * (width - 1), 1), (n + 5, [None] * width, 1), (None, rows[0][1], 1)]
    rows += [(n + 10 + i, rows[0][1], i % 3) for i in range(20)]  # ties
    rows += [rows[100], rows[100], rows[5], (n + 40, [], 1), (n + 41, [0.25], 2), (200, rows[7][1], 2)]  # repeated rows and ids, other widths
    return rows


@pytest.mark.parametrize("dimensions, block", [(32, (256, 4096)), (7, (2, 50))])
def test_hard_negatives(spark, dimensions, block):
    rows = made_vectors(np.random.default_rng(3), 400)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "q": F.lit(2), "block": F.lit(3), "tile": F.lit(4)}).repartition(5)
    q = hard_negatives.quantised(frame).cache()
    got = hard_negatives.hard_negatives(q, q.where("id % 100 = 0"), dimensions=dimensions, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(brute_negatives(rows))
    q.unpersist()


def test_hard_negatives_of_little(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mined(none).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (7, [1.0], 2)], "vec_id long, embedding array<double>, label long")
    assert hard_negatives.mined(alone).count() == 0  # no positive
    large = spark.createDataFrame([(0, [1e20], 1), (7, [1.0], 1)], "vec_id long, embedding array<double>, label long")
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.mined(large).count()


def test_packed_integers():
    for values in ([0], [-1, 1], [2**15, -5], [2**40, -(2**40)], []):
        a = np.array(values, np.int64)
        assert hard_negatives._unpacked(hard_negatives._packed(a), len(a)).tolist() == values
    a, b = np.array([[2**27, 2**27]]), np.array([[2**27, -(2**26)]])
    assert hard_negatives._product(a, b).tolist() == [[2**54 - 2**53]]


# --- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n, kept = total[lang], {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                continue
            score, _, left, right = min((math.floor(Fraction(1000 * a * n, f[p[:k]] * f[p[k:]])), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


def made_texts(rng):
    words = ["a", "b", "A", "the", "of", "é", "c|d", "e_f", "日本", " x", "x y", "\x1c"]
    return [(rng.choice(["en", "en", "de", None, "", "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]


@pytest.mark.parametrize("positions, bundle, parts", [(1 << 21, 1 << 22, 1), (64, 300, 5)])
def test_collocations(spark, positions, bundle, parts):
    rng = random.Random(13)
    rows = made_texts(rng) + [("en", None), ("en", ""), (None, None), ("en", "..."), ("xx", "")] + [("en", "one two three four five six seven. one two three")] * 12 + [("de", "the the the the the the the " * 40), ("en", "long " * 3000)]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({"shard": F.lit(1), "words": F.lit(2), "prefix": F.lit(3), "n": F.lit(4)}).repartition(parts)
    got = sorted(map(tuple, phrases.collocations(frame, least=6, top=40, positions=positions, bundle=bundle).collect()))
    assert got == sorted(brute_phrases(rows, 6, 5, 40)) and len(got) > 60
    assert phrases.collocations(frame.where("false")).count() == 0


def test_slices_do_not_change_results(spark, monkeypatch):
    rows = [("en", t) for _, t in made_texts(random.Random(4))]
    shard = phrases._Shard()
    for _, t in rows:
        shard.add(t.encode())
    names, counts, data = shard.row()
    word, block, mask = phrases._loaded(data)
    assert np.bincount(word, np.bitwise_count(mask)).astype(int).tolist() == counts.tolist() and len(names) == len(counts)
    tree, size = phrases._Tree([], np.arange(len(names))), int(block.max()) + 1

    def all_rows():
        return sorted(tuple(x) for part in phrases._extended(tree, (word, block, mask), size) for x in zip(*(c.tolist() for c in part), strict=True))

    whole = all_rows()
    monkeypatch.setattr(phrases, "SLICE", 3)
    assert all_rows() == whole and sum(r[-1] for r in whole) > 0


def test_pairs_of_many_words_are_told_apart():
    n = 70_000  # (0, 47296) and (61356, 0) are 2^32 apart as prefix * n + word
    at = np.array([0, 47296, -1, 61356, 0])
    place = np.flatnonzero(at >= 0)
    place = place[np.argsort(at[place], kind="stable")]
    entries = at[place].astype(np.int32), (place >> 3).astype(np.int32), np.uint8(1) << (place & 7).astype(np.uint8)

    def found(tree):
        return [tuple(x) for part in phrases._extended(tree, entries, 1) for x in zip(*(c.tolist() for c in part), strict=True)]

    pairs = [(0, 47296), (61356, 0)]
    assert sorted(found(phrases._Tree([], np.arange(n)))) == [(a, b, b, 1) for a, b in pairs]
    tree = phrases._Tree([[np.array(c) for c in ([7, 8], [0, 61356], [47296, 0], [47296, 0])]], np.arange(n))
    assert tree.find(0, *(np.array(c, np.int32) for c in zip(*pairs, strict=True))).tolist() == [0, 1]


def test_bundles_without_frequent_phrases(spark):
    rng = random.Random(5)
    rows = [("aa", " ".join(rng.sample([f"w{i}" for i in range(40)], 40))) for _ in range(8)]
    rows += [("bb", "one two three. one two four"), ("cc", "one two three four five six")] * 8
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, phrases.collocations(frame, least=6, positions=64, bundle=1).collect()))
    assert got == sorted(brute_phrases(rows, 6, 5, 2000)) and {r[0] for r in got} == {"bb", "cc"}


@pytest.mark.parametrize("load", [phrases.LOAD if hasattr(phrases, "LOAD") else 16, 0.001])
def test_rare_phrases_make_no_rows(spark, tmp_path, monkeypatch, load):
    """Rare triples of frequent words are sieved out before they are rows, in any number of parts, and no phrase is lost."""
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(40)), "xy"[i % 2]) for i in range(600)]
    triples = [lang + t[k : k + 5] for _, t, lang in rows for k in range(0, len(t) - 4, 2)]
    often = sum(n for n in Counter(triples).values() if n >= 6)
    walk = phrases._walk

    def counted(length, *args):
        run = walk(length, *args)

        def told(batches):
            n = 0
            for batch in run(batches):
                n += batch.num_rows
                yield batch
            (tmp_path / f"{length}-{random.SystemRandom().random()}").write_text(str(n))

        return told

    monkeypatch.setattr(phrases, "_walk", counted)
    monkeypatch.setattr(phrases, "LOAD", load, raising=False)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(tuple, phrases.collocations(frame, least=6, positions=500, bundle=1500).collect()))
    assert got == sorted(brute_phrases([(lang, t) for _, t, lang in rows], 6, 5, 2000)) and any(r[2].count(" ") == 2 for r in got)
    made = sum(int(f.read_text()) for f in tmp_path.glob("3-*"))
    assert 0 < made < 1.2 * often < len(triples) / 4


def test_op13_counts_pass_64_bits(spark):
    big = 10**16
    row = spark.createDataFrame([(big, 10**17, [10**16 + 1], [10**16 + 3])], "a long, n long, firsts array<long>, lasts array<long>")
    assert row.select(phrases._lowest_cut(2).alias("c")).select("c.score").first()[0] == 1000 * big * 10**17 // ((10**16 + 1) * (10**16 + 3))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_phrases"])
def test_columns(spark, sf, name):
    want = {"op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], "op13_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]}
    frame = queries.QUERIES[name](spark, sf)
    assert frame.columns == want[name]
    kinds = dict(frame.dtypes)
    assert kinds["rank"] == ("int" if name.startswith("op12") else "bigint") and all(t == "bigint" for c, t in kinds.items() if c not in ("rank", "lang", "phrase"))
