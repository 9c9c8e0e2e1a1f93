"""Corpus operators against brute force and on edge cases."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from landgrain.llm import decontaminate, html_extract, mixing, quality, rules, sharding, simhash, substring_dedup, tokens, toxicity
from landgrain.llm.html_blocks import Parser
from landgrain.llm.html_training import labelled_pages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def words(r, n):
    return [r.choice(["the", "of", "alpha", "beta", "gamma", "delta", "x1", "é", "and"]) + (str(r.randint(0, 9)) if r.random() < 0.7 else "") for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    passage = words(r, 70)
    out = [(None, "a null id " * 9, "en", "s"), (1, None, "en", None), (2, "", None, "s"), (3, " \n\t", "en", "s"), (4, "one two", "de", "s")]
    for i in range(5, 40):
        w = words(r, r.randint(1, 160))
        if i % 3 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[: r.randint(45, 70)]
        out.append((i, " ".join(w) if i % 4 else "\n".join(w), r.choice(["en", "de"]), r.choice(["s", "t", "u"])))
    out += [(100 + i, out[20][1], "en", "s") for i in range(5)]  # copies
    out += [out[20], out[21]]  # repeated rows
    out.append((200, " ".join(words(r, 30_000)), "en", "s"))
    return [(*x, len(x[1] or ""), "clash") for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_brute_force(docs, rows, empty):
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in split:
        for s in range(len(w) - 49) if i is not None else ():
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, i), i)
    want = {}
    for i, w in split:
        gone = bytearray(len(w))
        for s in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.setdefault(i, set()).add((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 100
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) in want[r["doc_id"]] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_simhash_brute_force(spark, rows):
    r = random.Random(5)
    base = words(r, 400)
    more = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edit"
        more.append((1000 + i, " ".join(w), "en", "s", 1, "c"))
    every = [*rows, *more]
    df = spark.createDataFrame(every, SCHEMA)
    fps = [simhash.fingerprint((x[1] or "").encode()) for x in every]
    parent = list(range(len(every)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(every):
        if x[0] is not None:
            least[find(i)] = min(least.get(find(i), x[0]), x[0])
    want = sorted((str(x[0]), fps[i], least.get(find(i))) for i, x in enumerate(every))
    got = sorted((str(g["doc_id"]), g["fp"] % (1 << 64), g["component_id"]) for g in simhash.near_duplicates(df).collect())
    assert got == want
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    ids = [k["doc_id"] for k in kept.collect() if k["doc_id"] is not None]
    assert sorted(ids) == sorted(set(least.values()))


def test_deduplicate_rows_that_share_an_id(spark):
    r = random.Random(9)
    a, b, c = (" ".join(words(r, 200)) for _ in range(3))
    rows = [(7, a, "x"), (7, b, "x"), (7, b, "x"), (5, c, "x"), (7, c, "x"), (None, a, "x")]
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    # 7 names two components and stays in both; its third text is a copy of 5's
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(7, a, "x"), (7, b, "x"), (5, c, "x"), (None, a, "x")]))


def test_fingerprint_of_words():
    import xxhash

    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c d", "b c d a")]
    assert simhash.fingerprint(b"A b C d\n a") == sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 2)
    assert simhash.fingerprint(b" \n") == 0


def test_decontamination(spark, docs, rows, empty):
    target = decontaminate.terms(rows[-1][1].encode())
    items = [(9, b" ".join(target[500:530]).decode()), (10, "one TWO"), (11, None), (12, "!!"), (None, "alpha1 beta2"), (9, "never seen words at all in any of these documents here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, t in items:
        w = decontaminate.terms((t or "").encode())
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    want = []
    for x in rows:
        w = decontaminate.terms((x[1] or "").encode())
        hit, own = set(), set()
        for k, who in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit.update(range(s, s + len(k)))
                    own |= who
        own = sorted(str(i) for i in own - {None})
        want.append((x[0], len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), bool(hit)))
    got = decontaminate.scan(docs, bench).drop("tag", "n_near_items").collect()
    assert len(got) == len(rows) and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_decontamination_in_blocks_keeps_rows(spark, docs, rows):
    from pyspark.sql import functions as F

    target = decontaminate.terms(rows[-1][1].encode())
    bench = spark.createDataFrame([(9, b" ".join(target[500:530]).decode()), (10, "one TWO"), (11, None), (12, rows[20][1])], "item_id long, text string")
    whole, blocks = ([(r["doc_id"], r["n_words"], str(r["spans"]), r["items"], r["near"]) for r in decontaminate.matches(docs, bench, block=b).collect()] for b in (1 << 20, 20))
    assert len(blocks) == len(rows) and sorted(map(str, blocks)) == sorted(map(str, whole))
    # texts without a doc_id that share their 32-bit hash, one with a passage of the benchmark
    n = spark.range(300_000)
    bad, good = (n.select(F.concat(F.lit(x), "id").alias("text")).withColumn("h", F.hash("text")) for x in ("one two ", "other "))
    pair = bad.join(good.withColumnRenamed("text", "clean"), "h").select("text", "clean").first()
    two = spark.createDataFrame([(None, pair["text"]), (None, pair["clean"])], "doc_id long, text string")
    assert sorted(r["n_words"] for r in decontaminate.matches(two, bench, block=20).collect()) == [2, 3]
    assert [r["text"] for r in decontaminate.clean(two, bench).collect()] == [pair["clean"]]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zz alpha yy beta gamma"), (2, "alpha " + "yy " * 40 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "beta alpha gamma")], "item_id long, text string")
    near = {r["doc_id"]: list(r["near"]) for r in decontaminate.matches(docs, bench).collect()}
    assert near == {1: [5], 2: []}


def test_proximity_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{min(int(r.expovariate(0.25)), 30)}" for _ in range(r.randint(0, 120))) for _ in range(60)]
    items = [(i, " ".join(f"w{min(int(r.expovariate(0.25)), 30)}" for _ in range(r.randint(0, 14)))) for i in range(25)]
    want = {}
    for d, t in enumerate(texts):
        w, near, exact = t.split(), set(), set()
        for i, x in items:
            x = x.split()
            for s in range(max(1, len(x) - 9) if x else 0):
                k = x[s : s + 10]
                if any(set(k) <= set(w[a : a + decontaminate.SPAN]) for a in range(len(w))):
                    near.add(i)
                if any(w[a : a + len(k)] == k for a in range(len(w))):
                    exact.add(i)
        want[d] = (sorted(exact), sorted(near - exact))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(v[1]) for v in want.values()) > 50
    for segment, block in ((decontaminate.SEGMENT, decontaminate.BLOCK_BYTES), (500, 100)):
        got = decontaminate.search(decontaminate.build_index(docs, segment), bench, block=block).collect()
        assert {g["doc_id"]: (g["items"], g["near"]) for g in got} == want


def test_proximity_of_every_window(spark):
    item = [f"w{i}" for i in range(14)]
    spread = " ".join(item[4:9]) + " and then " + " ".join(item[9:14])  # near by the window at offset 4 alone
    docs = spark.createDataFrame([(1, " ".join(reversed(item[4:14]))), (2, spread), (3, " ".join(item[5:14])), (4, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    near = {r["doc_id"]: list(r["near"]) for r in decontaminate.matches(docs, bench).collect()}
    assert near == {1: [5], 2: [5], 3: [], 4: []}
    got = {r["doc_id"]: (r["n_near_items"], r["near_items_sha256"], r["contaminated"]) for r in decontaminate.proximity(docs, bench).collect()}
    one, none = hashlib.sha256(b"5").hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == {1: (1, one, False), 2: (1, one, False), 3: (0, none, False), 4: (0, none, True)}


def test_tokens_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(tokens.read_tokens(tokens.write_tokens(docs, block=5000)).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows) and [g["doc_id"] is None for g in got] == sorted([g["doc_id"] is None for g in got], reverse=True)
    at, want = 0, {}
    for x in rows:
        ids = np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(x[0], set()).add((len(ids), zlib.crc32(ids.tobytes())))
    for g in got:
        assert g["start"] == at and (g["n_tokens"], g["ids_crc32"]) in want[g["doc_id"]]
        at += g["n_tokens"]
    assert tokens.read_tokens(tokens.write_tokens(empty)).count() == 0


def test_coding_of_large_ids():
    ids = [0, 1, 255, 256, 70_000, 2**31, 1, 1, 5]
    docs, lengths, back = tokens.unpack(tokens.pack([3, None, 9], np.array([8, 1, 0]), np.array(ids, "<u4")))
    assert docs == [3, None, 9] and lengths.tolist() == [8, 1, 0] and back.tolist() == ids


def test_encoder_equals_library(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e, r = Tokenizer.from_file(path), tokens.Encoder(path), random.Random(7)
    monkeypatch.setattr(tokens, "CACHE", 500)  # forgets often
    parts = ["a", " ", " ", "  ", "\n", "\t", "it's", "'s", " 'll", "x1", "é", "日本", "😀", "\x00", "\x1c", "\x85", "<|endoftext|>", "word.", "the,", "été?", "b***", "\u200b", "ǅ", "²", "ª", "Привет", "“q”", "(606)", "a\u0301"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(6000)]
    texts += ["".join(r.choice(parts[:3] + parts[6:9] + parts[10:13]) + " w" for _ in range(9000)), "x" * 20_000, "\n".join(["long " + "line," * 3] * 5000), "", None]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}1" for c in range(0x250)]
    for some in (texts[:3000], texts[3000:], [], [None], ["", ""]):
        flat, count = e.encode(pa.array(["skipped", *some], pa.string())[1:])
        ends = np.cumsum(count)
        for x, a, z in zip(some, (ends - count).tolist(), ends.tolist(), strict=True):
            assert flat[a:z].tolist() == t.encode(x or "", add_special_tokens=False).ids, repr(x)[:80]


def hilbert_curve(bits):
    """Cells of a three-dimensional cube by a walk: index of each by bitwise rotation, one cell at a time."""
    out = {}
    for cell in range(1 << 3 * bits):
        x = [cell >> bits * i & (1 << bits) - 1 for i in range(3)]
        key, q = tuple(x), 1 << bits - 1
        while q > 1:
            for i in range(3):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & q - 1
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in (1, 2):
            x[i] ^= x[i - 1]
        t = 0
        for b in range(bits - 1, 0, -1):
            if x[2] >> b & 1:
                t ^= (1 << b) - 1
        x = [v ^ t for v in x]
        out[key] = int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)
    return out


def test_hilbert_and_shards(spark, docs, rows, empty):
    import math

    from pyspark.sql import functions as F

    g = spark.range(512).select((F.col("id") % 8).alias("x"), (F.floor(F.col("id") / 8) % 8).alias("y"), F.floor(F.col("id") / 64).alias("z"))
    g = g.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r["h"] for r in g] == list(range(512)) and all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(g, g[1:], strict=False))
    curve = hilbert_curve(3)
    assert all(curve[r["x"], r["y"], r["z"]] == r["h"] for r in g)
    clash = docs.withColumns({"slot": F.lit("clash"), "row": F.lit(1), "tie": F.lit(2), "at": F.lit(3)})
    s = sharding.shard(clash).collect()
    assert len(s) == len(rows) and {(r["row"], r["tie"], r["at"]) for r in s} == {(1, 2, 3)}
    by = {}
    for r in s:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(empty).count() == 0 and {r["shard"] for r in sharding.shard(docs.limit(3)).collect()} == {0, 1, 2}
    # every row's cell, and the order of the curve
    curve, top = hilbert_curve(sharding.BITS), (1 << sharding.BITS) - 1
    name = lambda v: zlib.crc32((v or "\0").encode()) % (top + 1)
    for r in s:
        size = min(top, math.floor(math.log2(len((r["text"] or "").encode()) + 1) * top / 24))
        assert r["hilbert"] == curve[size, name(r["lang"]), name(r["source"])]
    placed = sorted(s, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in placed] == sorted(r["hilbert"] for r in s)


def test_shards_of_the_query(spark, rows, tmp_path):
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op5_hilbert_shards(spark, str(tmp_path)).collect()
    want = [(x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows]
    assert sorted(map(str, want)) == sorted(str((g["doc_id"], g["size"], g["text_crc32"])) for g in got)
    counts = [sorted(g["slot"] for g in got if g["shard"] == k) for k in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1 and sum(map(len, counts)) == len(rows)
    assert {(g["law"], g["grown_shard"]) for g in got} == {("rows", None)}


def test_files_are_pruned(spark, tmp_path):
    """Few of the written files can hold a language and a source that a reader asks for."""
    import glob

    import pyarrow.parquet as pq

    r = random.Random(3)
    rows = [(i, "x" * int(2 ** r.uniform(4, 12)), r.choice(["en", "de", "fr", "es"]), f"s{r.randrange(6)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"), files=6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3000 and back.select("shard").distinct().count() == 8
    files = glob.glob(str(tmp_path / "out" / "shard=*" / "*.parquet"))
    spans = []
    for f in files:
        g = pq.ParquetFile(f).metadata.row_group(0)
        stats = {g.column(c).path_in_schema: g.column(c).statistics for c in range(g.num_columns)}
        spans.append({c: (stats[c].min, stats[c].max) for c in ("lang", "source")})
    hit = [sum(a["lang"][0] <= lang <= a["lang"][1] and a["source"][0] <= source <= a["source"][1] for a in spans) for lang in ("en", "de", "fr", "es") for source in ("s0", "s3", "s5")]
    assert len(files) >= 40 and sum(hit) / len(hit) < 0.5 * len(files)


def test_rules_brute_force(docs, rows, empty):
    import re
    from collections import Counter

    want = []
    for x in rows:
        t = x[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want.append((x[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    got = [tuple(r)[:7] for r in rules.judge(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert rules.judge(empty).count() == 0


def test_label_model_recovers_classes():
    r = random.Random(2)
    counts, truth = {}, {}
    for _ in range(4000):
        good = r.random() < 0.8
        v = [int(good) if r.random() < 0.85 else 1 - int(good) for _ in quality.LABELLERS]
        c = quality._code(v)
        counts[c] = counts.get(c, 0) + 1
        truth[c] = truth.get(c, 0) + good
    m = quality.LabelModel(counts)
    assert abs(m.share - 0.8) < 0.03 and all(0.8 < a < 0.9 for a in m.accuracies())
    assert all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:], strict=False)) or m.history[-1] > m.history[0]


def plain_measures(text):
    """The labellers' measures of one text, each by its definition, and the words' shapes."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, every = len(w), "".join(w)
    letters, lines = sum(c.isalpha() for c in every), [x for x in text.split("\n") if x]
    m = [
        sum(c in quality._SYMBOLS for c in every) / n, sum(c.isupper() for c in every) / max(1, letters), min(1.0, len(set(w)) / n * max(1.0, n / 400) ** 0.25),
        sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, 1 - len(set(lines)) / max(1, len(lines)), sum(x[-1] in ".!?" for x in w) / n,
        sum(x.strip(quality._PUNCTUATION).lower() in quality.STOP for x in w) / n, len(every) / n, every.count("!") / n,
    ]
    shapes = [re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c if c < "\x7f" else "?" for c in x), flags=re.S) for x in w]
    return m, shapes, n


def plain_votes(m, n):
    return tuple(3 if n < quality.LEAST[name] else 0 if x < low or x > high else 1 if good <= x <= to else 2 for x, (name, low, good, to, high) in zip(m, quality.LABELLERS, strict=True))


def test_quality_brute_force(docs, rows):
    """Votes, EM and the scorer's judgements in plain Python."""
    import math

    texts = [x[1] or "" for x in rows]
    measured = [plain_measures(t) if t.split() else ([0.0] * 9, [], 0) for t in texts]
    every = [plain_votes(m, n) for m, _, n in measured]
    model = quality.train(docs)
    # EM: every document by itself
    post = [0.1 if v.count(0) > v.count(1) else 0.5 if 0 in v else 0.9 for v in every]
    for _ in range(60):
        share = (sum(post) + 9) / (len(post) + 10)
        tables = []
        for weight, prior in ((post, (0.5, 2.0, 1.0)), ([1 - p for p in post], (2.0, 0.5, 1.0))):
            t = [[sum(w for w, v in zip(weight, every, strict=True) if v[j] == k) + prior[k] for k in range(3)] for j in range(9)]
            tables.append([[x / sum(row) for x in row] for row in t])
        odds = [math.log(share / (1 - share)) + sum(math.log(tables[0][j][k] / tables[1][j][k]) for j, k in enumerate(v) if k < 3) for v in every]
        post = [1 / (1 + math.exp(-min(40, max(-40, o)))) for o in odds]
    got = sorted(quality.score(docs, model).collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    want = []
    for x, (m, shapes, n), p in zip(rows, measured, post, strict=True):
        at = [zlib.crc32(f"{name}={sum(s <= v for s in quality._STEPS)}".encode()) % quality.BUCKETS for v, (name, *_) in zip(m, quality.LABELLERS, strict=True)]
        w = model.weights
        odds = sum(w[zlib.crc32(s.encode()) % quality.BUCKETS] for s in shapes) / max(1, n) + sum(w[a] for a in at) + w[quality.BUCKETS]
        want.append((x[0], n, 1 / (1 + math.exp(-min(30, max(-30, odds)))) if n else 0.0, p if n else 0.0))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    for g, (i, n, score, p) in zip(got, want, strict=True):
        assert (g["doc_id"], g["n_words"]) == (i, n) and g["score"] == pytest.approx(score, abs=1e-5) and g["posterior"] == pytest.approx(p, abs=1e-6) and g["kept"] == (g["score"] >= 0.5)


def test_scorer_in_plain_python():
    r = random.Random(4)
    data = [(r.random(), sorted(r.sample(range(50), 5)), [r.random() for _ in range(5)]) for _ in range(40)]
    w, squares = {}, {}
    for _ in range(3):
        for target, at, value in data:
            at, value = [*at, quality.BUCKETS], [*value, 1.0]
            p = 1 / (1 + np.exp(-sum(w.get(k, 0.0) * v for k, v in zip(at, value, strict=True))))
            for k, v in zip(at, value, strict=True):
                g = (target - p) * v - 1e-5 * w.get(k, 0.0)
                squares[k] = squares.get(k, 1e-4) + g * g
                w[k] = w.get(k, 0.0) + 0.2 * g / np.sqrt(squares[k])
    got = quality.fit_scorer(data, 3)
    assert all(got[k] == pytest.approx(x) for k, x in w.items())


def test_quality_edges(docs, rows, empty):
    got = quality.score(docs).collect()
    assert len(got) == len(rows) and all(g["score"] == 0 and not g["kept"] for g in got if g["doc_id"] in (1, 2, 3))
    assert quality.keep_good(docs).columns == docs.columns and quality.score(empty).count() == 0 and quality.keep_good(empty).count() == 0
    from pyspark.sql import functions as F

    clash = docs.withColumns({"__text": F.lit("t"), "row": F.lit(4), "tag": F.lit(6), "__keep": F.lit(7)})
    model = quality.train(docs)
    kept = quality.keep_good(clash, model)
    assert kept.schema == clash.schema and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(g["doc_id"]) for g in quality.score(docs, model).where("kept").collect())
    once = simhash.deduplicate(clash)
    assert once.columns == clash.columns and {(r["__text"], r["row"], r["tag"], r["__keep"]) for r in once.collect()} == {("t", 4, 6, 7)}


def test_grammar():
    g = toxicity.Grammar({"moron": 1.0, "idio*": 1.0})

    def kinds(text):
        return {k for k, v in zip(toxicity.KINDS, g.features(text.encode()), strict=True) if v}

    assert kinds("a moron here") == {"insult"} and kinds("you are an idiot.") == {"insult aimed"} and kinds("that idiot, you") == {"insult"}
    assert kinds("idiot you") == {"insult aimed"} and kinds("you are not a moron") == {"insult negated"} and kinds("he said moron") == {"insult reported"}
    assert kinds("I will kill you") == {"threat aimed"} and kinds("nothing to see") == set() and "further matches" in kinds("moron. moron.") & kinds("moron moron")
    assert kinds("kill the process now") == kinds("find the end") == kinds("back up, watch it") == kinds("a piece of cake") == kinds("I hope so") == set()
    assert kinds("You deserve to die") == kinds("I will find you and end you") == kinds("watch your back") == {"threat aimed"}
    assert kinds("we will burn it") == {"threat"} and kinds("beat them") == {"violence aimed"} and kinds("he said you should die") == {"threat held back"}
    assert kinds("you piece of trash") == {"insult aimed"} and kinds("never waste of space") == {"insult negated"}


def test_grammar_equals_its_parts_in_sequence():
    """The composed machine against each transducer run over the whole sequence before the next."""
    nxt, out = toxicity.machine()
    r = random.Random(8)
    often = [toxicity.SLUR, toxicity.VIOLENT, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.INTENT, toxicity.PURSUIT]
    for _ in range(800):
        word = [r.choice(often) if r.random() < 0.6 else r.randrange(18) for _ in range(r.randint(0, 14))]
        word = [k for k in word if k not in (toxicity.INSULT, toxicity.THREAT)]
        symbols = [(k, 0) for k in word]
        for part in toxicity.PARTS:
            state, made = part.start, []
            for x in symbols:
                state, y = part.step(state, x)
                made.append(y)
            symbols = made
        state, got = 0, []
        for k in word:
            got.append(out[state][k])
            state = nxt[state][k]
        assert got == [k * 128 + f if k in (toxicity.INSULT, toxicity.THREAT) or f else 0 for k, f in symbols]


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.7) for g in got)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1) for g in got if g["doc_id"] is not None)
    clash = spark.createDataFrame([(i, 1, t) for i in range(5, 40) for t in (0, 1)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(docs, x) for x in (clash, clash.where("toxic = 1")))
    assert a.lexicon == b.lexicon and (a.weights == b.weights).all()
    assert toxicity.score(empty, m).count() == 0 and toxicity.train(docs, labels.limit(0)).lexicon == {}


@pytest.fixture(scope="module")
def html_model():
    return html_extract.train()


def test_html_model(spark, html_model):
    model, parser = html_model, Parser()
    right = total = 0
    for page, labels in labelled_pages(80, 77):
        got = model.decode([f for _, f in parser.blocks(page)])
        right += sum(a == b for a, (_, b) in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97
    page = '<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav><article><h1>Head &amp; line</h1><p>Some  text\nhere.<p>More &eacute; words < here.</article><footer>&copy; us</footer><script>x</body>'
    assert html_extract.main_text(page, model, parser) == "Head & line\n\nSome text here.\n\nMore é words < here."
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "<a" * 5000), (5, "u", '<p class="' * 300), (6, "u", "<div>" * 20000 + "x")], "page_id long, url string, html string")
    assert html_extract.extract(pages, model).count() == 6


def test_html_names_late_or_deep():
    """Names behind long attributes, and those of every ancestor of a deep element, are read."""
    late = f'<div style="{"x: y; " * 400}" class="comments"><p>text</p></div>'
    deep = "".join(f'<div class="{"".join(chr(97 + int(d)) for d in str(1000 + i))}">' for i in range(300)) + '<div id="advert"><p>text</p></div>'
    (_, a), (_, b) = Parser().blocks(late)[0], Parser().blocks(deep)[0]
    assert "as:comments" in a and {"as:advert", "as:bcjj", "as:baaa"} <= b
    some = frozenset({"as:advert", "as:baaa", "in:p"})
    (_, c) = Parser(some).blocks(deep)[0]
    assert b & some == c & some and "as:bcjj" not in c
    broken = Parser().blocks("<p " + "class=' " * 100_000 + ">text")  # in linear time
    assert len(broken) <= 1
    for page in ("<ul>" + "<li><b>" * 30_000 + "x", "<p><b>x" * 30_000, "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>" for i in range(30_000)) + "x"):
        assert Parser(some).blocks(page)


def test_viterbi_by_enumeration():
    from itertools import product

    r = random.Random(6)
    for _ in range(60):
        m = html_extract.Crf()
        m.weights = {k: r.uniform(-3, 3) for k in "abcdef"}
        m.moves = [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        blocks = [set(r.sample("abcdefg", r.randint(0, 5))) for _ in range(r.randint(1, 7))]
        value = lambda y: sum(v for b, k in zip(blocks, y, strict=True) if k for v in (sum(m.weights.get(f, 0.0) for f in b),)) + sum(m.moves[p][q] for p, q in zip(y, y[1:], strict=False))  # noqa: E731, B023
        every = list(product((0, 1), repeat=len(blocks)))
        assert value(m.decode(blocks)) == pytest.approx(max(map(value, every)))
        z = sum(np.exp(value(y)) for y in every)
        one, pairs = m.marginals(blocks)
        assert one == pytest.approx([sum(np.exp(value(y)) for y in every if y[i]) / z for i in range(len(blocks))])
        for i, p in enumerate(pairs):
            assert [p[a][b] for a in (0, 1) for b in (0, 1)] == pytest.approx([sum(np.exp(value(y)) for y in every if y[i : i + 2] == (a, b)) / z for a in (0, 1) for b in (0, 1)])


def test_html_whole_articles(spark, html_model):
    parser = Parser(frozenset(html_model.weights))
    text = lambda page: html_extract.main_text(page, html_model, parser)
    assert text("<html><body><article><p>The only paragraph of it.</p></article></body></html>") == "The only paragraph of it."
    assert text("<div id=content><p>First paragraph of it, with words.</p><p>Second one.</p></div>") == "First paragraph of it, with words.\n\nSecond one."
    assert text("<body><h1>Title</h1><p>Bare text in a body, and nothing else at all.</p></body>") == "Title\n\nBare text in a body, and nothing else at all."
    odd = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><noscript><p>An image of a cat is here.</p></noscript><object data=x><p>Words in place of the object.</p></object></article>"
    assert text(odd) == "Let x=2 be.\n\nAn image of a cat is here.\n\nWords in place of the object."
    assert text("<body><noscript>Please enable scripts to view this site.</noscript><main><p>The main text is this one here.</p></main></body>") == "The main text is this one here."
    assert text(f"<article>{'<p>A paragraph of many.</p>' * 20_000}</article>").count("\n\n") == 19_999


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_html_given_pages(spark, html_model):
    """The given pages against what stands between their article tags."""
    import html
    import re

    def article(page):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:h\d|p|li|ul|ol|div|pre|blockquote|table|tr|td|section)\b[^>]*>", inner)
        plain = (html.unescape(re.sub("<[^>]*>", lambda t: " " if t[0].startswith("<br") else "", x)) for x in parts)
        return "\n\n".join(x for x in (re.sub(r"\s+", " ", x).strip() for x in plain) if x)

    for size in ("sf0.001", "sf0.01"):
        pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
        want = {r["page_id"]: (r["url"], t, len(t)) for r in pages.collect() for t in (article(r["html"]),)}
        got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.extract(pages, html_model).collect()}
        assert got == want


def plain_raking(cells, targets, keep):
    """Probabilities by bisection for each value's factor, in plain Python; cells: {(d0, d1, d2): tokens}."""
    whole = sum(cells.values())
    shares = []
    for i, t in enumerate(targets):
        total = sum(x for v, x in t.items() if any(k[i] == v for k in cells))
        shares.append({v: x / total for v, x in t.items()})
    u = dict.fromkeys(cells, keep)
    for _ in range(60):
        for i, t in enumerate(shares):
            for v in {k[i] for k in cells}:
                own = [k for k in cells if k[i] == v]
                want, low, high = t.get(v, 0.0) * keep * whole, 0.0, 1e9
                for _ in range(200):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(cells[k] * min(1, mid * u[k]) for k in own) < want else (low, mid)
                for k in own:
                    u[k] *= (low + high) / 2
    return {k: min(1, x) for k, x in u.items()}


def test_raking_brute_force(spark):
    r = random.Random(12)
    cells = {(a, b, c): r.randint(1, 400) for a in "stu" for b in ("en", "de", "fr") for c in ("note", "prose") if r.random() < 0.9}
    targets = [{"s": 4, "t": 3, "u": 3, "absent": 4}, {"en": 4, "de": 3, "fr": 3}, {"note": 1, "prose": 1}]
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "d0 string, d1 string, d2 string, n long")
    raked, share = mixing.rake(df, [spark.createDataFrame([(v, float(x)) for v, x in t.items()], f"d{i} string, target double") for i, t in enumerate(targets)], 0.95)
    got = {(x["d0"], x["d1"], x["d2"]): x["p"] for x in raked.collect()}
    want = plain_raking(cells, targets, share)
    assert 0.3 < share < 0.95 and got.keys() == want.keys() and max(got.values()) == 1  # targets shrank, some cells are cut
    assert all(abs(got[k] - want[k]) < 1e-4 for k in want)
    for i, t in enumerate(targets):
        total = sum(x for v, x in t.items() if v != "absent")
        for v, x in t.items():
            met = sum(n * got[k] for k, n in cells.items() if k[i] == v)
            assert v == "absent" or met == pytest.approx(x / total * share * sum(cells.values()), rel=1e-5)


def test_raking_meets_default_targets(docs, rows, empty):
    from pyspark.sql import functions as F

    clash = docs.withColumns({"p": F.lit(9), "ratio": F.lit("r"), "n": F.lit(1), "d0": F.lit("x"), "sampled": F.lit(7), "row": F.lit(5)})
    got = mixing.mixed(clash).select("n", "d0", "d1", "d2", "p", "ratio", "sampled", F.col("row.p").alias("own")).toPandas()
    assert len(got) == len(rows) and (got["own"] == 9).all() and got["p"].between(0, 1).all()
    got["w"] = got["n"] * got["p"]
    for i in range(3):
        own = got.groupby(f"d{i}")["n"].sum()
        own = own[own > 0]
        target = (own**mixing.TEMPER) / (own**mixing.TEMPER).sum()
        met = got.groupby(f"d{i}")["w"].sum() / got["w"].sum()
        assert (abs(met[target.index] / target - 1) < 0.01).all()
    kept = mixing.mix(clash)
    assert kept.columns == clash.columns and kept.schema == clash.schema and {(x["p"], x["sampled"], x["row"]) for x in kept.collect()} == {(9, 7, 5)}
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_sample_meets_targets(spark):
    r = random.Random(11)
    rows = [(i, " ".join(words(r, 40 if i % 50 else 400)), "de" if i % 40 == 0 else "en", "rare" if i % 20 == 0 else "usual") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = [spark.createDataFrame(t, f"d{i} string, target double") for i, t in enumerate(([("rare", 0.2), ("usual", 0.8)], [("de", 0.1), ("en", 0.9)], [("note", 0.6), ("prose", 0.4)]))]
    got = mixing.mixed(docs, targets).toPandas()
    for weight, most in (("p", 1e-3), ("sampled", 0.15)):
        got["w"] = got["n"] * got[weight]
        for i, t in enumerate(targets):
            met = got.groupby(f"d{i}")["w"].sum() / got["w"].sum()
            assert all(abs(met[x[f"d{i}"]] / x["target"] - 1) < most for x in t.collect() if x[f"d{i}"] in met)
