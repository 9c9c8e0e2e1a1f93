"""Every stage against plain code of its own, on its own input."""

import os
import random

import pytest
import xxhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import plain_measures, plain_raking, plain_votes, words  # noqa: E402

from landgrain.llm import mixing, quality  # noqa: E402
from landgrain.sources.staging import staged  # noqa: E402

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_dedup(rows):
    """Of each component of fingerprints at 4 bits or fewer, the rows with its smallest doc_id; one of its texts, once."""
    fps = [plain_fingerprint(r["text"]) for r in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {}
    for p, r in zip(part, rows, strict=True):
        if r["doc_id"] is not None:
            least[p] = min(least.get(p, r["doc_id"]), r["doc_id"])
    return sorted(set(least.values())), sum(r["doc_id"] is None for r in rows)


def plain_clean(rows, items):
    import re

    terms = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    windows = set()
    for t in items:
        w = terms(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(k) for k in windows}
    out = []
    for r in rows:
        w = terms(r["text"])
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            out.append(r["doc_id"])
    return out


def plain_mix(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, r["doc_id"], r["text"], r["source"], r["lang"]) for i, r in enumerate(rows)], "i int, doc_id long, text string, source string, lang string")
    u = {r["i"]: (r["h"], r["t"]) for r in df.select("i", F.xxhash64(F.lit("mix"), "doc_id", F.coalesce("text", F.lit(""))).alias("h"), mixing.topic().alias("t")).collect()}
    cell = lambda i, r: ("\0null" if r["source"] is None else r["source"], "\0null" if r["lang"] is None else r["lang"], u[i][1])
    cells = {}
    for i, r in enumerate(rows):
        n = len((r["text"] or "").split())
        if n:
            cells[cell(i, r)] = cells.get(cell(i, r), 0) + n
    targets = []
    for d in range(3):
        have = {}
        for k, n in cells.items():
            have[k[d]] = have.get(k[d], 0) + n
        targets.append({v: n**mixing.TEMPER for v, n in have.items()})
    return cells, targets, [(((u[i][0] % (1 << 64)) >> 11) / (1 << 53), cell(i, r)) for i, r in enumerate(rows)]


def check(spark, docs, folder):
    bench = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, folder), name)
        had, kept = before.collect(), after.select(*before.columns).collect()
        assert set(map(str, kept)) <= set(map(str, had)), name
        ids = sorted(str(k["doc_id"]) for k in kept)
        if name == "quality_classifier":
            # the votes of the stage's own label model, where they are clear, agree with what is kept
            model = quality.train(before)
            stays = set(ids)
            clear = agree = 0
            for r in had:
                if (r["text"] or "").split():
                    m, _, n = plain_measures(r["text"])
                    p = model.labels.posterior[quality._code(list(plain_votes(m, n)))]
                    if not 0.05 < p < 0.95:
                        clear += 1
                        agree += (str(r["doc_id"]) in stays) == (p > 0.5)
                else:
                    assert str(r["doc_id"]) not in stays or r["doc_id"] is None
            assert agree >= 0.95 * clear
        elif name == "near_dedup":
            named, unnamed = plain_dedup(had)
            assert sorted({str(k["doc_id"]) for k in kept if k["doc_id"] is not None}) == sorted(map(str, named)) and ids.count("None") == unnamed
        elif name == "decontamination":
            assert ids == sorted(map(str, plain_clean(had, bench)))
        elif name == "source_mixing":
            cells, targets, drawn = plain_mix(spark, had)
            if cells:
                raked, share = mixing.rake(spark.createDataFrame([(*k, n) for k, n in cells.items()], "d0 string, d1 string, d2 string, n long"), [spark.createDataFrame([(v, float(x)) for v, x in t.items()], f"d{d} string, target double") for d, t in enumerate(targets)])
                p = plain_raking(cells, targets, share)
                sure = {str(r["doc_id"]) for r, (u, k) in zip(had, drawn, strict=True) if u < p.get(k, 0.0) - 1e-3}
                maybe = {str(r["doc_id"]) for r, (u, k) in zip(had, drawn, strict=True) if u < p.get(k, 0.0) + 1e-3}
                assert sure <= set(ids) <= maybe
        else:
            assert ids == sorted(str(r["doc_id"]) for r in had)
            slots = {}
            for r in after.collect():
                slots.setdefault(r["shard"], []).append(r["slot"])
            assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and (not slots or max(map(len, slots.values())) - min(map(len, slots.values())) <= 1)
        if name != "hilbert_sharding":
            assert after.schema == docs.schema
        before = after.select(*docs.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stages_on_documents(spark):
    check(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)


def test_stages_on_odd_rows(spark, tmp_path):
    r = random.Random(17)
    prose = lambda n: " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(words(r, n)))
    texts = [prose(r.randint(40, 160)) for _ in range(30)]
    item = " ".join(texts[3].split()[5:20])
    rows = [(i, t, r.choice(["en", "de"]), r.choice(["s", "t"])) for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, texts[1], "en", "s"), (40, "", "en", None), (41, None, "de", "s"), (42, " \n", None, "s"), (43, "one", "en", "s")]
    rows += [rows[2], rows[2], (50, texts[4], "en", "s"), (7, prose(60), "en", "s"), (60, prose(5000), "en", "s")]
    schema = "doc_id long, text string, lang string, source string, p int, ratio int, n int, row int, tag int, doc string, slot_ int, `__keep` int, `__text` int, least_id int, hit_id int, tie int, at int"
    docs = spark.createDataFrame([(*x, 1, 2, 3, 4, 5, "d", 6, 7, 8, 9, 10, 11, 12) for x in rows], schema)
    for some, folder in ((docs, "odd"), (docs.limit(0), "none")):
        folder = str(tmp_path / folder)
        some.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item), (None, "two words"), (3, None), (3, "!")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        check(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
