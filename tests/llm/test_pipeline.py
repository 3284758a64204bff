"""The pipeline's stages over a small scale, and the registry."""

import hashlib
import importlib.util
import random
import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_and_keeps_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, counts = docs.columns, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == first
    assert counts[0] >= counts[1] == counts[2] > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_every_operator_is_registered():
    from lectern.llm.registry import QUERIES, SQL

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(SQL) <= set(QUERIES)
    import __spark_entry__

    assert set(QUERIES) < set(__spark_entry__.queries())
    if importlib.util.find_spec("corpus_pipeline"):
        assert "pipeline" in __spark_entry__.queries()


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_near_copies_from_080_on_are_dropped(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    dice, rows, gone = random.Random(8), [], set()
    for n in range(60):
        words = [f"w{n}-{k}" for k in range(300)]
        own = list(words)
        for k in dice.sample(range(10, 290, 8), 5 + n % 3):
            own[k] = f"v{k}"
        one, two = shingles(" ".join(words)), shingles(" ".join(own))
        if 100 * len(one & two) >= 80 * len(one | two):
            assert len(one & two) < 0.85 * len(one | two)
            gone.add(2 * n + 1)
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(own))]
    assert len(gone) == 40
    kept = pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert {r["doc_id"] for r in kept} == set(range(120)) - gone


def test_bands_follow_the_threshold():
    from lectern.llm import minhash

    assert minhash.bands_for(85) == 20
    for percent in range(20, 100):
        bands = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** minhash.ROWS) ** bands <= minhash.MISS * (1 + 1e-9)
    assert minhash.bands_for(100) == 1


def queue(rows):
    """Ids in the order of the mix, of (id, words, source) with distinct ids."""
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    size = {s: sum(n for _, n, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = [s for s in free if 3 * size[s] < weight[s] * level]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= target[s]
            free.remove(s)
    target |= {s: weight[s] * level for s in free}
    copies = []
    for k, s in enumerate(names):
        own = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, n) for i, n, x in rows if x == s)
        end = 0
        for order, i, n in own:
            end += n
            copies += [((end + e * size[s]) / target[s], k, order, i, n) for e in range(3) if n]
    taken, total = [], 0
    for *_, i, n in sorted(copies):
        total += n
        if total > sum(size.values()):
            break
        taken.append(i)
    return taken


@pytest.mark.parametrize("repeats", [False, True])
def test_stages_equal_plain_versions(spark, tmp_path, repeats):
    pipeline = pytest.importorskip("corpus_pipeline")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    dice = random.Random(31)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in ("a", "e", "ou", "ü") for c in ("l", "n", "rt", "m")]
    prose = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(dice.randint(40, 120)), f"s{i % 4}" if i % 7 else None) for i in range(60)]
    passage, upper = prose(55), str.maketrans("abcdefg", "ABCDEFG")
    rows += [(100 + i, prose(30) + " " + passage + " " + prose(30), "s1") for i in range(4)]
    rows += [(200 + i, t.replace(" ", "  ", 3).translate(upper) if i % 2 else t + " extra", s) for i, (_, t, s) in enumerate(rows[:6])]
    rows += [(300 + i, prose(20) + f" vile{'scum'} " + prose(20), "s2") for i in range(60)]
    rows += [(400, None, "s1"), (401, "", None), (402, " \n ", "s0"), (403, prose(9000), "s3")]
    if repeats:
        rows += [rows[3], rows[3], (5, prose(50), "s0"), (None, prose(30), "s1"), (None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, _ka string"
    frame = spark.createDataFrame([(i, t, None, s, len(t or ""), 1, "k") for i, t, s in rows], schema)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(300 <= i < 400)) for i, *_ in rows if i is not None and i < 400], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, found = frame, []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        found.append(docs)
    assert all(f.columns == frame.columns for f in found[:-1])
    pairs = lambda f: sorted(((r["doc_id"], r["text"]) for r in f.collect()), key=str)
    # Toxicity.
    clean = [r for r in rows if r[0] is None or not 300 <= r[0] < 400]
    assert pairs(found[0]) == sorted(((i, t) for i, t, _ in clean), key=str)
    # Near-duplicates: one row of each group.
    texts, group = {}, {}
    for i, t, _ in clean:
        if i is not None:
            texts.setdefault(i, []).append(t or "")
    for i in sorted(texts):
        group[i] = i
        near = [j for j in group if j != i and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in map(shingles, texts[i]) for y in map(shingles, texts[j]))]
        for j in sorted(near):
            low, high = sorted((group[i], group[j]))
            group = {k: low if v == high else v for k, v in group.items()}
    kept = [r["doc_id"] for r in found[1].collect()]
    assert sorted(i for i in kept if i is not None) == sorted({i for i in texts if group[i] == i})
    assert kept.count(None) == sum(i is None for i, *_ in clean)
    # Passages, judged on what the stage before gave.
    seen, left = set(), []
    for i, t in sorted((r["doc_id"], r["text"]) for r in found[1].where("doc_id is not null").collect()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        left.append((i, None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    assert pairs(found[2].where("doc_id is not null")) == sorted(left, key=str)
    assert sum(passage in (t or "") for _, t in left) == 1
    # Mix.
    third = found[2].collect()
    if not repeats:
        assert [r["doc_id"] for r in found[3].collect()] == queue([(r["doc_id"], len((r["text"] or "").split()), r["source"]) for r in third])
    assert {(r["doc_id"], r["text"]) for r in found[3].collect()} <= {(r["doc_id"], r["text"]) for r in third}
    # Packing.
    plain = Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    pieces, places = {}, {}
    for r in found[4].collect():
        ids = list(r["ids"])
        assert len(ids) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) == r["ids_crc32"]
        pieces.setdefault((r["doc_id"], r["row"]), []).append((r["piece"], r["start"], ids))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    made = sorted((str(i), [x for _, _, ids in sorted(p) for x in ids]) for (i, _), p in pieces.items())
    assert made == sorted((str(r["doc_id"]), plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in found[3].collect())
    total = 0
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 4096
        total += end
    assert len(places) <= -(-total // 4096) + 1
