"""The training-data operators on small tables: plain versions, nulls, empty tables, repeated rows, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import components, covertree, minhash, mixing, packing, quality, suffix_dedup, toxicity, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 7, "x") for i, t, s in rows], DOCS)


def odd(spark):
    dice = random.Random(1)
    prose = lambda n: " ".join(dice.choice(("one", "two", "three", "four", "fünf", "six")) for _ in range(n))
    shared = prose(60)
    rows = [(i, prose(30) + " " + shared + " " + prose(20), f"s{i % 3}") for i in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "   ", "s1"), (None, "no id here at all", "s1"), (23, rows[0][1], "s0"), (23, rows[0][1], "s0"), (24, prose(3000), "s2"), (25, "two words", None)]
    return rows


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199), (199, 201)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[k] == 100 for k in range(100, 130)) and got[201] == 199 and len(got) == 51 + 30 + 3
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_equals_all_pairs(spark):
    dice = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [[dice.choice(vocabulary) for _ in range(120)] for _ in range(6)]
    texts = []
    for words in base:
        for _ in range(12):
            own = list(words)
            for _ in range(dice.randint(0, 5)):
                own[dice.randrange(len(own))] = dice.choice(vocabulary)
            texts.append(" ".join(own))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1000 + (i or 0), t, s) for i, t, s in odd(spark) if i is not None] + [(None, "x", "s")]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])


def test_large_buckets_are_held_in_blocks(spark, monkeypatch):
    dice = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in dice.sample(range(100), dice.randint(1, 3)):
            own[k] = f"v{i}-{k}"
        rows.append((i, " ".join(own), "s"))
    plain = sorted(map(tuple, minhash.near_duplicates(table(spark, rows)).collect()))
    monkeypatch.setattr(minhash, "SMALL", 0)
    monkeypatch.setattr(minhash, "GRID", 20)
    monkeypatch.setattr(minhash, "SALTED", 7)
    assert sorted(map(tuple, minhash.near_duplicates(table(spark, rows)).collect())) == plain
    monkeypatch.setattr(minhash, "CELL", 16 * 96 * 5)  # five sets of 96 shingles
    assert sorted(map(tuple, minhash.near_duplicates(table(spark, rows)).collect())) == plain


def test_rows_that_repeat_an_id_keep_the_links_of_all_their_texts(spark):
    text = lambda k, *edits: " ".join(f"w{k}-{n}" if n not in edits else f"v{n}" for n in range(200))
    rows = [(5, text(1), "s"), (5, text(2), "s"), (5, text(3), "s"), (7, text(1, 50), "s"), (8, text(2, 60), "s"), (9, text(3, 70), "s"), (3, text(3, 71), "s"), (20, text(4), "s"), (20, text(4), "s")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {5: 3, 7: 3, 8: 3, 9: 3, 3: 3, 20: 20}


def brute_passages(rows):
    """n_bytes, n_removed, n_spans and hash by id, of (id, text) with distinct ids or equal texts."""
    out, seen = {}, set()
    for i, t in sorted({(i, t or "") for i, t in rows if i is not None}):
        b, gone = t.encode(), bytearray(len(t.encode()))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(frame):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.dedup(frame).where("doc_id is not null").collect()}


def test_suffix_dedup_equals_brute_force(spark):
    rows = odd(spark) + [(30, "ab" * 130, "s"), (31, "q" * 50 + "ab" * 70, "s"), (32, "é" * 130, "s"), (33, "x" * 99, "s")]
    assert passages(table(spark, rows)) == brute_passages([r[:2] for r in rows])
    assert suffix_dedup.dedup(table(spark, rows)).where("doc_id is null").first()["n_removed"] == 0
    left = suffix_dedup.reduced(table(spark, rows))
    assert left.columns == table(spark, rows).columns and left.count() == len(rows)
    assert left.where("doc_id = 20").first()["text"] is None


def test_suffix_dedup_tells_ends_from_zeros(spark):
    dice = random.Random(12)
    shared = "".join(dice.choice("ab\0") for _ in range(90))
    rows = [(i, "\0" * dice.randint(0, 30) + shared + "\0" * dice.randint(0, 40) + dice.choice(("", "a", "\0a")), "s") for i in range(80)]
    assert passages(table(spark, rows)) == brute_passages([r[:2] for r in rows])


@pytest.mark.parametrize("hot,hotter", [(3, 10_000), (3, 6)])
def test_hot_anchors_are_split(spark, monkeypatch, hot, hotter):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOTTER", hotter)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    dice = random.Random(13)
    noise = lambda n: "".join(dice.choice("abc ") for _ in range(n))
    word, passage = noise(45), noise(130)
    rows = [(i, noise(dice.randint(0, 60)) + dice.choice((word, passage)) + noise(dice.randint(0, 60)), "s") for i in range(120)]
    rows += [(200 + i, noise(1) + passage + noise(2), "s") for i in range(60)] + [(300, noise(1500) + passage + "a" * 900 + word, "s")] + rows[:5]
    assert passages(table(spark, rows).repartition(3)) == brute_passages([r[:2] for r in rows])


def test_suffix_dedup_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert passages(docs) == brute_passages([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_cover_tree_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(90, 8)), rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(60, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(500, None, 1), (501, [], 1), (502, [0.0] * 8, 1), (503, [float("nan")] * 8, 1), (504, [None] + [1.0] * 7, 1), (505, [1.0, 2.0], 1), (None, [1.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = covertree.directions(x.astype(float))
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in covertree.near_pairs(frame, 0.9).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.array([low[np.flatnonzero(unit @ unit[i] >= 0.9)].min() for i in range(len(x))])
    assert [got[i]["component_id"] for i in range(len(x))] == low.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(500, 506)) and len(got) == len(rows)
    whole = np.floor(1024 * x.astype(float))
    found = {}
    for r in covertree.top_k(frame, frame.where("vec_id % 25 = 0"), 5, 1024.0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i in range(0, len(x), 25):
        scores = [(-int(whole[i] @ whole[k]), k) for k in range(len(x)) if k != i] + [(0, 502)]
        assert [found[i][k + 1] for k in range(5)] == [(n, -s) for s, n in sorted(scores)[:5]]
    empty = frame.where("false")
    assert covertree.near_pairs(empty, 0.9).count() == 0 and covertree.top_k(empty, empty, 5, 1.0).count() == 0


def test_packing_is_gapless_and_whole(spark):
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("word_bpe_49k.json"))
    rows = odd(spark)
    got = packing.packed_documents(table(spark, rows), path, length=256).collect()
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 256
    encoder = packing.Encoder(path)
    assert sum(r["length"] for r in got) == sum(len(encoder.encode(t or "")) // 4 + 1 for _, t, _ in rows)
    ids = packing.packed_documents(table(spark, rows), path, length=256, with_ids=True).where("doc_id = 24").orderBy("piece").collect()
    assert sum((list(r["ids"]) for r in ids), []) == np.frombuffer(encoder.encode(rows[-2][1]), "<u4").tolist() + [1]
    assert packing.packed_documents(table(spark, rows).where("false"), path).count() == 0


def test_mix_meets_targets_and_repeats(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 4}" if i % 5 else None) for i in range(400)] + odd(spark)
    frame = table(spark, rows)
    got = mixing.mix(frame).collect()
    monkeypatch.setattr(mixing, "RANGE", 37)
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    total = sum(r["size"] for r in got)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    by_target, longest = {}, max(r["size"] for r in got)
    for r in got:
        by_target[r["target"]] = by_target.get(r["target"], 0) + r["taken"]
    assert total - longest < sum(by_target.values()) <= total
    # A source runs behind or ahead by its next document at most.
    assert all(abs(n - target) <= 2 * longest for target, n in by_target.items())
    assert sorted(r["position"] for r in got if r["position"]) == sorted({r["position"] for r in got if r["taken"]})
    copies = mixing.mixed(frame)
    assert copies.columns == frame.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix(frame.where("false")).count() == 0 and mixing.mixed(frame.where("false")).count() == 0


@pytest.mark.parametrize("alike", [False, True])
def test_mixed_is_in_the_order_of_the_queue(spark, alike):
    rows = [(i, "w " * (i % 5 + 1), f"s{i % 3}") for i in range(60)] + ([(3, "w " * 4, "s0")] * 3 if alike else [])
    frame = table(spark, rows)
    place = {}
    for r in mixing.mix(frame).where("position is not null").collect():
        place[r["doc_id"]] = min(r["position"], place.get(r["doc_id"], 10**9))
    met = list(dict.fromkeys(r["doc_id"] for r in mixing.mixed(frame).collect()))
    assert met == sorted(place, key=place.get)


def test_repeated_query_ids_and_ties(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), (3, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (1, [0.0, 1.0], 1), (1, [0.0, 1.0], 1), (5, [1.0, 1.0], 1), (None, [9.0, 9.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = covertree.top_k(frame, frame.where("vec_id = 100"), 4, 8.0).orderBy("rank").collect()
    # The least vector of id 100, (0, 1), asks; neither row of its id is a candidate.
    assert [tuple(r) for r in got] == [(100, 1, 1, 64), (100, 2, 1, 64), (100, 3, 2, 64), (100, 4, 3, 64)]
    links = {r["vec_id"]: r["n_links"] for r in covertree.near_pairs(frame, 0.9).collect()}
    assert (links[1], links[2], links[100]) == (2 + 2, 2, 2)


def test_targets_are_capped_and_reshared(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 90), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert got["a"] == 30.0 and abs(sum(got.values()) - 200) < 1e-9 and abs(got["b"] - 2 * got[None]) < 1e-9


def test_columns_with_clashing_names_stay(spark):
    names = "_tag _tag0 _no _no0 _copy copies _spans _score _id _own _ka _position place no _range".split()
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(20)), f"s{i % 2}") for i in range(6)]
    frame = table(spark, rows).select("*", *(F.lit(7).alias(n) for n in names), F.lit("x").alias("_Text"))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for out in (mixing.mixed(frame), suffix_dedup.reduced(frame), toxicity.filtered(frame, labels)):
        assert out.columns == frame.columns
        assert {r["doc_id"]: r["text"] for r in out.collect()}.items() <= {i: t for i, t, _ in rows}.items()
        assert all(r[n] == 7 for r in out.collect() for n in names)


def test_classifiers_score_every_row(spark):
    rows = [(i, ("idiotic moron " if i % 3 == 0 else "kind words ") + f"about thing{i % 9} and others of a kind", "s") for i in range(120)] + odd(spark)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(100)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    frame = table(spark, rows)
    for f, top in ((toxicity.score, 0.3), (quality.score, 0.7)):
        for own in (labels, labels.where("false")):
            got = f(frame, own).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= top) for r in got)
    assert {r["doc_id"] for r in toxicity.score(frame, labels).where("predicted = 1").collect()} == set(range(0, 120, 3))
    kept = toxicity.filtered(frame, labels)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 40
    assert quality.score(frame.where("false"), labels).count() == 0 and toxicity.score(frame.where("false"), labels).count() == 0
    spans = toxicity.score(frame, labels).where("doc_id = 3").first()["spans"]
    assert [rows[3][1].encode()[s["start"] : s["end"]] for s in spans] == [b"idiotic moron"]


def test_samples_have_one_text_an_id_and_a_bound_of_bytes(spark, monkeypatch):
    from lectern.llm import labelled

    rows = [(4, "b" * 10, "s"), (4, "a" * 10, "s"), (4, None, "s"), (8, "c" * 50, "s"), (9, "d" * 5, "s"), (None, "e", "s")]
    labels = spark.createDataFrame([(i, 1) for i in (4, 4, 8, 9, None, 11)], "doc_id long, toxic int")
    known = [i for i in (4, 8, 9) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = {4: "", 8: "c" * 50, 9: "d" * 5}
    assert sorted(labelled.sample(table(spark, rows), labels, "toxic", 10)) == sorted((texts[i], 1) for i in known)
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 20)
    assert sorted(labelled.sample(table(spark, rows), labels, "toxic", 10)) == sorted((texts[i], 1) for i in known if i != 8)


def test_url_rules(spark):
    rules = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]
    rows = [(1, "http://A.example.NET/en/x?y"), (2, "http://example.net/de/"), (3, "https://xexample.com/de/1"), (4, "ftp://b.example.com/de/#a"), (5, "http://w.org/fr/"), (6, None), (7, "no scheme"), (8, "http://net"), (9, "http://example.com?/de/"), (10, "x://y://example.net/en/"), (1, "http://A.example.NET/en/x?y")]
    frame = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(frame, rules).select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), "verdict").collect())
    assert got == sorted([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/de/", "net/", "block"), (3, "xexample.com", "/de/1", "", "allow"),
        (4, "b.example.com", "/de/", "example.com/de/", "block"), (5, "w.org", "/fr/", "org/fr/", "allow"), (6, "", "", "", "allow"), (7, "", "", "", "allow"), (8, "net", "", "", "allow"), (9, "example.com", "", "", "allow"), (10, "y:", "//example.net/en/", "", "allow"),
    ])
    assert url_filters.judge(frame.where("false"), rules).count() == 0
    with pytest.raises(ValueError):
        url_filters.parse("deny x/")


def test_many_nested_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "RANGES", 9)
    dice = random.Random(6)
    label = lambda: dice.choice("abcde") + dice.choice(("", "", "\x01", "\x02", "é"))
    host = lambda n: ".".join(label() for _ in range(n))
    rules = sorted({f"{dice.choice(('allow', 'block'))} {host(dice.randint(1, 3))}/{dice.choice(('', 'x/', 'x/y'))}" for _ in range(400)})
    rows = [(i, f"http://{host(dice.randint(1, 5))}/{dice.choice(('', 'x/', 'x/yz', 'q'))}") for i in range(700)]
    rows += [(1000 + i, "http://a.b.c.d/x/") for i in range(500)] + [(2000, "http://net\x01a/"), (2001, "http://a\x01.net/")]
    rules.append("block a/")
    parsed = [url_filters.parse(r) for r in rules]
    for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect():
        fits = [(len(x.host + x.path), len(x.host), x.host + x.path, x.path, x.verdict) for x in parsed if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = max(fits, default=(0, 0, None, None, "allow"))
        assert (r["rule"], r["verdict"]) == (best[2], best[4]), r


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c/\r\nX: y", None), (4, "u", ""), (5, "u", "z" * 100_000), (5, "u", "z" * 100_000), (None, "u", "alone"), (7, "", "WARC/1.0\r\n\r\n"), (None, "u", "<p>é</p>"), (None, "u", "nameless twice"), (None, "v", "nameless twice")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    every = warc.round_trip(frame).collect()
    nameless = sorted((r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in every if r["page_id"] is None)
    # Without an id a record revisits the one with the largest id, and none revisits it.
    assert nameless == [(5, "response", 0), (9, "revisit", 2), (14, "response", 0), (14, "response", 0)]
    got = {r["page_id"]: r for r in every}
    for i, _, html in ((i, u, h) for i, u, h in rows if i is not None):
        body = (html or "").encode()
        assert got[i]["payload_bytes"] == len(body) and got[i]["payload_digest"] == warc.digest_of(body)
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and got[2]["record_type"] == "response"
    assert got[3]["refers_to"] == 4 and got[5]["record_type"] == "response"
    assert warc.round_trip(frame).count() == len(rows)
    assert warc.round_trip(frame.where("false")).count() == 0
