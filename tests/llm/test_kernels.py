"""Kernels of the training-data operators against plain versions, without Spark."""

import random
import zlib

import numpy as np
import pytest

from lectern.llm import covertree, minhash, packing, quality, suffix_dedup, toxicity, warc
from lectern.llm.labelled import held_out  # noqa: F401
from lectern.llm.shared import Rolling, slices, words
from lectern.llm.suffix_array import suffix_array


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_suffix_array_equals_sorting():
    dice = random.Random(5)
    for _ in range(3000):
        x = [dice.randint(0, dice.choice((0, 1, 2, 9))) for _ in range(dice.randint(0, 24))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_words_and_hashes():
    data, offsets = arrays(["Ab c\x0bd", "", "  ", "e\u00a0f g", "x"])
    start, end, row = words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == ["Ab", "c", "d", "e\u00a0f", "g", "x"]
    assert row.tolist() == [0, 0, 0, 3, 3, 4]
    rolling = Rolling(np.frombuffer(b"abcabc", np.uint8))
    assert rolling.of(np.array([0]), np.array([3])) == rolling.of(np.array([3]), np.array([6]))
    assert list(slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_shingles_are_distinct_and_short_texts_are_one():
    data, offsets = arrays(["A b c d e f", "a B c", "a b c", "", "a a a a a a a"])
    values, counts = minhash.shingles(data, offsets)
    assert counts.tolist() == [2, 1, 1, 0, 1]
    assert values[2] == values[3]


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.sort(base[:360]), np.sort(base[40:])
    s = minhash.signatures(np.concatenate([a, b]), np.array([360, 360]), 512)
    assert abs((s[0] == s[1]).mean() - 320 / 400) < 0.07


def brute_removed(texts):
    seen, out = set(), []
    for text in texts:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out.append(bytes(gone))
    return out


def test_runs_cover_every_string_once():
    dice = random.Random(3)
    texts = ["".join(dice.choice("ab") for _ in range(n)) for n in (99, 100, 101, 400, 0, 700)] + ["a" * 350]
    data, offsets = arrays(texts)
    part, begin, width, lead, _, _ = suffix_dedup.anchored_runs(data, offsets)
    covered = sorted((p, int(b) - offsets[p] + k) for p, b, w in zip(part, begin, width) for k in range(w + 1))
    assert covered == [(p, s) for p, t in enumerate(texts) for s in range(len(t) - 99)]
    assert ((lead >= width) & (lead <= suffix_dedup.SPAN - 1)).all()


def test_hashes_of_runs_are_those_of_their_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    begin, size = rng.integers(0, 3800, 3000), rng.integers(0, 168, 3000)
    seen = {}
    for b, n, h in zip(begin, size, suffix_dedup.hash_of(data, begin, size)):
        assert seen.setdefault(data[b : b + n].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_runs_of_an_anchor_are_numbered_over_chunks(monkeypatch):
    import pyarrow as pa

    dice = random.Random(7)
    rows = sorted((dice.choice((1, 2, 2, 2, 3, 9)) if k < 300 else 100 + k, dice.randint(0, 40), k, 0, 0) for k in range(340))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], pa.int64()) for c in range(5)] + [pa.array([0] * len(part), pa.int32()), pa.array([5] * len(part), pa.int16()), pa.array([0] * len(part), pa.int32())], suffix_dedup._NAMES)
    want = None
    for chunk in (10_000, 1, 7, 50):
        monkeypatch.setattr(suffix_dedup, "_ROWS", chunk)
        got = [tuple(r.values()) for b in suffix_dedup._resolved(iter([batch(rows[i : i + 13]) for i in range(0, len(rows), 13)])) for r in b.to_pylist()]
        want = want or sorted(got)
        assert sorted(got) == want
    runs = {}
    for h, c, *_ in rows:
        runs.setdefault(h, set()).add(c)
    questions = [r for r in want if r[6] >= 0]
    assert sorted((r[0], r[7]) for r in questions) == sorted((h, k) for h, cs in runs.items() if len(cs) > 1 for k in range(len(cs)))
    assert len(want) - len(questions) == len(rows) - sum(map(len, runs.values()))


def test_long_texts_are_read_in_segments(monkeypatch):
    import pyarrow as pa

    dice = random.Random(17)
    texts = ["".join(dice.choice("abcd") for _ in range(n)) for n in (2500, 90, 1100, 100)]
    texts.append(texts[0][300:1900])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array([0] * 5, pa.int64()), pa.array(texts)], ["doc_id", "tag", "text"])
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    whole = [r for b in suffix_dedup._runs(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 400)
    parts = [r for b in suffix_dedup._runs(iter([batch])) for r in b.to_pylist()]
    # Each string is in one run or, if it is known to go, in a span.
    for rows in (whole, parts):
        runs = [(r["doc_id"], r["start"] + k) for r in rows if r["lead"] >= 0 for k in range(r["width"] + 1)]
        spans = {(r["doc_id"], r["start"] + k) for r in rows if r["lead"] < 0 for k in range(r["width"] + 1)}
        assert len(runs) == len(set(runs))
        assert set(runs) | spans >= {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)}
        for i, k in spans - set(runs):
            assert any(texts[i][k : k + 100] in texts[j][: k + 99 if i == j else None] for j in range(i + 1))


def test_merged_spans():
    assert suffix_dedup.merged(np.array([[5, 9], [0, 2], [2, 3], [6, 7], [20, 30]])).tolist() == [[0, 3], [5, 9], [20, 30]]


@pytest.mark.parametrize("dims,spread", [(3, 0.3), (16, 0.05), (64, 1.0)])
def test_cover_tree_links_and_search(dims, spread):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    x = np.concatenate([c + spread * rng.normal(size=(25, dims)) for c in centres])
    unit = covertree.directions(x)
    a, b = covertree.Tree.build(unit[:140]), covertree.Tree.build(unit[140:])
    b = covertree.Tree.load(unit[140:], b.dump())
    for node in range(len(a.point)):
        own = a.members(node)
        assert np.linalg.norm(unit[own] - unit[a.point[node]], axis=1).max() <= a.radius[node] + 1e-6
    ca, cb, edges = covertree.linked(a, b, 0.9)
    truth = unit[:140] @ unit[140:].T >= 0.9
    assert ca.tolist() == truth.sum(1).tolist() and cb.tolist() == truth.sum(0).tolist()
    i, j = np.nonzero(truth)
    want = {tuple(e) for e in covertree.stars(i, j + 140, len(x)).tolist()}
    assert {tuple(e) for e in edges.tolist()} == want
    whole = np.floor(100 * x)
    search = covertree.Search(covertree.Tree.build(whole[:20]), np.arange(20), 7)
    search.over(covertree.Tree.build(whole[::2]), np.arange(0, len(x), 2))
    search.over(covertree.Tree.build(whole[1::2]), np.arange(1, len(x), 2))
    for r, (names, scores) in enumerate(zip(search.name, search.score)):
        order = sorted((-(whole[r] @ whole[k]), k) for k in range(len(x)) if k != r)[:7]
        assert names.tolist() == [k for _, k in order] and scores.tolist() == [-s for s, _ in order]


def test_search_prunes_queries_in_many_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.floor(1024 * np.repeat(centres, 100, 0) + 10 * rng.normal(size=(4000, 16)))
    names = np.arange(len(x)) // 2 * 2  # every id twice
    asked = np.arange(0, len(x), 100)
    search = covertree.Search(covertree.Tree.build(x[asked]), names[asked], 10)
    search.over(covertree.Tree.build(x), names)
    assert search.products < 0.2 * len(asked) * len(x)
    for q, found, scores in zip(asked, search.name, search.score):
        order = sorted((-(x[q] @ x[k]), names[k]) for k in range(len(x)) if names[k] != names[q])[:10]
        assert found.tolist() == [k for _, k in order] and scores.tolist() == [-s for s, _ in order]


def test_radii_cover_vectors_that_all_but_coincide():
    rng = np.random.default_rng(5)
    base = covertree.directions(rng.normal(size=(40, 16)))
    turned = base + 0.45 * rng.normal(size=base.shape) / 4
    x = covertree.directions(np.concatenate([base, turned, base + 1e-8 * rng.normal(size=base.shape), turned + 1e-9 * rng.normal(size=base.shape)]))
    values = np.sort((x @ x.T).ravel())
    for cosine in values[values < 0.999][::501]:
        ca, _, _ = covertree.linked(covertree.Tree.build(x), covertree.Tree.build(x), cosine + 1e-13)
        assert ca.tolist() == (x @ x.T >= cosine + 1e-13).sum(1).tolist()


def test_packing_keeps_every_piece_and_empties_bins():
    dice = random.Random(2)
    sizes = [dice.randint(1, 4096) for _ in range(300)] + [4096, 4096]
    bins = packing.packed(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 4096 for b in bins)
    assert len(packing.search([[0], [1], [2, 3]], [6, 4, 5, 5], 10)) == 2
    # Only after an exchange does a bin empty.
    assert len(packing.search([[0, 1], [2], [3]], [6, 3, 7, 4], 10)) == 2


def test_exchanges_take_any_piece_of_a_long_bin():
    # Bin 0 holds 30 small pieces; only two beyond its 24th together make room's worth for one of bin 1.
    sizes = [10] * 28 + [31, 32] + [60, 937]
    bins, fill = [list(range(30)), [30, 31]], [343, 997]
    assert packing._step(0, bins, fill, sizes, 1000, [0, 1]) and fill == [340, 1000]
    assert sorted(bins[1]) == [28, 29, 31] and 30 in bins[0]
    # One for two: the only pair of bin 1 that lets the piece in and gains has both pieces beyond its 24 smallest.
    sizes = [83] + [1] * 26 + [40, 41, 850]
    bins, fill = [[0], list(range(1, 30))], [83, sum(sizes[1:])]
    assert packing._step(0, bins, fill, sizes, fill[1] + 2, [0, 1]) and fill[0] == 81 and sorted(bins[0]) == [27, 28]


def test_best_pairs_equal_all_pairs():
    dice = random.Random(6)
    for _ in range(2000):
        lengths = sorted(dice.randint(1, 30) for _ in range(dice.randint(0, 8)))
        bound = dice.randint(0, 60)
        sums = [lengths[i] + lengths[k] for i in range(len(lengths)) for k in range(i)]
        for found, want in ((packing._largest(lengths, bound), max((s for s in sums if s <= bound), default=None)), (packing._smallest(lengths, bound), min((s for s in sums if s >= bound), default=None))):
            assert (found and lengths[found[0]] + lengths[found[1]]) == want


def test_encoder_equals_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    own, theirs = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["It's a test's 'll I'LL don't", "½²³ 12 a1b2", "ÀÉÎõü ßẞ İi̇", "<|endoftext|> x", "é café", "tab\tnew\nline\x0bz", "ſŉ ĳ Ŀ·", "", "日本語 text", "\x1cq", "a­b", "''s'''t", "ΑΣ", "na\u0301ïve—dash"]
    for text in texts * 2:
        assert own.encode(text) == np.asarray(theirs.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_field_marginals_equal_enumeration():
    field = toxicity.Field(np.array([5], np.uint64), np.array([2.0]), -1.5, np.array([[0.3, -0.2], [-0.4, 0.9]]))
    n, at, weight = 7, np.array([1, 2, 5]), np.array([2.0, 0.5, 3.0])
    emission = np.zeros((n, 2))
    emission[:, 1] = -1.5
    emission[at, 1] += weight
    total, mass = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> k & 1 for k in range(n)]
        p = np.exp(sum(emission[k, y[k]] for k in range(n)) + sum(field.transitions[y[k], y[k + 1]] for k in range(n - 1)))
        total += p
        mass += p * np.array(y)
    assert np.allclose(field.marginals(at, weight, n), (mass / total)[at], atol=1e-9)


def test_field_learns_words_and_prefixes():
    dice = random.Random(4)
    usual = ["".join(dice.choice("abcdefg") for _ in range(5)) for _ in range(60)]
    text = lambda bad: " ".join(dice.choice(usual) for _ in range(40)) + bad
    rows = [(text(f" zzqx{dice.choice(usual)} "), 1) if i % 3 == 0 else (text(""), 0) for i in range(240)]
    field = toxicity.fit(rows)
    data, offsets = arrays([text(" zzqxnew"), text(""), ""])
    score, spans = toxicity.tagged(field, data, offsets)
    assert score[0] > 0.5 > toxicity.THRESHOLD > score[1] and score[2] < 0.3
    assert len(spans[0]) == 1 and data[spans[0][0, 0] : spans[0][0, 1]].tobytes() == b"zzqxnew"
    assert toxicity.fit([]).background < 0.1


def test_voters_tell_shapes_apart():
    good = [(f"The plain words number {i} go on and on here.", 1) for i in range(40)]
    bad = [(f"BUY!!! NOW### {i} $$$ %%% &&&", 0) for i in range(40)]
    voters = quality.fit(good + bad)
    score = voters.votes(quality.descriptions(*arrays(["Some other plain words go here.", "WIN!!! $$$ ### %%% NOW", ""])))
    assert score[0] > 0.7 > 0.3 > score[1] and score[2] == 0.5
    assert quality.fit([]).votes(quality.descriptions(*arrays(["x"]))).tolist() == [0.5]


def test_votes_equal_plain_neighbours():
    dice = random.Random(21)
    text = lambda: " ".join("".join(dice.choice("abcd!#") for _ in range(dice.randint(1, 4))) for _ in range(12))
    rows = [(text(), dice.randint(0, 1)) for _ in range(60)]
    rows += [(t, 1 - y) for t, y in rows[:40]]  # equal vectors with other labels
    voters = quality.fit(rows)
    asked = [text() for _ in range(30)] + [t for t, _ in rows[:20]]
    found = quality.descriptions(*arrays(asked))
    latent = voters.project(found)
    for k, score in enumerate(voters.votes(found)):
        near = latent[k : k + 1] @ voters.vectors.T
        order = sorted(range(len(rows)), key=lambda i: (-near[0, i], i))[: quality.NEIGHBOURS]
        weight = [max(float(near[0, i]), 0.0) for i in order]
        assert abs(score - sum(w * rows[i][1] for w, i in zip(weight, order)) / sum(weight)) < 1e-6


def test_tied_neighbours_are_the_first_ones():
    rng = np.random.default_rng(3)
    for _ in range(50):
        vectors = np.eye(4, dtype=np.float32)[rng.integers(0, 4, 40)]
        labels = rng.integers(0, 2, 40).astype(float)
        voters = quality.Voters(np.zeros(4, np.float32), np.eye(4, dtype=np.float32), vectors, labels)
        (score,) = voters.votes(np.array([[1, 0, 0, 0]], np.float32))
        own = np.flatnonzero(vectors[:, 0])[: quality.NEIGHBOURS]
        assert abs(score - labels[own].mean()) < 1e-9


def test_warc_monolith_is_rewritten_record_by_record(tmp_path):
    payloads = [b"", b"x" * 200_000, "é\r\n\r\nWARC/1.0".encode()]
    whole = b"".join(warc.page_record(i, "http://h/\n", p, None) for i, p in enumerate(payloads))
    raw = tmp_path / "raw" / "a.warc.gz"
    raw.parent.mkdir()
    member = zlib.compressobj(wbits=31)
    raw.write_bytes(member.compress(whole) + member.flush())
    new, count = warc._normalised(f"file://{raw}")
    assert count == 3
    content = (tmp_path / "members" / "a.warc.gz").read_bytes()
    for (name, kind, at, length), p in zip(warc.index_of(new), payloads):
        block = zlib.decompress(content[at : at + length], 31)
        assert kind == "response" and block.startswith(b"WARC/1.0\r\n") and block.endswith(p + b"\r\n\r\n") and b"%0A" in block
    raw.write_bytes(raw.read_bytes()[:-30])
    with pytest.raises(EOFError):
        warc._normalised(f"file://{raw}")
