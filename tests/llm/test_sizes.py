"""Token counts, packing, mixing and splitting."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe.llm import mixing, packing, splitting, tokens

BUNDLE = "file_key string, paragraphs array<struct<paragraph_index int, text string, in_table boolean, marker_type string>>, extra int"


def test_token_parts():
    text = "word " * 90_000 + "x" * 10
    assert "".join(tokens.parts(text)) == text and len(list(tokens.parts(text))) > 2
    assert tokens.count(text) == len(tokens.encoder().encode_ordinary(text))
    assert tokens.count(None) == tokens.count("") == 0 and tokens.count("a" * 450_000) > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300))
def test_packer_never_overfills(sizes):
    packer, used = packing.Packer(100, "p"), {}
    for size in sizes:
        c = packer.put(size)
        used[c] = used.get(c, 0) + size
    assert not used or max(used.values()) <= 100


def test_packer_fills_well():
    rng = random.Random(4)
    sizes = sorted((min(2048, int(rng.lognormvariate(5.6, 0.8)) + 1) for _ in range(5000)), reverse=True)
    packer = packing.Packer(2048, "p")
    used = {}
    for size in sizes:
        c = packer.put(size)
        used[c] = used.get(c, 0) + size
    assert sum(sizes) / (2048 * len(used)) > 0.95


def test_pack(spark):
    rows = [(1, 10), (1, 10), (2, 0), (3, 2048), (4, 2049), (5, 6144), (6, 700), (7, 1300)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").coalesce(1)
    got = packing.pack_sizes(sizes, "doc_id", 2048).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert [(p.token_from, p.token_to) for p in sorted(pieces[5], key=lambda p: p.piece_no)] == [(0, 2048), (2048, 4096), (4096, 6144)]
    assert [len(pieces[i]) for i in (1, 2, 3, 4)] == [2, 1, 1, 2] and pieces[2][0].container is None
    full = {}
    for r in got:
        if r.container:
            full[r.container] = full.get(r.container, 0) + r.n_tokens
    assert max(full.values()) <= 2048 and sum(full.values()) == sum(n for _, n in rows)
    report = packing.fill_report(packing.pack_sizes(sizes, "doc_id", 2048), 2048).first()
    assert (report.n_containers, report.n_tokens) == (len(full), sum(full.values()))
    assert packing.pack_sizes(sizes.limit(0), "doc_id", 2048).collect() == []


def test_limit(spark):
    schema = "limit_name string, max_size int, overlap_paragraphs int, overlap_chars int"
    assert packing.limit(spark.createDataFrame([("a", 5, None, None)], schema), "a")["max_size"] == 5
    with pytest.raises(ValueError, match="positive"):
        packing.limit(spark.createDataFrame([("a", 0, None, None)], schema), "a")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    for key in (1, 99):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(out) == list(range(n))
    if n == 1000:
        assert list(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 1))) != list(mixing.permute(np.arange(n), np.full(n, n), np.full(n, 2)))


def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["pump", "valve", "tower", "riser"]) for _ in range(rng.randint(0, 300))), "big" if i % 3 else "small") for i in range(300)]
    docs += [(900, None, "big"), (901, "x " * 50, "unlisted"), (902, "x " * 50, None), (903, "pump " * 90, "tiny"), (904, "", "big")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mixing.plan(frame, targets, block_tokens=64, shard_blocks=8)
    report = {r.source: r for r in mixing.report(mix).collect()}
    total = sum(tokens.count(t) for _, t, s in docs if s in ("big", "small", "tiny"))
    assert sum(r.n_tokens for r in report.values()) == total == mix.total_tokens
    assert {s for s, r in report.items() if r.short} == {"none", "tiny"}
    assert report["none"].mixed_tokens == 0 and abs(sum(r.reached_share for r in report.values()) - 1) < 1e-4
    for s in ("big", "small"):
        assert abs(report[s].mixed_tokens / total - report[s].target_share) < 0.08
    spans = mixing.spans(mix).collect()
    covered = {}
    for r in spans:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.token_to - r.token_from
    assert covered == {i: tokens.count(t) for i, t, s in docs if s in ("big", "small", "tiny") and tokens.count(t)}
    blocks = {}
    for r in spans:
        blocks[r.source, r.block] = blocks.get((r.source, r.block), 0) + r.token_to - r.token_from
    assert max(blocks.values()) == 64 and all(n == 64 for (s, b), n in blocks.items() if b < report[s].n_blocks - 1)
    used = {}
    for r in mix.slots.where("block >= 0").collect():
        used[r.source, r.block] = used.get((r.source, r.block), 0) + 1
    assert all(n <= report[s].max_repeats for (s, _), n in used.items())
    mixed = mixing.mixed(mix)
    assert mixed.agg(F.sum(F.col("token_to") - F.col("token_from"))).first()[0] == sum(r.mixed_tokens for r in report.values())
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mixed(mixing.plan(frame, targets, block_tokens=64, shard_blocks=8)).collect()))
    empty = mixing.report(mixing.plan(frame.limit(0), targets)).collect()
    assert len(empty) == 4 and not any(r.short or r.mixed_tokens for r in empty)


SENTENCE = "Provide the pump with care. "


def bundle(spark, rows):
    return spark.createDataFrame([(k, None if ps is None else [(i, t, False, None) for i, t in ps], 1) for k, ps in rows], BUNDLE)


def cases():
    rng = random.Random(8)
    mixed = [(i * 3, SENTENCE * rng.randint(0, 20)) for i in range(80)]
    return [
        ("small", [(0, "a"), (1, None), (2, "")]), ("none", []), ("null", None), ("mixed", mixed), ("mixed", mixed[:40] + mixed[:3]), ("one", [(5, SENTENCE * 400)]), ("hex", [(0, "ab" * 4000)]), ("blank", [(0, "word" * 300 + " " + "wide " * 900)]),
        ("exact", [(0, "x" * 500), (1, "y" * 500)]), ("over", [(0, "x" * 500), (1, "y" * 501)]), ("wide", [(i, "z" * 900) for i in range(9)]),
    ]


@pytest.mark.parametrize("max_rows", [200_000, 10])
def test_pieces(spark, max_rows):
    rows = cases()
    df = bundle(spark, rows)
    texts = {}
    for key, ps in rows:
        texts.setdefault(key, {}).update({i: t or "" for i, t in ps or []})
    parts = splitting.slices(df, 1000, 2, 50, max_rows).collect()
    for key, by_index in texts.items():
        body = sorted((r.seg, r.seg_at, r.piece, r.pos, r.paragraph_index, r.char_from, r.char_to) for r in parts if r.file_key == key and not r.is_overlap)
        joined = {}
        for *_, i, a, b in body:
            joined[i] = joined.get(i, "") + by_index[i][a:b]
        assert joined == by_index  # every character once, in order
    pieces = {}
    for r in splitting.pieces(df, 1000, 2, 50, max_rows).collect():
        pieces.setdefault(r.file_key, []).append(r)
    for key, ps in pieces.items():
        ps.sort(key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and all(p.n_pieces == len(ps) for p in ps), key
        assert max(len(p.text) for p in ps) <= 1000 and all(p.n_chars <= len(p.text) for p in ps)
        assert all(p.n_overlap_chars > 0 or p.n_chars == 0 for p in ps[1:])
    total = {k: sum(map(len, t.values())) for k, t in texts.items()}
    found = {r.file_key for r in splitting.oversized(splitting.slices(df, 1000, 2, 50, max_rows), 1000).collect()}
    assert found == {k for k, n in total.items() if n > 1000}
    # Two paragraphs of 500 characters fit a piece of 1000, but not with the line break between them.
    assert "none" not in pieces and len(pieces["exact"]) == 2 and "exact" not in found


def test_cuts_do_not_depend_on_the_task_size(spark):
    rng = random.Random(11)
    rows = [(f"b{b}", [(i * 1 + i // 7, SENTENCE * rng.choice([0, 1, 2, 9, 60]) if rng.random() < 0.9 else "SECTION 01 10 00") for i in range(rng.randint(5, 60))]) for b in range(25)]
    df = bundle(spark, rows + [("hex", [(0, "ab" * 4000)])])
    cuts = [sorted(map(tuple, splitting.pieces(df, 1000, 2, 50, n).collect())) for n in (200_000, 10, 3)]
    assert cuts[0] == cuts[1] == cuts[2] and len(cuts[0]) > 200


def test_cuts_prefer_strong_boundaries():
    rows = [(i, 0, 100, 5 if i == 6 else 2, 100) for i in range(11)]
    assert splitting.Bisector(rows, 1000, 2, 50).pieces()[0] == (0, 6)
    assert splitting.overlap_of([100, 100, 100], 900, 2, 50) == (2, 0, 202)
    assert splitting.overlap_of([600, 100], 650, 2, 50) == (1, 0, 601)
    assert splitting.overlap_of([900], 500, 2, 50) == (0, 50, 51) and splitting.overlap_of([], 500, 2, 50) == (0, 0, 0)
    assert splitting.overlap_of([900], 500, 0, 50) == (0, 0, 0)


def test_overlap_takes_the_paragraphs_asked_for(spark):
    df = bundle(spark, [("k", [(i, "y" * 300) for i in range(6)])])
    whole = [r.n_overlap_chars for r in sorted(splitting.pieces(df, 1000, 2, 50).collect(), key=lambda r: r.piece_no)]
    assert whole[0] == 0 and set(whole[1:]) == {600}


def test_atoms_add_up():
    for text in (SENTENCE * 300, "ab" * 3000, "one two " * 900, "x\n\ny. z" * 500):
        got = splitting.atoms(text, 750)
        assert sum(n for n, _ in got) == len(text) and max(n for n, _ in got) <= 750


def test_empty_and_odd_bundles(spark):
    df = bundle(spark, [])
    assert splitting.slices(df, 100, 2, 10).collect() == [] == splitting.pieces(df, 100, 2, 10).collect()
    odd = bundle(spark, [("k", [(2, None), (1, ""), (None, "x" * 500)]), (None, [(0, "y" * 500)]), ("t", [(0, "z" * 300)])])
    odd = odd.withColumn("paragraph_index", F.lit("clash")).withColumn("text", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("seg", F.lit(1))
    got = {(r.file_key, r.piece_no): (r.first_index, r.last_index, r.n_chars, r.text) for r in splitting.pieces(odd, 100, 2, 10).collect()}
    assert got["k", 1] == (1, 2, 0, "\n")
    whole = [got["t", i] for i in range(1, len(got))]
    assert len(whole) > 3 and all(n <= 100 and text == "z" * n for _, _, n, text in whole)


def test_pack_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "pump"), (4, "pump " * 30_000), (5, "pump"), (5, "pump")], "doc_id bigint, text string")
    docs = docs.withColumn("n_tokens", F.lit("clash")).withColumn("container", F.lit("clash"))
    rows = packing.pack(docs, 2048).collect()
    assert sum(r.n_tokens for r in rows) == sum(tokens.count(t) for t in ("pump", "pump " * 30_000, "pump", "pump"))
    assert {r.doc_id for r in rows if r.container is None} == {1, 2} and sum(r.doc_id == 5 for r in rows) == 2
    big = [r for r in rows if r.doc_id == 4]
    assert len(big) == big[0].n_pieces > 10 and max(r.n_tokens for r in rows) <= 2048
