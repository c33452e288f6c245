import random
import zlib

import numpy as np
import pytest

from terrane.llm import mixing, packing, registry, token_counts

from . import data

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))


def test_counts_equal_the_library(spark, word_tokenizer):
    got = token_counts.count_tokens(data.docs(spark), registry.tokenizer("word_bpe_49k.json"), 100).collect()
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n, n > 100) for r in data.rows() for n in [len(word_tokenizer.encode(r[1] or "", add_special_tokens=False).ids)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(data.empty(spark), registry.tokenizer("word_bpe_49k.json")).count() == 0


def test_random_strings_count_as_in_the_library(word_tokenizer):
    classes = np.frombuffer(zlib.decompress(token_counts.packed_classes()), np.uint8)
    counter = token_counts.Counter(registry.tokenizer("word_bpe_49k.json"), classes)
    r = random.Random(11)
    parts = ["'s", "'re", "'r", "'ll", "'l", "''", "a", "é", "ß", "word", "1", "!", "  ", "\n", "中文", " ", "é", "İ", "'VE", "🙂", "\x00", "ing", "ſ", "\x85", "ⅷ"]
    many = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["ab" * 4000, "".join(r.choice("abcdefgh") for _ in range(9000))]
    want = [len(e.ids) for e in word_tokenizer.encode_batch(many, add_special_tokens=False)]
    assert counter.counts(many).tolist() == want


def test_chunk_maps_compose_to_the_count(word_tokenizer):
    counter = token_counts.Counter(registry.tokenizer("word_bpe_49k.json"), np.frombuffer(zlib.decompress(token_counts.packed_classes()), np.uint8))
    r = random.Random(2)
    parts = ["".join(r.choice(["'s", "'r", "e", "l", "'l", "'", "x", "9", "!", "ing"] + [" "] * k) for _ in range(n)) + "\n" for n, k in ((3000, 1), (400, 0), (900, 3), (0, 1), (1, 1), (7000, 2))]
    want = [len(e.ids) for e in word_tokenizer.encode_batch(parts, add_special_tokens=False)]
    for width in (1, 2, 3, 7, 64, 10000):
        assert counter.scanned(parts, width).tolist() == want


def test_cuts_are_those_of_the_pattern():
    import regex

    machine = token_counts.SplitMachine(np.frombuffer(zlib.decompress(token_counts.packed_classes()), np.uint8))
    r = random.Random(3)
    for _ in range(300):
        run = "".join(r.choice(["'s", "'r", "e", "l", "'l", "x", "9", "!", "'"]) for _ in range(r.randint(1, 30)))
        assert machine.cut(run) == [m.start() for m in regex.finditer(token_counts.PATTERN, run)]


@pytest.mark.parametrize("big", [2**60 + 1, 2**62 - 5])
def test_large_ids_beside_a_null_stay_whole(spark, big):
    text = data.prose(30, 3)
    df = spark.createDataFrame([(big, text), (None, text), (big + 2, "x " + text), (3, None)], "doc_id long, text string").coalesce(1)
    ids = [big, big + 2, 3, None]
    key = lambda d: (d is None, d or 0)
    got = token_counts.count_tokens(df, registry.tokenizer("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id for r in got), key=key) == sorted(ids, key=key)
    got = packing.pack(df, registry.tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id for r in got), key=key) == sorted(ids, key=key)


def test_packing_round_trip(spark, byte_tokenizer):
    df = data.docs(spark)
    out = packing.pack(df, registry.tokenizer("byte_bpe_50k.json"), 256, 2, keep_ids=True).collect()
    want = sorted((-1 if d is None else d, [*byte_tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in ((r[0], r[1]) for r in data.rows()))
    bins = {}
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 256
    # ids with one row each: the pieces give the document back
    single = {d for d, _ in want if [x for x, _ in want].count(d) == 1}
    for d, ids in want:
        if d in single and d >= 0:
            pieces = sorted((r.piece, r.start, r.length, bytes(r.ids)) for r in out if r.doc_id == d)
            assert b"".join(p[3] for p in pieces) == np.array(ids, "<u4").tobytes()
            assert all(p[2] == 256 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 256)
    assert sum(r.length for r in out) == sum(len(ids) for _, ids in want)
    assert packing.pack(data.empty(spark), registry.tokenizer("byte_bpe_50k.json")).count() == 0


def best_fit_decreasing(counts, capacity):
    free, n = np.zeros(capacity + 1, int), 0
    for length in range(capacity, 0, -1):
        for _ in range(counts[length]):
            fits = np.flatnonzero(free[length:])
            if len(fits):
                free[fits[0] + length] -= 1
                free[fits[0]] += 1
            else:
                n += 1
                free[capacity - length] += 1
    return n


def test_plans_are_whole_and_near_the_bound():
    r = np.random.default_rng(1)
    for n in (3, 200, 3000):
        counts = np.bincount(np.clip(r.exponential(300, n).astype(int) + 1, 1, 1024), minlength=1025)
        plan = packing.plan_sequences(counts, 1024)
        held = np.zeros(1025, int)
        for lengths, k in plan:
            assert sum(lengths) <= 1024
            for x in lengths:
                held[x] += k
        assert (held == counts).all()
        assert sum(k for _, k in plan) <= best_fit_decreasing(counts, 1024) * 1.01 + 1


def filled_alone(counts):
    return sum(n for _, n in packing.rounded([], counts, 1024)[0])


@pytest.mark.parametrize("draw", [lambda r: r.exponential(300, 20000), lambda r: r.lognormal(5.2, 0.9, 20000), lambda r: r.integers(1, 700, 20000)])
def test_sequences_come_from_the_program(draw):
    counts = np.bincount(np.clip(draw(np.random.default_rng(4)).astype(int) + 1, 1, 1023), minlength=1025)
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    lp = packing.configuration_lp(counts, 1024)
    cover = np.zeros(1025)
    for config, amount in lp:
        assert sum(k * n for k, n in config.items()) <= 1024
        for k, n in config.items():
            cover[k] += n * amount
    assert np.allclose(cover, counts, rtol=1e-6)
    assert sum(a for _, a in lp) <= least * 1.001
    plan, whole = packing.rounded(lp, counts, 1024)
    total = sum(n for _, n in plan)
    assert whole > 0.8 * total and total <= min(filled_alone(counts), least * 1.001 + 1)


def test_prices_learn_where_volume_does_not_decide():
    r = np.random.default_rng(5)
    for lengths in (r.integers(1, 1000, 20000), np.where(r.random(20000) < 0.4, r.integers(560, 720, 20000), r.integers(180, 400, 20000))):
        counts = np.bincount(lengths, minlength=1025)
        assert sum(n for _, n in packing.plan_sequences(counts, 1024)) <= filled_alone(counts)


def test_schedule_deviates_by_less_than_a_block():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{k}": 0.04 for k in range(19)} | {"big": 0.2}, {"a": 0.01}):
        shares = mixing.whole_shares(weights, 100)
        had = dict.fromkeys(shares, 0)
        for s, i, slot, release, deadline in mixing.schedule({k: n for k, n in shares.items() if n}):
            assert release <= slot < deadline and i == had[s]
            had[s] += 1
            assert all(abs(had[k] - n / 100 * (slot + 1)) < 1 for k, n in shares.items())


def test_mixing_keeps_rows_and_columns(spark):
    df = data.docs(spark).withColumnRenamed("rank", "mix_slot").selectExpr("*", "1 AS __cls", "2 AS __key", "3 AS __bucket", "4 AS cls", "5 AS row", "6 AS slot")
    out = mixing.mix(df, {"src0": 0.6, "src1": 0.3}, period=10, block=2)
    assert out.count() == df.count() and out.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "mix_slot"]
    got = out.collect()
    assert len({r.mix_position for r in got}) == len(got)
    seen = {}
    for r in sorted(got, key=lambda r: r.mix_position):
        name = r.source if r.source in ("src0", "src1") else "rest"
        assert seen.setdefault(name, 0) // 2 == r.mix_block
        seen[name] += 1
    whole = mixing.mix(df, {"src0": 0.5, "src1": 0.5}, period=10, block=2).collect()
    assert len(whole) == len(got)  # sources without a share come last, none is dropped
    assert mixing.mix(data.empty(spark), {"src0": 0.5}).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.0}, {"a": 0.7, "b": 0.4}, {"a": 0.0001}])
def test_bad_weights_are_refused(weights):
    with pytest.raises(ValueError):
        mixing.whole_shares(weights, 100)
