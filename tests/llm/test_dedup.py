import random

import numpy as np
import pytest

from terrane.llm import chunk_dedup, embedding_forest, near_dup

from . import data


def shingle_sets(rows, width):
    out = {}
    for d, t in rows:
        w = t.encode().lower().split() if t else []
        s = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        out.setdefault(d, []).append(s)
    return out


def brute(rows, width, percent):
    sets = shingle_sets([r for r in rows if r[0] is not None], width)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edits(n, seed):
    """Groups of near copies around the threshold, exact copies, and short texts."""
    r, out = random.Random(seed), []
    for g in range(12):
        base = data.prose(r.choice([3, 8, 30, 120]), 1000 + g).split()
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(data.VOCAB)
            out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(edits(25, 3))]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r for r in near_dup.near_duplicates(df, width, percent).collect()}
        want = brute(rows, width, percent)
        assert {d: r.component_id for d, r in got.items()} == want
        assert all(r.kept == (d == r.component_id) for d, r in got.items())
        sizes = {d: len(s[0]) for d, s in shingle_sets(rows, width).items()}
        assert {d: r.n_shingles for d, r in got.items()} == sizes


def test_near_duplicates_on_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in data.rows()]
    out = near_dup.near_duplicates(data.docs(spark)).collect()
    assert len(out) == len(rows)
    want = brute(rows, 3, 85)
    assert all((r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True)) for r in out)
    assert near_dup.near_duplicates(data.empty(spark)).count() == 0
    one = near_dup.without_duplicates(data.docs(spark))
    assert one.columns == data.docs(spark).columns
    kept = [r.doc_id for r in one.collect()]
    assert sorted(d for d in kept if d is not None) == sorted({d for d, c in brute(rows, 5, 80).items() if d == c}) and kept.count(None) == 2


def test_one_hash_fills_a_register():
    s = near_dup.Signer(3, 5, 24)
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 500, np.uint64))
    regs = s.registers(values)
    for b in range(s.k):
        own = [int(v) for v in values if int(v) * s.k >> 64 == b]
        if not own:
            assert regs[b] == 0
            continue
        rest = (min(own) * s.k) % 2**64 / 2**64
        zeros = int(-np.floor(np.log2(rest))) - 1
        assert regs[b] - 1 == (zeros << 10) + int((rest * 2 ** (zeros + 1) - 1) * 1024)
    few = s.registers(values[:3])
    dense = s.densified(few)
    assert (few > 0).sum() <= 3 and (dense > 0).all() and set(dense) == set(few) - {0}


def test_estimate_is_corrected_for_chance():
    s = near_dup.Signer(3, 5, 40)
    r = np.random.default_rng(3)
    got = []
    for _ in range(30):
        v = r.integers(0, 2**64, 600, np.uint64)
        got.append(near_dup.estimate(s.registers(np.sort(v[:400])), s.registers(np.sort(v[200:])), 400, 400)[0])
    assert abs(np.mean(got) - 1 / 3) < 0.03
    assert 0 < near_dup.chance(400, 400, 200) < 2**-9


def test_registers_agree_as_often_as_sets_do_at_any_size():
    s, r = near_dup.Signer(3, 5, 24), np.random.default_rng(9)
    for n, common in ((2, 1), (7, 6), (20, 17), (300, 255)):
        agree = []
        for _ in range(400):
            v = r.integers(0, 2**64, 2 * n - common, np.uint64)
            a, b = (s.densified(s.registers(np.sort(x))) for x in (v[:n], v[n - common :]))
            agree.append((a == b).mean())
        assert abs(np.mean(agree) - common / (2 * n - common)) < 0.04


def test_repeated_ids_join_their_texts(spark):
    a, b, c = data.prose(40, 1), data.prose(40, 2), data.prose(40, 3)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, None), (5, c + " x"), (6, None), (6, ""), (7, data.prose(9, 4)), (7, data.prose(9, 5)), (7, data.prose(9, 5))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS digest", "3 AS __id", "4 AS text_key")
    got = near_dup.near_duplicates(df).collect()
    want = brute(rows, 3, 85)
    assert want[3] == 1 and want[5] == 4
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, want[d]) for d, _ in rows)
    stay = near_dup.without_duplicates(df)
    assert stay.columns == df.columns
    texts = sorted((r.doc_id, r.text or "") for r in stay.collect())
    assert texts == sorted([(1, a), (4, c), (4, ""), (6, ""), (7, rows[9][1]), (7, rows[10][1])])


def test_large_ids_of_near_copies_stay_whole(spark):
    text = data.prose(30, 3)
    df = spark.createDataFrame([(2**60 + 1, text), (None, text), (2**60 + 3, "x " + data.prose(40, 9)), (2**60 + 2, text)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {2**60 + 1: 2**60 + 1, None: None, 2**60 + 3: 2**60 + 3, 2**60 + 2: 2**60 + 1}


def test_repeated_passages(spark):
    p = data.prose(60, 77)
    docs = [(1, data.prose(90, 1) + " " + p + " " + data.prose(40, 2)), (2, data.prose(300, 3)), (5, "x" + data.prose(33, 4) + " " + p + "\n" + data.prose(80, 5)), (6, data.prose(100, 6)), (7, data.prose(100, 6)), (8, "z" * 5000)]
    rows = docs + [(None, docs[0][1]), (9, None), (10, ""), (1, docs[0][1])]
    out = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS start", "3 AS row")).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in out}
    assert pairs == {(5, 1), (7, 6)}
    span = next(r for r in out if r.doc_id == 5)
    part = docs[2][1].encode()[span.start_byte : span.end_byte].decode()
    assert part in docs[0][1] and 40 <= span.n_words <= 61
    whole = next(r for r in out if r.doc_id == 7)
    assert whole.start_byte == 0 and len(docs[4][1]) - 40 <= whole.end_byte <= len(docs[4][1]) and whole.n_words >= 95
    assert chunk_dedup.repeated_passages(data.empty(spark)).count() == 0
    assert chunk_dedup.repeated_passages(data.docs(spark)).count() > 0


def test_passages_of_repeated_rows(spark):
    p, q = data.prose(60, 77), data.prose(60, 78)
    first = (1, data.prose(90, 1) + " " + p + " " + data.prose(40, 2) + " " + q)
    a, b = (5, data.prose(33, 4) + " " + p + " " + data.prose(80, 5)), (5, data.prose(20, 6) + " " + q)
    spans = lambda rows: sorted(chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "first_doc_id", "start_byte", "end_byte", "n_blocks", "n_words").collect())
    one, other = spans([first, a]), spans([first, b])
    assert one and other and all(s.n_words >= 40 for s in one + other)
    assert spans([first, a, a, first]) == one
    assert spans([first, a, b, a]) == sorted(one + other)


def covered(rows, gram):
    """Words of each document that lie in ``gram`` words which a document of a smaller id has in a row."""
    first, out = {}, {}
    for d, t in sorted(rows):
        w = t.split()
        for i in range(len(w) - gram + 1):
            first.setdefault(tuple(w[i : i + gram]), d)
    for d, t in rows:
        w = t.split()
        out[d] = {k for i in range(len(w) - gram + 1) if first[tuple(w[i : i + gram])] < d for k in range(i, i + gram)}
    return out


def test_passages_survive_common_phrases(spark):
    """Against brute force: 60-word passages of two documents each, whose phrases earlier documents hold."""
    import bisect

    for phrase, every in ((8, 14), (10, 12), (12, 14), (0, 1)):
        r = random.Random(phrase)
        passages = [" ".join("".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8))) for _ in range(60)) for _ in range(60)]
        rows, n = [], 0
        for p in passages if phrase else []:
            w = p.split()
            for i in range(0, 60 - phrase, every):
                rows.append((n, data.prose(r.randint(5, 20), n) + " " + " ".join(w[i : i + phrase]) + " " + data.prose(10, n + 1)))
                n += 1
        for side in (0, 1):
            for k, p in enumerate(passages):
                rows.append((10000 + 1000 * side + k, data.prose(r.randint(10, 60), 5000 * side + k) + " " + p + " " + data.prose(30, 9000 * side + k)))
        out = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        found = {x.doc_id for x in out if x.doc_id >= 11000}
        assert len(found) >= 0.95 * len(passages)
        texts, known = dict(rows), covered(rows, 12)
        for x in out:
            raw = texts[x.doc_id].encode()
            starts = [i for i in range(len(raw)) if raw[i : i + 1].strip() and (i == 0 or not raw[i - 1 : i].strip())]
            inside = range(bisect.bisect_left(starts, x.start_byte), bisect.bisect_left(starts, x.end_byte) - 1)
            assert set(inside) <= known[x.doc_id]


def test_periodic_passages_are_found(spark):
    rows = [(1, data.prose(20, 1) + " and" * 300 + " " + data.prose(20, 2)), (2, data.prose(33, 3) + " and" * 200 + " " + data.prose(9, 4))]
    [x] = chunk_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert x.doc_id == 2 and x.n_words > 150


def test_cutting_passages_out(spark):
    p, a = data.prose(60, 77), data.prose(30, 4)
    df = spark.createDataFrame([(1, p), (2, a + " " + p + " " + a), (3, "ö" * 9), (4, None)], "doc_id long, text string").selectExpr("text", "1 AS spans", "doc_id", "2 AS id", "3 AS row")
    out = chunk_dedup.without_passages(df, chunk_dedup.repeated_passages(df))
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[1] == p and left[3] == "ö" * 9 and left[4] is None
    assert left[2].startswith(a[:100]) and left[2].endswith(a[-100:]) and len(left[2]) < len(a) * 2 + 150


def test_cuts_depend_on_what_is_near():
    g = chunk_dedup.Gear()
    tail = np.frombuffer(data.prose(300, 9).encode(), np.uint8)
    a = set(g.cuts(np.concatenate([np.frombuffer(b"some words before", np.uint8), tail])) - 17)
    b = set(g.cuts(np.concatenate([np.frombuffer(b"other", np.uint8), tail])) - 5)
    assert {x for x in a if x > 48} == {x for x in b if x > 48}


@pytest.mark.parametrize("sample", [900, 40])  # 40: leaves are split by their own vectors
def test_vectors_equal_brute_force(spark, sample):
    r = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1):
        base = r.standard_normal((220, 16))
        near = np.repeat(base[:20], 9, 0) + 0.07 * r.standard_normal((180, 16))
        hot = base[30] + 0.03 * r.standard_normal((150, 16))
        for v in np.concatenate([base, near, hot, base[40:50]]):
            rows.append((n, [float(x) for x in v.astype(np.float32)], label))
            n += 1
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[3][1], None), (None, rows[3][1], 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [float("inf")] * 16, 1), (n + 8, [2 * x for x in rows[3][1]], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS weight", "2 AS digest")
    got = {x.vec_id: x for x in embedding_forest.near_vectors(df, 0.98, leaf=64, sample=sample).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in [*rows, odd[9]]]
    links = {i: set() for i, _, _ in ok}
    for i, v, y in ok:
        for j, w, z in ok:
            if i != j and y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    low = {}
    for i in sorted(links):
        if i in low:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in low:
                low[x] = i
                todo += links[x]
    for i in links:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), low[i], low[i] == i)
    assert all((got[x[0]].n_links, got[x[0]].kept) == (0, True) for x in odd[:9])
    assert embedding_forest.near_vectors(df.limit(0)).count() == 0


def leaves_of(x, leaf, cosine=0.98):
    """The leaves of one tree over all vectors, subtrees included, as in near_vectors."""
    spill = embedding_forest.spill_of(cosine, x.shape[1])
    todo, out = [(np.arange(len(x)), 5)], []
    while todo:
        rows, name = todo.pop()
        drawn = rows[np.random.default_rng(len(rows)).permutation(len(rows))[: embedding_forest.FIT]]
        cuts = embedding_forest.fit(x[drawn], len(rows), spill, leaf, name) if len(rows) > 2 * leaf else {}
        if not cuts:
            out.append(rows)
            continue
        parts = {}
        for r, to in zip(rows.tolist(), embedding_forest.route(x[rows], cuts, spill, name)):
            for n in to:
                parts.setdefault(n, []).append(r)
        todo += [(np.array(p), embedding_forest.named(name, n)) for n, p in parts.items()]
    return out


def test_leaves_stay_small_and_links_meet():
    """Leaves do not grow with the table, and pairs at the threshold meet in one of the trees."""
    r = np.random.default_rng(3)
    for n in (2_000, 20_000, 120_000):
        x = r.standard_normal((n, 64))
        step = r.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        step -= (step * x).sum(1, keepdims=True) * x
        step /= np.linalg.norm(step, axis=1, keepdims=True)
        x[1::2] = 0.98 * x[::2] + np.sqrt(1 - 0.98**2) * step[::2]
        leaves = leaves_of(x, 256)
        assert max(map(len, leaves)) <= 512 and sum(len(p) for p in leaves) < 4 * n
        home = [set() for _ in range(n)]
        for k, p in enumerate(leaves):
            for i in p.tolist():
                home[i].add(k)
        met = np.mean([bool(home[i] & home[i + 1]) for i in range(0, n, 2)])
        assert 1 - (1 - met) ** 3 > 0.998


def test_repeated_vector_ids_are_one_node(spark):
    r = np.random.default_rng(1)
    a, b, c, d = ([float(x) for x in r.standard_normal(8)] for _ in range(4))
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (3, b, 0), (4, c, 0), (5, d, 0), (5, d, 0), (6, None, 0), (6, c, 0), (2**60 + 1, d, 1), (None, d, 0)]
    got = sorted(map(tuple, embedding_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)).where("vec_id IS NOT NULL").collect()))
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 4, False), (6, 1, 4, False), (2**60 + 1, 0, 2**60 + 1, True)])
