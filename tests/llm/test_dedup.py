import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudweave.llm import jaccard, passages, sorting, substrings
from tests.llm import brute


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_sorting_finds_equal_windows():
    rng = np.random.default_rng(1)
    for trial in range(60):
        length = int(rng.choice([9, 16, 41, 200]))
        buf = np.concatenate([rng.integers(0, 2, 300 + length).astype(np.uint8), np.zeros(16, np.uint8)])
        if trial % 3 == 0:
            buf[80 : 80 + length + 40] = buf[: length + 40]
        if trial % 5 == 0:
            buf[:] = 7
        at, group = np.arange(300), np.sort(rng.integers(0, 2, 300))
        again, first = sorting.repeated_windows(buf, at, group, length)
        keys = [(int(g), buf[a : a + length].tobytes()) for a, g in zip(at, group)]
        assert again.tolist() == [keys.count(k) > 1 for k in keys]
        assert first.sum() == len({k for k in keys if keys.count(k) > 1})


def test_suffix_array_dedup_equals_brute_force(documents, odd):
    for df in (documents, odd):
        rows = rows_of(df)
        want = sorted(zip([str(d) for d, _ in rows], brute.repeated_bytes([t for _, t in rows], 200)))
        got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.dedup(df).collect())
        assert got == want


def test_blocks_of_a_key_meet(documents, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 2)
    rows = rows_of(documents)
    want = sorted(zip([d for d, _ in rows], brute.repeated_bytes([t for _, t in rows], 200)))
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.dedup(documents).collect()) == want


def test_pieces_and_passes_change_nothing(documents):
    """Long texts read in pieces, also behind empty ones, and windows sorted in passes."""
    rows = [(-2, ""), (-1, None)] + rows_of(documents)
    df = documents.sparkSession.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(zip([d for d, _ in rows], brute.repeated_bytes([t for _, t in rows], 200)))
    got = substrings.dedup(df, piece=700, most=500).collect()
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want


def test_cut_documents_keeps_columns(odd):
    got = substrings.cut_documents(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.where("text is null").count() == 1


def test_empty_tables(empty):
    assert substrings.dedup(empty).count() == substrings.cut_documents(empty).count() == 0
    assert jaccard.join(empty).count() == passages.near_passages(empty).count() == 0


def test_jaccard_join_equals_brute_force(documents, odd):
    for df in (documents, odd):
        rows = rows_of(df)
        want = brute.components(rows)
        got = jaccard.join(df).collect()
        assert len(got) == len(rows)
        assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
        assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(d), len(brute.shingles(t))) for d, t in rows)


@pytest.mark.parametrize("limits", [{}, {"few": 1, "limit": 3}])
def test_jaccard_group_of_near_copies(spark, limits):
    """Many near copies of one text, each with its own word changed, and chains whose ends are unlike.

    All lists long and dealt into small cells, or all of them short, give the same.
    """
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{rng.randrange(5000)}" for _ in range(120)]
    for i in range(30):
        chain[4 * i % 120] = f"m{i}"
        rows.append((1000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components(rows)
    assert {r.doc_id: r.component_id for r in jaccard.join(df, **limits).collect()} == want


def test_pairs_of_a_list_meet_once(spark):
    """Each pair of different components of a list comes once, whatever the cells; its filters lose no linked pair."""
    rng = np.random.default_rng(9)
    n = 40
    rows = [(7, i, 100 << 32 | i % 5, int(rng.integers(0, 4)) if i % 3 else 0, bytes(64)) for i in range(n)]
    df = spark.createDataFrame(rows, "token long, id long, size long, component long, bits binary")
    want = sorted((i, j) for i in range(n) for j in range(i + 1, n) if rows[i][3] != rows[j][3])
    for limit in (3, 512):
        assert sorted((r.a, r.b) for r in jaccard.long_pairs(df, limit).collect()) == want
    assert sorted((r.a, r.b) for r in jaccard.short_pairs(df, n + 1).collect()) == want


def test_rows_of_a_pair_are_added_up(spark):
    """A pair that shares many lists has a row for each task at most; unlike sets of 400 do not come at all."""
    rows = [(t, i, 100 << 32 | t, i, bytes(256)) for t in range(50) for i in range(3)]
    got = jaccard.long_pairs(spark.createDataFrame(rows, "token long, id long, size long, component long, bits binary").coalesce(1)).collect()
    assert len(got) <= 3 * int(spark.conf.get("spark.sql.shuffle.partitions")) < 150
    assert {(a, b): sum(r.c for r in got if (r.a, r.b) == (a, b)) for a, b in ((0, 1), (0, 2), (1, 2))} == {(0, 1): 50, (0, 2): 50, (1, 2): 50}
    flat = np.random.default_rng(8).integers(0, 1 << 63, 470).astype(np.uint64)
    bits = jaccard.parities(np.concatenate([flat[:400], flat[70:]]), np.repeat([0, 1], 400), 2)
    assert 800 < 7 * jaccard.differ(bits[:1], bits[1:])[0] <= 7 * 140


def test_bounds_of_linked_sets():
    """What the filters ask for holds for sets that just link, in any order of their shingles."""
    rng = np.random.default_rng(10)
    for n in (1, 2, 5, 20, 90, 300):
        for _ in range(20):
            a = rng.choice(10**9, n, replace=False)
            b = np.concatenate([a[: -(-6 * n // 7)], rng.choice(np.arange(10**9, 2 * 10**9), n // 7)])
            a, b = (np.unique(x.astype(np.uint64)) for x in (a, b))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            bits = jaccard.parities(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
            assert jaccard.differ(bits[:1], bits[1:])[0] <= len(a) + len(b) - 2 * both
            rank = {x: k for k, x in enumerate(rng.permutation(np.union1d(a, b)).tolist())}
            p, q = (sorted(x.tolist(), key=rank.get)[: len(x) - -(-3 * len(x) // 4) + 1] for x in (a, b))
            shared = [x for x in p if x in q]
            sizes = np.array([len(a)]), np.array([len(b)])
            assert len(shared) >= jaccard.least_count(*sizes)[0]
            assert max(jaccard.room(sizes[0], np.array([p.index(x)]), sizes[1], np.array([q.index(x)]))[0] for x in shared) >= 0


def test_suffix_filter_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for n in (3, 40, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)]))
        assert jaccard.least_difference(jaccard.slices(a), jaccard.slices(b)) <= len(np.setxor1d(a, b))


def test_one_document_of_each_group_stays(odd):
    kept = jaccard.distinct_documents(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 12 not in ids and 7 in ids and 8 not in ids and None in ids and 4 in ids


def test_compact_windows_equal_their_definition():
    rng = np.random.default_rng(5)
    for _ in range(40):
        h = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        least = int(rng.integers(2, 12))
        left, c, right = passages.compact_windows(h, least)
        place = np.uint64(6)
        v = (h >> place << place) | np.arange(60, dtype=np.uint64)
        want = []
        for k in range(60):
            a = max([j + 1 for j in range(k) if v[j] < v[k]], default=0)
            b = min([j - 1 for j in range(k + 1, 60) if v[j] < v[k]], default=59)
            if b - a + 1 >= least:
                want.append((a, k, b))
        assert list(zip(left.tolist(), c.tolist(), right.tolist())) == want
        firsts = np.array([0, 0, 7, 7, 30, 60])
        parts = [np.stack(passages.compact_windows(h[i:j], least)) + i for i, j in zip(firsts[:-1], firsts[1:])]
        assert np.array_equal(np.stack(passages.compact_windows(h, least, firsts)), np.concatenate(parts, 1))


def test_passages_that_repeat_are_found(spark):
    rng = random.Random(6)
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    passage = fill(70)
    changed = list(passage)
    changed[35] = "changed"
    rows = [(i, " ".join(fill(100) + (passage if i % 2 else changed) + fill(50 + i))) for i in range(12)]
    rows += [(100 + i, " ".join(fill(200))) for i in range(12)] + [(200, None), (201, ""), (202, "short")]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {d for r in got for d in (r.doc_id, r.other_id)} == set(range(12))
    assert all(r.start >= 95 and r.similarity >= 0.75 for r in got)


def test_long_lists_are_dealt_in_parts(spark):
    """Every window stays, the parts of a list are joined again, and all documents of a passage remain linked."""
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    rng = random.Random(7)
    passage = fill(70)
    docs = spark.createDataFrame([(i, " ".join(fill(60) + passage + fill(60))) for i in range(40)], "doc_id long, text string")
    tokens, parts = hot = passages._hot(docs, 8, 1)
    assert len(tokens) and parts.max() == 5 and (np.diff(tokens) > 0).all()
    whole, dealt = passages.windows(docs), passages.windows(docs, hot, 4)
    assert sorted(dealt.where("part >= 0").drop("part").collect()) == sorted(whole.drop("part").collect())
    assert {r.part for r in dealt.select("part").distinct().collect()} >= {-1, 0, 1, 2, 3, 4}
    held = whole.collect()
    for near in (1, 2):
        links = passages._links(passages.windows(docs, hot, 2).withColumn("group", F.col("doc_id")), near).where("b is not null").select("a", "b", "token").collect()
        assert all(r.a > r.b for r in links)
        for token in {r.token for r in links if r.token in set(tokens.tolist())}:
            group = {i: i for i in range(40)}
            for r in links:
                if r.token == token:
                    low, high = sorted((group[r.a], group[r.b]))
                    group = {k: low if v == high else v for k, v in group.items()}
            assert len({group[r.doc_id] for r in held if r.token == token}) == 1


def test_recall_of_changed_passages(spark):
    """Of passages that differ in places but keep a similarity of 0.75 over 46 shingles, nine of ten are found or more."""
    rng = random.Random(9)
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    rows, wanted = [], set()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(120):
        passage = fill(rng.randrange(55, 200))
        other = list(passage)
        for _ in range(rng.randrange(0, len(passage) // 30 + 1)):
            other[rng.randrange(len(other))] = fill(1)[0]
        if 100 * len(shingles(passage) & shingles(other)) >= 75 * len(shingles(passage) | shingles(other)):
            wanted.add((2 * k + 1, 2 * k))
        rows += [(2 * k, " ".join(fill(rng.randrange(300)) + passage + fill(rng.randrange(300)))), (2 * k + 1, " ".join(fill(rng.randrange(300)) + other + fill(rng.randrange(300))))]
    got = {(r.doc_id, r.other_id) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(wanted) > 80 and len(wanted & got) >= 0.95 * len(wanted), (len(wanted), len(wanted & got))
    assert all(a == b + 1 and b % 2 == 0 for a, b in got)


def test_variants_of_a_passage_are_one_class(spark):
    """Classes are those of all links between variants of one passage; longer lists are linked round by round."""
    rng = random.Random(12)
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for size, words, changes in ((200, 60, 2), (300, 80, 4)):
        passage = fill(words)
        texts = []
        for _ in range(size):
            text = list(passage)
            for _ in range(rng.randint(1, changes)):
                text[rng.randrange(words)] = fill(1)[0]
            texts.append(text)
        sets = [shingles(t) for t in texts]
        least = list(range(size))
        for a in range(size):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low, high = sorted((least[a], least[b]))
                    least = [low if x == high else x for x in least]
        rows = [(i, " ".join(fill(30) + t + fill(30))) for i, t in enumerate(texts)]
        got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        classes = {d: r.class_id for r in got for d in (r.doc_id, r.other_id)}
        linked = {i for i in range(size) if least.count(least[i]) > 1}
        assert len(linked & classes.keys()) >= 0.99 * len(linked), (len(linked), len(linked & classes.keys()))
        held = linked & classes.keys()
        # Parts of two texts may be similar where the whole passages are not, so a class may join groups, never split one.
        assert len({(least[i], classes[i]) for i in held}) == len({least[i] for i in held})


def test_pairs_among_a_common_line_are_found(spark):
    """Copies of a passage that mostly is a line of all documents: its lists are long, and no pair of them is left out."""
    rng = random.Random(21)
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    line, rows = fill(40), []
    for k in range(200):
        passage = line + fill(10)
        rows += [(k + 1000 * i, " ".join(fill(40) + passage + fill(40))) for i in range(2 if k < 20 else 1)]
    rng.shuffle(rows)
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.class_id) for r in got} == {(1000 + k, k, k) for k in range(20)}


def test_meetings_equal_their_definition():
    rng = np.random.default_rng(22)
    found = 0
    for _ in range(20):
        n = int(rng.integers(0, 30))
        doc, c, token = np.sort(rng.integers(0, 3, n)), rng.integers(0, 150, n), rng.integers(0, 20, n)
        by = np.lexsort((c, doc))
        doc, c = doc[by], c[by]
        left, right = c - rng.integers(0, 80, n), c + rng.integers(0, 80, n)
        for enough in (2, 3):
            want = set()
            for at in map(list, itertools.combinations(range(n), enough)):
                low, high = left[at].max(), right[at].min()
                if len(set(doc[at])) == 1 and len(set(token[at])) == enough and low <= c[at].min() and c[at].max() <= high and high - low + 1 >= passages.LEAST:
                    want.add(tuple(at))
            assert {tuple(x) for x in passages.meetings(doc, token, left, c, right, enough).tolist()} == want
            found += len(want)
    assert found > 100


def test_places_of_a_line_make_no_pairs(spark):
    """Texts that share a line alone are told apart in their list: before, each two of them were moved and verified (F1)."""
    rng = random.Random(23)
    fill = lambda n: [f"f{rng.randrange(10**7)}" for _ in range(n)]
    line, junk = fill(34), [w for w in fill(8) for _ in range(16)]
    texts = [fill(40) + line + fill(40) for _ in range(150)] + [fill(30) + junk + fill(30) for _ in range(3)] + [[w for w in ("the", *fill(9)) for _ in range(16)] for _ in range(100)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    groups = spark.createDataFrame([], "doc_id long, group long")
    left = passages._met(passages.windows(docs).join(groups, "doc_id", "left"))
    rows = left.withColumn("group", F.col("doc_id")).cache()
    shared = rows.alias("x").join(rows.alias("y"), "token").where("x.doc_id > y.doc_id").select("x.doc_id", "y.doc_id").toDF("a", "b").distinct().count()
    pairs = {(r.a, r.b) for r in passages._all_links(rows, docs).select("a", "b").distinct().collect()}
    assert shared > 5000 and pairs == {(151, 150), (152, 150), (152, 151)}, (shared, len(pairs))


def test_no_similar_passages_are_told_apart(monkeypatch):
    """Pairs of places that are not promising hold no similar passages: variants, texts in another order, repeated phrases."""
    rng = np.random.default_rng(5)
    words = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    found = left_out = 0
    for trial in range(120):
        base = words(int(rng.integers(46, 260)))
        if trial % 4 == 0:
            base = words(300)[rng.integers(0, int(rng.choice([8, 60, 300])), len(base))]
        texts = []
        for _ in range(8):
            text = base.copy()
            for _ in range(int(rng.integers(0, len(base) // 12 + 1))):
                at = int(rng.integers(0, len(text)))
                text[at : at + 5] = words(len(text[at : at + 5]))
            if rng.random() < 0.2:
                text = np.concatenate([text[len(text) // 2 :], text[: len(text) // 2]])
            texts.append(np.concatenate([words(int(rng.integers(0, 60))), text, words(int(rng.integers(0, 60)))]))
        rows = [next(passages.sketches(np.concatenate([t, t]), [(0, len(t) - 1)])) for t in texts]
        side = lambda s: (np.array([v[0] for v in s]), np.array([v[1] for v in s]), *passages._codes([pa.scalar(v[2]) for v in s]))
        monkeypatch.setattr(passages, "SHARED", 1 << 20 if trial % 2 else 500)
        wanted = rng.random((4, 4)) < 0.9
        got = passages.promising(side(rows[:4]), side(rows[4:]), wanted)
        for i, k in itertools.product(range(4), range(4)):
            same = bool(passages.same_passages(texts[i], texts[4 + k]))
            assert not got[i, k] or wanted[i, k]
            assert got[i, k] or not same or not wanted[i, k]
            found, left_out = found + same, left_out + (not got[i, k])
    assert found > 300 and left_out > 300, (found, left_out)


def test_different_elements_of_stretches():
    rng = np.random.default_rng(6)
    for _ in range(100):
        x = rng.integers(0, int(rng.choice([3, 20, 1000])), int(rng.integers(0, 90))).astype(np.uint32)
        for least in (5, 46):
            assert passages.different(passages._neighbours(x)[0], least).tolist() == [len(set(x[i : i + least].tolist())) for i in range(len(x) - least + 1)]


def test_joined_windows_leave_no_meeting_out():
    """Overlapping windows of one token are one; every place where windows met lies in one of theirs."""
    rng = np.random.default_rng(24)
    for _ in range(20):
        n = int(rng.integers(0, 60))
        doc, c, token = np.sort(rng.integers(0, 2, n)), rng.integers(0, 200, n), rng.integers(0, 6, n)
        by = np.lexsort((c, doc))
        doc, c, token = doc[by], c[by], token[by]
        left, right = c - rng.integers(0, 80, n), c + rng.integers(0, 80, n)
        whole = {(doc[x[0]], *sorted(token[x]), left[x].max(), right[x].min()) for x in passages.meetings(doc, token, left, c, right)}
        t, d, lo, first, last, hi = passages.joined(token, doc, left, c, c, right)
        got = [(d[x[0]], *sorted(t[x]), lo[x].max(), hi[x].min()) for x in passages.meetings(d, t, lo, first, hi, last=last)]
        assert all(any(w[:4] == g[:4] and g[4] <= w[4] and w[5] <= g[5] for g in got) for w in whole)


def test_odd_tables_of_passages(spark):
    rng = random.Random(13)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long, 1), (2, "x " + long, 2), (3, None, 3), (4, "", 4), (None, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int").withColumn("token", F.lit(1)).withColumn("group", F.lit(1))
    got = passages.near_passages(docs).collect()
    assert {(r.doc_id, r.other_id, r.class_id) for r in got} == {(2, 1, 1)} and sum(r.n_shingles for r in got) >= 59_990
    assert passages.near_passages(docs.limit(0)).collect() == []


def test_passages_with_repeated_phrases():
    """A shingle of the passage stands elsewhere in the other text too, or the passage stands there twice."""
    own = np.arange(1000, 1070).astype(np.uint32)
    for k in (0, 20, 35, 69):
        y = np.concatenate([[own[k]], np.arange(115), own]).astype(np.uint32)
        assert passages.same_passages(own, y) == [(0, 70, 116, 186, 1.0)]
        assert passages.same_passages(y, own) == [(116, 186, 0, 70, 1.0)]
    y = np.concatenate([own, np.arange(60), own, own[10:30]]).astype(np.uint32)
    assert passages.same_passages(own, y) == [(0, 70, 0, 70, 1.0), (0, 70, 130, 200, 1.0)]
    line = np.arange(500, 512).astype(np.uint32)
    x, y = np.concatenate([np.tile(line, 3), own, np.tile(line, 2)]), np.concatenate([np.tile(line, 5), np.arange(60).astype(np.uint32), own])
    assert (36, 106) in {(max(i, 36), min(j, 106)) for i, j, *_ in passages.same_passages(x, y)}


def test_runs_of_equal_shingles(monkeypatch):
    monkeypatch.setattr(passages, "POINTS", 5)
    rng = np.random.default_rng(8)
    for _ in range(50):
        x, y = (rng.integers(0, 4, int(rng.integers(1, 30))).astype(np.uint32) for _ in range(2))
        want = set()
        for i in range(len(x)):
            for k in range(len(y)):
                if x[i] == y[k] and not (i and k and x[i - 1] == y[k - 1]):
                    n = 0
                    while i + n < len(x) and k + n < len(y) and x[i + n] == y[k + n]:
                        n += 1
                    want.add((i, k, n))
        assert set(zip(*(c.tolist() for c in passages._runs(x, y)))) == want


def test_seeds_left_out_change_nothing(monkeypatch):
    """Texts of phrases that repeat: runs that cannot grow are left out without loss."""
    rng = np.random.default_rng(11)
    phrases = [rng.integers(0, 10**6, int(rng.integers(8, 60))).astype(np.uint32) for _ in range(6)]
    for _ in range(30):
        x, y = (np.concatenate([c for _ in range(12) for c in (phrases[rng.integers(6)], rng.integers(0, 10**6, int(rng.integers(0, 9))).astype(np.uint32))]) for _ in range(2))
        monkeypatch.setattr(passages, "FEW", 10**9)
        want = passages.same_passages(x, y)
        monkeypatch.setattr(passages, "FEW", 0)
        assert passages.same_passages(x, y) == want
