import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from cloudweave.llm import bins, packing, pieces, tokens


def want_ids(df):
    whole = tokens.WordTokenizer(tokens.default_path()).whole
    return sorted((str(r.doc_id), whole.encode(r.text or "", add_special_tokens=False).ids + [tokens.END]) for r in df.select("doc_id", "text").collect())


def documents_of(rows):
    """Ids put together again, from rows of doc_id, start, doc_tokens, ids."""
    parts = defaultdict(list)
    for doc, start, ids in rows:
        parts[doc].append((start, list(ids)))
    return parts


def check_sequences(rows, window):
    """Each sequence is gapless from 0 and no longer than window; the share of padding."""
    by = defaultdict(list)
    for seq, offset, length in rows:
        by[seq].append((offset, length))
    total = pad = 0
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at and length > 0
            at += length
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(1, total + pad)


def test_words_have_the_librarys_ids(odd, documents):
    own = tokens.WordTokenizer(tokens.default_path())
    texts = [r.text or "" for df in (odd, documents) for r in df.select("text").collect()]
    texts += ["don't  it'S 'single x'll", "a b", "Σίσυφος ΟΔΟΣ", "tab\tx\x0bq\x1cz", "é é", "½ x² ª ß", "a\x00b", "x" * 5000, "!?." * 300]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<i4").tolist() == own.whole.encode(t, add_special_tokens=False).ids


def test_cuts_cost_least():
    rng = np.random.default_rng(1)
    for _ in range(200):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 8, rng.integers(2, 30)))]))
        price = rng.integers(0, 5, len(at)).astype(float)
        cost = [0.0] + [np.inf] * (len(at) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        for j in range(1, len(at)):
            cost[j] = min(cost[i] + pad(int(at[j] - at[i])) + price[j] + packing.NEW_WINDOW for i in range(j) if at[j] - at[i] <= 16)
        got = [0, *packing.cuts(at, price, 16, True)]
        place = {int(a): i for i, a in enumerate(at)}
        assert sum(pad(b - a) + price[place[b]] + packing.NEW_WINDOW for a, b in zip(got, got[1:])) == cost[-1]


def test_packing_is_lossless(odd, documents, empty, monkeypatch):
    for df in (odd, documents):
        rows = packing.pack(df).collect()
        parts = documents_of((r.doc_id, r.start, r.ids) for r in rows)
        want = want_ids(df)
        if df is documents:
            got = sorted((str(d), sum((x for _, x in sorted(p)), [])) for d, p in parts.items())
            assert got == want
        assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
        assert check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096) < 0.03
    assert packing.pack(empty).count() == 0


def test_packing_keeps_order_and_long_documents(spark):
    df = spark.createDataFrame([(i, f"word{i} " * (50 if i % 7 else 30000)) for i in range(20)], "doc_id long, text string").coalesce(1)
    rows = sorted(packing.pack(df).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for d, p in documents_of((r.doc_id, r.start, r.ids) for r in rows).items():
        at = 0
        for start, ids in sorted(p):
            assert start == at
            at += len(ids)
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096) < 0.03


def test_best_fit_decreasing_equals_plain():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = rng.integers(1, 17, 200)
        bins_, offsets, made = bins.best_fit(lengths, 16)
        rooms = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(16 - n)
        assert made == len(rooms)
        check_sequences(zip(bins_.tolist(), offsets.tolist(), lengths.tolist()), 16)


def test_matrices_are_lossless(spark, odd, documents, empty, tmp_path):
    for df in (odd, documents):
        rows = bins.matrices(df).collect()
        parts = defaultdict(list)
        for r in rows:
            assert len(r.ids) == len(r.positions) == 4096 and r.cu_seqlens[0] == 0
            for a, b, d, s in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts):
                assert r.positions[a:b] == list(range(b - a))
                parts[d].append((s, r.ids[a:b]))
            assert r.positions[r.cu_seqlens[-1] :] == list(range(4096 - r.cu_seqlens[-1]))
        want = want_ids(df)
        assert sum(len(x) for p in parts.values() for _, x in p) == sum(len(i) for _, i in want)
        if df is documents:
            assert sorted((str(d), sum((x for _, x in sorted(p)), [])) for d, p in parts.items()) == want
    assert bins.matrices(empty).count() == 0
    bins.write(documents, str(tmp_path / "ids"))
    back = spark.read.parquet(str(tmp_path / "ids")).head()
    assert len(np.frombuffer(back.ids, "<i4")) == 4096
    got = bins.digests(documents).collect()
    assert all(r.positions_ok for r in got) and len(got) >= documents.count()


def test_pieces_are_the_librarys(odd, documents, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    for df in (odd, documents):
        want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in df.select("doc_id", "text").collect())
        encoded = pieces.encode(df)
        assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
        texts = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect()) == texts
    assert pieces.encode(empty).count() == pieces.round_trip(empty).count() == 0


def test_pieces_of_odd_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    own = pieces.Pieces(pieces.default_path())
    texts = ["", " ", "  a   b  ", "x\n\n y\n", "日本語 text 😀 1234 5", "a\tb\r\nc", "▁▁x ▁ y", "    def f(x):\n        return  x", "a b\x0bc\x85d", "<s> </s> <0x0A>", " " * 501, "abc" * 900, "x" * 300]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(t)
        assert own.decode(library.encode(t)) == library.decode(library.encode(t))


def test_rows_of_ids_are_views():
    """Ids come as arrays, without a Python list, also from null, empty and sliced rows."""
    column = pa.array([[1, 2], None, [], [3, 4, 5]], pa.list_(pa.int32()))
    got = list(pieces.rows_of(column))
    assert [r.tolist() for r in got] == [[1, 2], [], [], [3, 4, 5]] and all(r.dtype == "<i4" for r in got)
    assert [r.tolist() for r in pieces.rows_of(column.slice(1, 3))] == [[], [], [3, 4, 5]]
