"""Token alignment, vector codes and pieces, against plain Python and the libraries themselves."""

import glob
import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyard.llm import alignment, piecemodel, pieces, queries, vectorcodes, wordcache

MORE = ["a ▁ b", "<|endoftext|> and <s> </s> <unk>", "  two  spaces  ", "tab\tnew\n\nline    x", "don't I'll 12345 ...!!", "é ﬁ ①", "\x00 zero", "<0x41> x", "no" * 3000, "▁", " "]


@pytest.fixture(scope="module")
def more(spark, odd):
    rows = [(100 + i, t) for i, t in enumerate(MORE)]
    return odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- pieces -----------------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "more", "none"])
def test_pieces_are_the_librarys(table, request):
    df = request.getfixturevalue(table)
    library = sentencepiece.SentencePieceProcessor(model_file=piecemodel.default_model())
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    for encoded in (pieces.decode(pieces.encode(df.select("doc_id", "text"))), pieces.encode(df, decoded=True)):
        assert rows_of(pieces.digests(encoded).drop("spans_sha256")) == sorted(want, key=repr)


def library_spans(library, text):
    found = piecemodel.fields(library.encode(text, return_type="serialized_proto"))
    own = [dict(piecemodel.fields(v)) for number, v in found if number == 2]
    return [(x.get(4, 0), x.get(5, 0)) for x in own]


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("prefix", [0, 1])
def test_spans_over_compiled_maps(rule, squeeze, prefix):
    """Ids and byte spans are the library's, with compiled maps of several rules set into the model."""
    with open(piecemodel.default_model(), "rb") as f:
        model = f.read()
    spec = {}
    if rule != "identity":
        made = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        spec = dict(next(piecemodel.fields(v) for number, v in piecemodel.fields(made) if number == 3))
    spec |= {3: prefix, 4: squeeze, 5: 1}
    parts = [piecemodel.field(k, v) for k, v in piecemodel.fields(model) if k != 3]
    own = piecemodel.PieceModel(b"".join(parts) + piecemodel.field(3, b"".join(piecemodel.field(k, v) for k, v in spec.items())))
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab  e▁é漢 　①ﬁ\x00\n\t①ｶﾞé Å½…<>s/é😀", k=draw.randrange(30))) for _ in range(400)]
    for text, (ids, begins, ends) in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == own.library.encode(text, add_eos=True), text
        spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
        assert spans == [*library_spans(own.library, text), (len(text.encode()),) * 2], text


def test_spans_tile_the_source(spark):
    text = "Ünï 漢字 😀  end"
    row = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    source = text.encode()
    assert row.begins[0] == 0 and row.ends[-1] == len(source) and row.ids[-1] == 2
    assert b"".join(source[a:b] for a, b in zip(row.begins, row.ends, strict=True)) == source


@pytest.mark.parametrize("turn,most", [(7, 40), (1 << 16, 1 << 18)])
def test_words_give_the_ids_of_whole_texts(turn, most, monkeypatch):
    """Whatever stands between words, and when the cache starts afresh in the middle of a text."""
    monkeypatch.setattr(wordcache, "TURN", turn)
    monkeypatch.setattr(wordcache, "WORDS", most)
    monkeypatch.setattr(wordcache, "PART", 50)
    monkeypatch.setattr(piecemodel, "PART", turn)
    model = piecemodel.piece_model(piecemodel.default_model())
    pair = alignment._pair(alignment.default_byte_tokenizer(), piecemodel.default_model())
    draw = random.Random(5)
    signs = ["word", " ", "  ", "▁", "é", "xyz", "\n", "\t", "\r\n", "'s", "42", "...", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "漢", "😀", "<|endoftext|>", "long" * 20]
    texts = ["".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(600)] + ["", " ", "  ", "\n", " \n \n  a     b c　 d", "don't  we'll 12 34"]
    for text, b in zip(texts, model.encode([t.encode() for t in texts]), strict=True):
        words = pair.split(text)
        assert "".join(words) == " " + text
        assert [i for w in words for i in pair.encode_a(w).tolist()] == pair.encoder.encode(" " + text, add_special_tokens=False).ids, text
        assert not text or [i for w in words for i in pair.encode_b(w).tolist()] == model.library.encode(text), text
        assert b[0].tolist() == model.library.encode(text, add_eos=True), text


def test_models_that_are_refused():
    with open(piecemodel.default_model(), "rb") as f:
        model = f.read()
    parts = [piecemodel.field(k, v) for k, v in piecemodel.fields(model) if k != 3]
    with pytest.raises(ValueError, match="plain spaces"):
        piecemodel.PieceModel(b"".join(parts) + piecemodel.field(3, piecemodel.field(5, 0)))


def test_pieces_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "x", 5, "k", "d")], "doc_id long, text string, ids int, own string, `a.b` string")
    row = pieces.decode(pieces.encode(df)).first()
    assert (row.doc_id, row.own, row["a.b"], row.decoded, row.ids[-1]) == (1, "k", "d", "x", 2)


# --- alignment --------------------------------------------------------------


def plain_alignment(rows):
    """The contract's columns by loops over tokens."""
    a_tok = Tokenizer.from_file(alignment.default_byte_tokenizer())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=piecemodel.default_model())
    byte_of = alignment.byte_characters()
    shown_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc, text in rows:
        whole = " " + (text or "")
        a = [(i, bytes(byte_of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(whole, add_special_tokens=False).ids]
        b = [(i, shown_b(i)) for i in b_tok.encode(text or "")]
        if not text or any(b"".join(x for _, x in side) != whole.encode() for side in (a, b)):
            found.append((doc, 0, 0, [], []))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for i, begin, end in spans[0]:
            while spans[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, _, e in side if before < e <= cut) for side in spans) for before, cut in zip([0, *cuts], cuts)] if len(a) < 3000 else None
        found.append((doc, len(a), len(b), groups if groups is not None else len(cuts), links))
        counts.update(links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for doc, n_a, n_b, groups, links in found:
        n_groups = groups if isinstance(groups, int) else len(groups)
        digest = None if isinstance(groups, int) else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest


@pytest.mark.parametrize("table", ["docs", "more", "none"])
@pytest.mark.parametrize("chunk", [100, 1 << 21])
def test_alignment(table, chunk, request, monkeypatch):
    df = request.getfixturevalue(table)
    if table == "docs":
        df = df.filter("length(text) < 4000")  # the loops are quadratic
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    want = sorted(plain_alignment([tuple(r) for r in df.select("doc_id", "text").collect()]), key=repr)
    got = rows_of(alignment.aligned(df))
    known = {w[:-1]: w[-1] for w in want if w[-1] is not None}
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(known.get(g[:-1], g[-1]) == g[-1] for g in got)


def test_spans_of_labels():
    """Tokens of 1+2+3 bytes against 3+1+2: groups end at 3 and 6, links are the overlapping pairs."""
    length = np.array([0, 1, 2, 3])
    many_a, many_b, place_a, place_b, ends = alignment.align(np.array([1, 2, 3]), np.array([3, 1, 2]), length, length)
    assert (many_a.tolist(), many_b.tolist()) == ([2, 1], [1, 2]) and ends.tolist() == [3, 6]
    assert list(zip(place_a.tolist(), place_b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


# --- vector codes -----------------------------------------------------------


def test_codes_match_sql(spark, sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.op12_partial_distance_codes(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op12_partial_distance_codes']})").fetchall()
    assert rows_of(df) == sorted(want, key=repr)


def plain_codes(rows):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = len(kept[0][1]) // 8
    cut = [[v[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(8)] for c in cut]
    errors = Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(kept, found, strict=True)), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, code string, vector int"


@pytest.mark.parametrize("n", [5, 16, 120])
def test_codes_of_odd_rows(n, spark):
    """Dropped rows, ties, repeated and null ids, null labels, entries that lose their parts; fewer rows than entries."""
    draw = random.Random(n)
    rows = [(draw.choice([None, i, i // 2]), [draw.choice([-1.5, 0.0, 0.25, draw.gauss(0, 1)]) for _ in range(24)], draw.choice([None, 1, 2]), "x", 1) for i in range(n)]
    rows += [rows[0], (1, None, 1, None, None), (2, [1.0] * 23 + [None], 1, None, 2), (3, [float("nan")] + [0.0] * 23, 1, "y", 3), (4, [0.0] * 23 + [float("-inf")], None, "z", 4)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    rounded = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label, _, _ in rows]
    assert rows_of(vectorcodes.coded(df)) == plain_codes(rounded)


def test_codes_of_no_rows(spark):
    df = spark.createDataFrame([(1, None, 1, "x", 1)], VECTORS)
    assert vectorcodes.coded(df).collect() == vectorcodes.coded(df.filter("false")).collect() == []
    with pytest.raises(Exception, match="components"):
        vectorcodes.coded(spark.createDataFrame([(1, [1.0] * 16, 1, "", 1), (2, [1.0] * 8, 1, "", 1)], VECTORS)).collect()


def test_partial_distances_against_all_distances():
    draw = np.random.default_rng(2)
    for spread in (1, 3, 1000):
        parts, book = draw.integers(-spread, spread + 1, (500, 8)), draw.integers(-spread, spread + 1, (16, 8))
        whole = ((parts[:, None] - book) ** 2).sum(axis=2)
        index, distance = vectorcodes.nearest(parts, book)
        assert (index == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
