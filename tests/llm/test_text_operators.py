"""Operators that judge each text by itself, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyard.llm import fingerprints, interleaved, licenses, packing, pii
from tallyard.llm.common import text_of

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- media ------------------------------------------------------------------


def media(docs):
    payloads = interleaved.payloads(docs)
    sequences = interleaved.media_of(interleaved.parse_sequences(interleaved.text_documents(docs)))
    return interleaved.features(interleaved.resolve(sequences, lambda wanted: interleaved.store(payloads, wanted), ["doc_id"]))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_media_round_trip(table, request):
    df = request.getfixturevalue(table)
    found = collected(media(df))
    assert sum(map(len, found.values())) == df.count()
    for doc, text in texts_of(df):
        raw = text.encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        hits = [r for r in found[doc] if r.payload_sha256 == hashlib.sha256(payload).hexdigest()]
        assert hits and (hits[0].n_bytes, hits[0].payload_bytes, hits[0].tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        image = interleaved.encode(payload)
        lines = [x for x in text.split("\n") if x.split()]
        assert (hits[0].n_texts, hits[0].n_media, hits[0].caption) == (len(lines), 2, f"text of {len(raw)} bytes")
        assert hits[0].position == (1 if text.split("\n")[0].split() else 0)
        start = interleaved.encode(payload[:192])
        assert (hits[0].start_position, hits[0].start_bytes, hits[0].start_media_sha256) == (len(lines) + 1, 192, hashlib.sha256(start).hexdigest())
        assert (hits[0].media_bytes, hits[0].media_sha256, hits[0].feature) == (len(image), hashlib.sha256(image).hexdigest(), interleaved.feature(interleaved.decode(image)))


def test_sequences_keep_order_and_captions(spark):
    html = (
        "<article><h1>T &amp; U</h1><p>one<br>two<img data-digest=d1 alt=first>three</p><figure><img data-digest='d2'><img data-digest='d3' alt=x><figcaption>both  <b>here</b></figcaption></figure>"
        "<script>no</script><p>end<img src=plain></article>"
    )
    df = spark.createDataFrame([(1, html, "k"), (2, None, "k"), (3, "", "k")], "doc int, html string, kind string")
    store = spark.createDataFrame([("d1", b"A"), ("d2", b"B")], "digest string, media binary")
    seq = interleaved.parse_sequences(df.drop("kind"))
    got = {r.doc: [(x.position, x.kind, x.text, x.digest, x.caption, x.media and bytes(x.media)) for x in r["items"]] for r in interleaved.assemble(interleaved.resolve(seq, store, ["doc"]), ["doc"]).collect()}
    assert got == {1: [
        (0, "text", "T & U", None, None, None), (1, "text", "one two", None, None, None), (2, "media", None, "d1", "first", b"A"), (3, "text", "three", None, None, None),
        (4, "media", None, "d2", "both here", b"B"), (5, "media", None, "d3", "both here", None), (6, "text", "end", None, None, None),
    ]}


def test_malformed_tags_take_linear_time():
    """Quotes without an end, tags without one, end tags of nothing: each is read a bounded number of times."""
    import time

    for html in ("<p>ok</p><a " + '"x" ' * 100_000, "<a " * 100_000, '<a x="' * 50_000, "<h1>" * 30_000 + "</ul>" * 30_000, "</" * 100_000, "<!--" * 50_000):
        began = time.time()
        interleaved.items(html)
        assert time.time() - began < 3, html[:20]
    assert [x["text"] for x in interleaved.items('<p>ok</p><a "x" "y">z</a> <b title="a>b">q</b><a href="open')] == ["ok", 'z q<a href="open']


def test_nested_elements_take_linear_time():
    """What a tag closes is found without climbing, and each element's names are read once."""
    import time

    from tallyard.llm import extraction

    story = "<p>A paragraph of the story, long enough to score, with commas.</p>" * 4
    for html in (
        "<ul>" + "<b>" * 40_000 + "<li>x" * 40_000, "<article>" + "<b>" * 40_000 + "<header>" * 40_000, "<p>" + "<b>" * 40_000 + "</i>" * 40_000, "<li><ul>" * 30_000 + "<li>" * 30_000,
        "<figure>" * 15_000 + "<img data-digest=x>" * 15_000 + "<figcaption>x</figcaption></figure>" * 15_000, "<main>" + "<section><p>text that is long enough, really</p><div>x</div></section>" * 10_000,
        "<div class=entry-header>" * 20_000 + story, "<table>" + "<tr><td>" * 40_000,
    ):
        for read in (interleaved.items, extraction.main_text):
            began = time.time()
            read(html)
            assert time.time() - began < 8, (read, html[:20])


def test_captions_of_figures_in_figures():
    """The outer figure's caption holds for all its media; media of figures without one keep what they have."""
    html = "<figure><img data-digest=a alt=own><figure><img data-digest=b><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure><figure><figure><img data-digest=c><figcaption>in</figcaption></figure><img data-digest=d alt=own></figure>"
    assert [(x["digest"], x["caption"]) for x in interleaved.items(html)] == [("a", "outer"), ("b", "outer"), ("c", "in"), ("d", "own")]


def test_sequences_of_clashing_names(spark):
    """Columns named as added ones give way; all others stay, also those of names that joins or tasks might use."""
    df = spark.createDataFrame([(1, "<p>t<img data-digest=d></p>", 7, "k", "s", 3, 4)], "doc int, html string, items int, kind string, `a.b` string, `_salt` int, salt int")
    seq = interleaved.parse_sequences(df)
    assert seq.columns == ["doc", "kind", "a.b", "_salt", "salt", "items"]
    store = spark.createDataFrame([("d", b"M")], "digest string, media binary")
    got = sorted((tuple(r) for r in interleaved.resolve(seq, store, ["doc"]).select("doc", "`a.b`", "_salt", "salt", "position", "kind", "text", "media").collect()), key=lambda r: r[4])
    assert got == [(1, "s", 3, 4, 0, "text", "t", None), (1, "s", 3, 4, 1, "media", None, b"M")]


def test_damaged_media_is_refused():
    image = bytearray(interleaved.encode(b"x" * 192))
    image[45] ^= 1
    with pytest.raises(Exception):
        interleaved.decode(bytes(image))


def test_hot_digest_is_salted(spark):
    from tallyard.llm.common import lookup_join

    left = spark.range(3000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 700) END AS digest")
    right = left.select("digest").distinct().selectExpr("digest", "concat('p', digest) AS media")
    out = lookup_join(left, right, "digest", ["id"])
    assert out.count() == 3000 and out.filter("media <> concat('p', digest)").count() == 0


# --- personal data ----------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


HARD = [
    "a@b.c_d@e.fg, 1.2.3.256 1.2.3.4.5 4111 1111 1111 1111.", "+1 (555) 123-4567+44 20 7946 0958 ++1", "é\U0001f600 m@n.op 0000000012.1.1.1 256.1.1.1", "1 " * 5000 + "x@y.zz",
    "1.1.1.1 " * 400 + "q@q.qq " * 300, "1.2.3.45.6.7.8.9 1.2.3.4" * 3, "12345" * 800 + ".1.1.1 " + "7" * 20_000, "+1" + " " * 200_000 + "2", "+1" * 100_000, "a@" * 100_000 + "b.cc", "a" * 30_000 + "@b.cc", "4111-1111-1111-1111 4111 1111 1111 1112 12345678901234567890", 'key: "0a1b2c3d4e5f6a7b8c9d0a1b2c3d4e5f" x', "1" * 40_000,
]


@pytest.mark.parametrize("table", ["docs", "odd", "none", "hard"])
def test_base_spans(table, request, spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string") if table == "hard" else request.getfixturevalue(table)
    found = collected(pii.find(df))
    assert sum(map(len, found.values())) == df.count()
    for doc, text in texts_of(df):
        want = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = next(r for r in found[doc] if r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k, _ in BASE]
        if want:
            assert set(joined.split(",")) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["7" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + "@1", "a1" * 500_000 + "@", "+1" * 500_000, "+1" + " " * 1_000_000, "A" * 1_000_000 + "1", "a://b:" * 170_000 + "@1", "@1" * 500_000], ids=lambda x: x[:6])
def test_patterns_read_long_runs_once(text, spark):
    """A million characters of any kind: each pattern's search takes about a second, not one for each character."""
    import time

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "text string")
    counts = [F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(k) for k, p in pii.PATTERNS.items()]
    df.select(*counts).collect()
    began = time.time()
    df.select(*counts).collect()
    assert time.time() - began < 6  # eight patterns


def test_long_texts_full_of_spans(spark):
    """Spans and masks far into a text of many: positions, contexts and runs as at its start."""
    unit = "é 1.2.3.4 call +1 555 123 4567, mail ab@c.de; 4111 1111 1111 1111 x\n"
    df = spark.createDataFrame([(1, unit * 3000)], "doc_id long, text string")
    r = pii.find(df).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (3000,) * 4
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(unit * 3000)).encode()).hexdigest()
    assert pii.redact(df).first().text == "é [IP] call [PHONE], mail [EMAIL]; [CARD] x\n" * 3000


def test_runs_of_overlapping_spans_are_masked_once(spark):
    """A mark for the first span of each run, against plain Python."""
    texts = ["+1 4111 1111 1111 1111 end", "4111 1111 1111 1111+1 555 123 4567", "x a@b.cc" * 700, "1.2.3.4+12 345 678 901 1.2.3.4 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [x.rsplit(":", 2) for x in r.spans.split(",") if x] for r in pii.find(df).collect()}
    for r in pii.redact(df).collect():
        out, at, text = "", 0, texts[r.doc_id]
        for kind, start, end in spans[r.doc_id]:
            if int(start) >= at:
                out += text[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        assert r.text == out + text[at:]


def test_secrets_are_found_and_masked(spark):
    rows = [(i, f'word token = "{hashlib.sha1(str(i).encode()).hexdigest()}" word mail{i}@host.example.com end') for i in range(40)] + [(100, "a clean text of common words"), (101, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", text_of())
    got = collected(pii.find(df))
    assert all("secret:" in got[i][0].spans and "email:" in got[i][0].spans for i in range(40))
    assert got[100][0].spans == ""
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[3] == 'word token = "[SECRET]" word [EMAIL] end' and masked[100] == rows[40][1] and masked[101] is None


def test_reliabilities(spark):
    df = spark.createDataFrame([(1, "x 1.2.3.4 y 999.1.1.1 z " * 30)], "doc_id long, text string")
    model = pii.fit(df.select(pii.candidates(text_of()).alias("spans")))
    assert set(model.reliability) == set(pii.LABELERS) and model.reliability["check"]["for"] > 0.9


def test_reliabilities_are_those_of_plain_em(docs):
    """EM over a row for each candidate, instead of over counts of vote patterns."""
    spans = docs.select(pii.candidates(text_of()).alias("spans"))
    votes = [(s.kind, s.votes) for r in spans.collect() for s in r.spans]
    lean = np.array([sum({"+": 1, "-": -1, "0": 0}[v] * (2 if i == 0 else 1) for i, v in enumerate(x)) for _, x in votes], float)
    post, kind = 1 / (1 + np.exp(-1.5 * (lean - 0.5))), np.array([k for k, _ in votes])
    cast = np.array([list(x) for _, x in votes])
    for _ in range(40):
        prior = {k: (post[kind == k].sum() + 1) / ((kind == k).sum() + 2) for k in set(kind)}
        tables = []
        for i in range(len(pii.LABELERS)):
            table = {(v, y): 0.5 + (2 if (v, y) in (("+", 1), ("-", 0)) else 0) + (post if y else 1 - post)[cast[:, i] == v].sum() for v in "+-0" for y in (0, 1)}
            tables.append({(v, y): n / sum(table[u, y] for u in "+-0") for (v, y), n in table.items()})
        z = np.array([np.log(prior[k] / (1 - prior[k])) for k in kind])
        for i, t in enumerate(tables):
            z += np.array([np.log(t[v, 1] / t[v, 0]) for v in cast[:, i]])
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    got = pii.fit(spans).reliability
    assert len(votes) > 20
    for name, t in zip(pii.LABELERS, tables, strict=True):
        assert abs(got[name]["for"] - t["+", 1] / (t["+", 1] + t["+", 0])) < 1e-9 and abs(got[name]["against"] - t["-", 0] / (t["-", 1] + t["-", 0])) < 1e-9


def test_the_classifier_learns_from_spans():
    """Features of spans alone tell cells of high posterior from those of low."""
    cells = [(["secret:0:5", "secret:1:2"], 30, 0.95), (["secret:0:4", "secret:1:0"], 50, 0.05), (["secret:0:5", "secret:1:0"], 10, 0.2)]
    bias, weights = pii._logistic(cells, 2000)
    got = [1 / (1 + np.exp(-(bias + sum(weights[x] for x in names)))) for names, _, _ in cells]
    assert got[0] > 0.8 and got[1] < 0.15 and abs(got[2] - 0.2) < 0.15


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc", [3], 4), (2, "none", [5], 6)], "doc_id long, text string, _spans array<int>, spans int")
    assert [tuple(r) for r in pii.redact(df).orderBy("doc_id").collect()] == [(1, "mail [EMAIL]", [3], 4), (2, "none", [5], 6)]


# --- packing ----------------------------------------------------------------


def test_tokens_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, ref = packing.PieceTokenizer(path), Tokenizer.from_file(path)
    texts = [r.text for r in docs.collect()] + [
        "it's IT'S don't", "ÀÉÎ İs ΣΑΣ σας", "á\x1cc", "x\x01y z", "a　b", "日本語", "²½ Ⅷ 12a3", "é ́x", "ǅ ß ſ", "", "  ", "a\x85b", "<|endoftext|> x", "\x00 a\x00b", "12.5$$a,,b 7Z Ÿ ×÷",
    ]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == ref.encode(text, add_special_tokens=False).ids, text[:50]


def test_a_full_index_starts_afresh():
    from tallyard.llm.bytehash import HashIndex

    own = packing.PieceTokenizer(packing.default_tokenizer())
    own.index = HashIndex(64)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    for i in range(0, 200, 10):
        assert [x.tolist() for x in own.encode([" ".join(words[i : i + 10])])] == [own.encoder.encode(" ".join(words[i : i + 10]), add_special_tokens=False).ids]


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_pieces(table, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(table)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(df).collect()
    sequences, by = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(sequences) == list(range(len(sequences)))
    tokens, parts = sum(r.length for r in rows), df.rdd.getNumPartitions()
    assert len(sequences) * packing.CAPACITY <= 1.01 * tokens + packing.CAPACITY * (parts + 1)
    copies = {}
    for doc, text in texts_of(df):
        copies.setdefault((doc, text), []).append(1)
    left = {k: list(v) for k, v in by.items()}
    for (doc, text), n in copies.items():
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [packing.END_ID], "<u4").tobytes()
        times = np.zeros(len(ids) // 4, int)
        for r in by[doc, len(ids) // 4]:
            if zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32:
                times[r.start : r.start + r.length] += 1
                left[doc, len(ids) // 4].remove(r)
        assert (times == len(n)).all()
    assert not any(left.values())


def test_bins_keep_documents_whole():
    """Class k has k documents a bin; gaps are filled by cut ones; nothing is lost."""
    g, bins, sizes = np.random.default_rng(6), packing.Bins(), []
    for doc in range(2000):
        sizes.append(int(g.lognormal(6, 1.2)) + 1)
        bins.add(doc, np.arange(sizes[-1], dtype="<u4").tobytes())
    bins.finish()
    assert sum(r[2] for r in bins.rows) == sum(sizes) and len(bins.rows) < 1.5 * len(sizes)
    pieces = {}
    for doc, *_ in bins.rows:
        pieces[doc] = pieces.get(doc, 0) + 1
    assert sum(n == 1 for n in pieces.values()) > 0.7 * len(sizes)
    placed = sum(r[2] for r in bins.rows if r[5] >= 0)
    assert bins.sequences * packing.CAPACITY - placed <= packing.SLACK + packing.LEAST * bins.sequences
    assert packing.cut(4095) == [2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1] and packing.cut(0) == []


# --- fingerprints -----------------------------------------------------------


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("ranges", [1, 5])
def test_neighbours(table, ranges, request):
    df = request.getfixturevalue(table)
    got = fingerprints.compare_neighbours(df, ranges).collect()
    rows = texts_of(df)
    assert len(got) == len(rows)
    if table != "docs":
        return
    rows.sort(reverse=True)
    found = {r.doc_id: r for r in got}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(text) // 3
        edited, r = text[: len(text) - n] + after[:n], found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(fingerprints.Prefixes(text)) and r.edited_fingerprint == fingerprints.fingerprint(fingerprints.Prefixes(edited))
        same = next((k for k, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(len(text), len(edited)))
        assert r.common_prefix == same


def test_spans_and_extensions():
    a, b = fingerprints.Prefixes("xxabcabcabcyy"), fingerprints.Prefixes("abcabcz")
    for i in range(a.n):
        for j in range(b.n):
            want = 0
            while i + want < a.n and j + want < b.n and a.text[i + want] == b.text[j + want]:
                want += 1
            assert fingerprints.common_extension(a, i, b, j) == want
    assert a.span(2, 5) == a.span(5, 8) == b.span(0, 3) != b.span(1, 4)
    assert fingerprints.likeness(*[fingerprints.fingerprint(fingerprints.Prefixes(t)) for t in ("", "a")]) == 0.0


def test_likeness_estimates_jaccard():
    g = np.random.default_rng(1)
    text = "".join(g.choice(list("abcdefgh "), 6000))
    edited = text[:4000] + "".join(g.choice(list("abcdefgh "), 2000))
    marks = [fingerprints.fingerprint(fingerprints.Prefixes(t)) for t in (text, edited)]
    assert abs(fingerprints.likeness(*marks) - 0.5) < 0.3


def test_likeness_of_short_texts():
    """Texts of few characters whose last third is another's: alike by about half, as long ones are; others hardly."""
    g = np.random.default_rng(2)
    say = lambda n: "".join(g.choice(list("abcdefghijklmnop "), n))
    mark = lambda t: fingerprints.fingerprint(fingerprints.Prefixes(t))
    for n in (12, 20, 30, 38, 60, 94, 97, 200):
        near, far = [], []
        for _ in range(40):
            text, other = say(n), say(n + int(g.integers(0, 3)))
            near.append(fingerprints.likeness(mark(text), mark(fingerprints.edit(text, other))))
            far.append(fingerprints.likeness(mark(text), mark(other)))
        assert 0.3 < np.mean(near) < 0.65 and np.mean(far) < 0.1, n
    assert fingerprints.likeness(mark(say(95)), mark(say(400))) < 0.1


def test_span_hashes_are_power_sums():
    text, m = "añ\U0001f600bca", (1 << 31) - 1
    own = fingerprints.Prefixes(text)
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1):
            assert own.span(i, j) == tuple(sum((ord(c) + 1) * pow(b, k, m) for k, c in enumerate(text[i:j])) % m for b in fingerprints.BASES)


def test_rows_of_one_id_are_split(spark):
    """An id with most of the rows gets several ranges, and the order stays."""
    df = spark.createDataFrame([(None if i % 4 else i, f"text {i} " * 5) for i in range(400)], "doc_id long, text string")
    one, many = ({(r.doc_id, r.fingerprint): (r.edited_sha256, r.near_next) for r in fingerprints.compare_neighbours(df, n).collect()} for n in (1, 16))
    assert len(one) == 400 and one == many
    assert fingerprints.compare_neighbours(df, 16).selectExpr("spark_partition_id() AS p", "doc_id").filter("doc_id is null").select("p").distinct().count() > 4


# --- licences ---------------------------------------------------------------


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), places, ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_license_base(table, request):
    df = request.getfixturevalue(table)
    found = collected(licenses.scan_licenses(df))
    assert sum(map(len, found.values())) == df.count()
    for doc, text in texts_of(df):
        n, places, labels = base_places(text)
        assert any((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(places), min(places, default=None), max(places, default=None), labels) for r in found[doc])


def test_notices_with_edits():
    good = "x Licensed under the Apache License, Version 2.0 y"
    assert licenses.scan(good.encode())[5:8] == ("apache", 1.0, "apache:1:8:0")
    bad = "x Licenced under the Apache Lizense, Version 2.0 y"
    labels, score, spans = licenses.scan(bad.encode())[5:8]
    assert labels == "apache" and 0.8 < score < 1 and spans.startswith("apache:1:8:")
    assert licenses.scan("Cc-BY cc by\xa0CC. By all Rights_reserved all rights reserved".encode())[1:5] == (3, 0, 8, "cc-by,reserved")
    assert licenses.scan(b"the old license of the common words was granted")[5:8] == ("", 0.0, "")


@pytest.mark.parametrize("notice,label", licenses.NOTICES)
def test_seeds_find_every_candidate(notice, label):
    """Any occurrence within the edits allowed holds a seed unchanged."""
    g, edits = np.random.default_rng(3), len(notice) // licenses.CHARS_PER_EDIT
    for _ in range(20):
        text = list(notice)
        for _ in range(edits):
            i = int(g.integers(1, len(text) - 1))
            text[i] = "q"
        assert any(s.decode() in "".join(text) for _, s in licenses.seeds(notice))


def edited(g, notice, edits, letters, most=None):
    """``notice`` with so many edits inside."""
    text = list(notice)
    for _ in range(edits):
        i, op = int(g.integers(1, (most or len(text)) - 1)), int(g.integers(3))
        text[i : i + (op != 1)] = [] if op == 2 else [letters[int(g.integers(len(letters)))]]
    return "".join(text)


@pytest.mark.parametrize("text,labels", [
    ("Releesed under tha MIT licanse", "mit"), ("lisenced under the apache lisense version 2 o", "apache"), ("lisensed under cc by nc 4 O", "cc-by,cc-by-nc"),
    ("permision is hereby grantad free of charg to any persan obtaining a cpy of", "mit"), ("released under the m1t license", "mit"),
    # other licences' words are no misprints
    ("licensed under cc by sa 4 0", "cc-by,cc-by-sa"), ("licensed under cc by nd 4 0", "cc-by"), ("released under the bsd license", ""), ("released under the new license", ""),
    ("this source code form is subject to the terms of the eclipse public license", ""), ("under the terms of the gnu affero general public license", "gpl"),
])
def test_one_edit_for_ten_characters(text, labels):
    assert licenses.scan(f"some words {text} and more".encode())[5] == labels


def test_windows_hold_edits_of_many_bytes():
    """A notice that the bare pattern finds in the whole text is found in a window of it."""
    assert licenses.scan("all ri€ghts reserved".encode())[5] == "reserved"
    g = np.random.default_rng(5)
    for notice, label, edits, _, _, pattern in licenses._patterns():
        for k in range(40):
            # half of them have all edits ahead of the last seed
            bad = edited(g, notice, edits, "é€日\U0001f600", len(notice) * edits // (edits + 1) if k % 2 else None)
            text = f"日本語 words€ {bad} ünd mehr"
            m = pattern.search(text)
            off = sum(m.fuzzy_counts) if m else 0
            if m and not (off and any(x.fullmatch(m[0].strip()) for x in licenses._others(notice, off))):
                assert label in {x[0] for x in licenses.fuzzy(text.encode())}, text


def test_the_quick_test_of_windows_is_exact():
    g = np.random.default_rng(4)
    for notice, _, edits, _, places, pattern in licenses._patterns():
        for _ in range(30):
            text = f"a word {edited(g, notice, int(g.integers(edits + 3)), 'aeilrst m')} or two"
            assert licenses._holds(text, len(notice), places, edits) == bool(pattern.search(text))
