"""Operators that look across rows, against brute force, and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyard.llm import extraction, mixing, neardup, quality, urlrules

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_near_duplicates(docs):
    want = components([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_near_duplicates_of_a_larger_table(spark):
    """All pairs that share a shingle, compared in full: the same components, so every link is found."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets, holders, root = {d: shingles(t) for d, t in rows}, {}, {d: d for d, _ in rows}
    for d, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(d)
    near = {(a, b) for ids in holders.values() for i, a in enumerate(sorted(ids)) for b in sorted(ids)[i + 1 :]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [(a, b) for a, b in near if linked(sets[a], sets[b])]
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert len(links) > 50 and got == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_chains_and_groups(spark):
    """Chains link their ends; a group of pairs below the threshold stays apart."""
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 12):
        step = base.copy()
        for k in range(i):
            step[k * 10] = f"x{k}"
        rows.append((i, " ".join(step)))
    rows += [(100 + i, " ".join([f"g{j}" if j % 30 != i % 30 else f"h{i}" for j in range(90)])) for i in range(25)]
    rows += [(200 + i, " ".join(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == components(rows)
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(df).collect())
    assert kept == sorted({c for _, c in got.values()})


def test_pipeline_drops_copies_of_eighty_percent(spark, sf):
    """Pairs of Jaccard 0.815 (4 of 200 words changed) are links of the stage, those of 0.777 are none."""
    rows = []
    for i in range(60):
        text = [f"w{i}x{j}" for j in range(200)]
        rows.append((2 * i, " ".join(text)))
        for k in range(4 if i < 40 else 5):
            text[20 + 35 * k] = "other"
        rows.append((2 * i + 1, " ".join(text)))
    sets = dict((d, shingles(t)) for d, t in rows)
    near = [len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(60)]
    assert all(0.8 < x < 0.82 for x in near[:40]) and all(0.77 < x < 0.8 for x in near[40:])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, sf).collect())
    assert kept == sorted([2 * i for i in range(60)] + [2 * i + 1 for i in range(40, 60)])


def test_a_large_group_of_near_copies(spark):
    """600 copies of one text, each with some words replaced: links of a cloud, against brute force."""
    g = np.random.default_rng(9)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(600):
        text = base.copy()
        for k in g.choice(150, int(g.integers(0, 9)), replace=False):
            text[k] = f"x{g.integers(40)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == components(rows) and len({c for _, c in got.values()}) > 20


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    names = lambda x: int(x).to_bytes(4, "big")
    df = spark.createDataFrame([(names(a), names(b)) for a, b in edges], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in neardup.components(df).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}


def test_one_row_of_each_component(spark):
    """Null and repeated ids don't lose texts of other components, nor bring copies back."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c")), (3, text("c")),
        (5, text("d")), (5, text("e")), (4, text("e")), (6, text("f")), (6, text("f")), (None, ""), (None, " "), (7, None), (7, ""),
    ]
    for percent in (80, 85):
        got = [(r.doc_id, r.text) for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()]
        got = [x for x in got if x != (None, text("b") + " more")] + [(None, text("b")) for x in got if x == (None, text("b") + " more")]
        want = [(None, text("a")), (None, text("b")), (3, text("c")), (5, text("d")), (4, text("e")), (6, text("f")), (None, ""), (None, " "), (7, None), (7, "")]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text, 77, "a", 5, 6), (2, text, 88, "b", 7, 8), (3, "other words stand here and there today", 99, "c", 9, 10)], "doc_id long, text string, _id long, _mark string, own_id int, `a.b` int")
    assert sorted(tuple(r) for r in neardup.drop_near_duplicates(df).collect()) == [(1, text, 77, "a", 5, 6), (3, "other words stand here and there today", 99, "c", 9, 10)]


def test_candidate_settings_follow_the_threshold():
    assert neardup.settings(85) == (36, 8, 88)
    g = np.random.default_rng(2)
    for percent in (70, 80, 90):
        count, rows, differ = neardup.settings(percent)
        assert count * rows <= neardup.COORDINATES and (1 - (percent / 100) ** rows) ** count < 2e-5
        sets, offsets, half = [], [0], 400  # pairs of sets exactly at the threshold
        for _ in range(100):
            common, own = half * 2 * percent // 100, half * (100 - percent) // 100
            x = g.integers(1, 1 << 63, common + 2 * own, dtype=np.uint64)
            for part in (x[: common + own], np.concatenate((x[:common], x[common + own :]))):
                sets.append(part)
                offsets.append(offsets[-1] + len(part))
        best = neardup.signatures(np.concatenate(sets), np.array(offsets), neardup._table())
        planes = neardup.sketches(best).view(np.uint64)
        apart = planes[::2] ^ planes[1::2]
        apart = np.bitwise_count(apart[:, :8] | apart[:, 8:]).sum(1)
        assert apart.max() <= differ and abs(apart.mean() - 0.75 * (100 - percent) / 100 * neardup.COORDINATES) < 6
        values = neardup.bands(best, count, rows)
        assert (values[::2] == values[1::2]).any(1).all()


def test_near_duplicates_of_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and neardup.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert (by[0].n_shingles, by[0].component_id, by[1].kept, by[5].component_id, by[4].kept, by[5].kept) == (0, 0, True, 4, True, False)
    assert by[3].n_shingles == 1 and by[8].n_shingles == 1
    assert neardup.drop_near_duplicates(odd).columns == odd.columns


def test_mixing(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size = {d: len(re.findall(WORD, t or "")) for d, t, _ in rows}
    by = {}
    for d, _, s in rows:
        by[s] = by.get(s, 0) + size[d]
    target = water(by)
    got = mixing.sample(docs, ["doc_id", "source"]).collect()
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.copies <= 3
        whole = int(round(target[r.source] / by[r.source], 12))
        assert r.copies in (whole, whole + 1)
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    largest = {s: max(size[d] for d, _, x in rows if x == s) for s in by}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in by)
    again = mixing.sample(docs.repartition(3), ["doc_id"]).collect()
    assert {r.doc_id: r.copies for r in again} == {r.doc_id: r.copies for r in got}
    uneven = mixing.sample(docs, ["doc_id"], importance=mixing.by_length()).collect()
    assert mixing.mix(docs).count() == sum(r.copies for r in uneven)


def test_mixing_of_many_sources(docs, monkeypatch):
    few = {r.doc_id: (r.copies, r.target) for r in mixing.sample(docs, ["doc_id"]).collect()}
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert {r.doc_id: (r.copies, r.target) for r in mixing.sample(docs, ["doc_id"]).collect()} == few


def water(by):
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, float(sum(by.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * by[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = 3.0 * by[s]
            open_.remove(s)
        left -= sum(target[s] for s in full)
    return target


def test_mixing_caps_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * 50, "big") for i in range(20)] + [(100, "w w", "a"), (101, "w", "b"), (102, "w w w", None)]
    got = mixing.sample(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()
    by = {"big": 1000, "a": 2, "b": 1, None: 3}
    want = water(by)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6
    assert {r.doc_id: r.copies for r in got if r.doc_id >= 100} == {100: 3, 101: 3, 102: 3}
    assert mixing.sample(odd, odd.columns).count() == odd.count() and mixing.sample(none, ["doc_id"]).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_pareto_prefers_important_documents(spark):
    df = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    got = mixing.sample(df, ["doc_id"], importance=F.when(F.col("doc_id") < 200, 16.0).otherwise(1.0)).filter("source_size > target")
    low = got.filter("doc_id < 200").agg(F.sum("copies")).first()[0]
    assert low > 4 * got.filter("doc_id >= 200").agg(F.sum("copies")).first()[0]


def test_pareto_ranks_against_plain_python(docs):
    """Certain copies and ranks of each source, worked out in Python from the operator's random numbers."""
    drawn = mixing._drawn(docs, ["doc_id", "source"], mixing.WEIGHTS, 3, mixing.by_length(), 17).selectExpr("_k0 AS d", "_k1 AS s", "size", "u", "target", "copies").collect()
    by = {}
    for r in drawn:
        by.setdefault(r.s, []).append(r)
    levels = set()
    for rows in by.values():
        weight = {r.d: 2.0 ** (round(4 * np.log2(np.log2(r["size"] + 2))) / 4) for r in rows}
        low, high = 0.0, 1e6  # the level, by bisection
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(r["size"] * min(3, mid * weight[r.d]) for r in rows) < rows[0].target else (low, mid)
        share = {r.d: min(3.0, round(low * weight[r.d], 12)) for r in rows}
        left = rows[0].target - sum(int(share[r.d] + 1e-9) * r["size"] for r in rows)
        want = {r.d: int(share[r.d] + 1e-9) for r in rows}
        rank = lambda r: (r.u / (1 - r.u)) / ((share[r.d] % 1) / (1 - share[r.d] % 1))  # noqa: B023, E731
        for r in sorted((r for r in rows if 1e-9 < share[r.d] % 1 < 1 - 1e-9), key=rank):
            if left >= r["size"] / 2:
                want[r.d] += 1
            left -= r["size"]
        assert sum(want[r.d] != r.copies for r in rows) <= 1
        levels |= {round(x, 6) for x in share.values()}
    assert len(levels) > len(by)


def test_equal_rows_are_numbered(spark):
    rows = [(1, "a b c", "s")] * 50 + [(1, "a b c", "t")] * 30 + [(None, None, None)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    drawn = mixing._drawn(df, ["source"], mixing.WEIGHTS, 3, None, 17).selectExpr("_k0 AS s", "nth").collect()
    for source, n in (("s", 50), ("t", 30), (None, 20)):
        assert sorted(r.nth for r in drawn if r.s == source) == list(range(1, n + 1))


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    fold = {r.doc_id: r.held_out for r in got.collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in fold.items())
    held = got.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in held)
    assert len(held) > 50 and right / len(held) > 0.95
    one, zero = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert sum(a > b for a in one for b in zero) / (len(one) * len(zero)) > 0.97


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (3, 0, 0), (None, 1, 0), (7, None, 1), (99, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.judge(odd, labels.filter("false")).collect()} == {0.5}
    assert quality.judge(none, labels).count() == 0 and quality.keep_good(odd, labels).columns == odd.columns


def test_the_sample_is_bounded_by_passages(spark):
    """Whole documents in the order of their hashes, as many passages as asked for; one of more is not learnt from."""
    rows = [(i, "word " * (300 * (1 + i % 4))) for i in range(40)] + [(99, "word " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.Model.fit

    def spy(self, x, per_doc, y, **k):
        seen.append((len(x), per_doc.tolist()))
        return real(self, x, per_doc, y, epochs=2)

    quality.Model.fit = spy
    try:
        for most in (7, 30, 100_000):
            quality.fit(df, labels, most=most)
        assert quality.fit(df.filter("doc_id = 99"), labels, most=7) is None
    finally:
        quality.Model.fit = real
    assert seen[0][0] <= 7 < seen[1][0] <= 30 < seen[2][0] and max(seen[1][1]) < 30 < max(seen[2][1])


def test_attention_weighs_passages():
    import numpy as np

    g = np.random.default_rng(0)
    bags, y = [], []
    for i in range(300):  # one telling passage among five
        x = g.normal(0, 1, (5, quality.WIDTH))
        x[int(g.integers(5)), 0] += 6 * (i % 2)
        bags.append(x)
        y.append(i % 2)
    per = np.full(300, 5)
    model = quality.Model().fit(np.concatenate(bags), per, np.array(y, float))
    f = model.forward(np.concatenate(bags), per)
    assert ((f["score"] > 0.5) == np.array(y)).mean() > 0.95 and abs(f["a"].reshape(300, 5).sum(1) - 1).max() < 1e-9


# --- pages ------------------------------------------------------------------


PAGE = """<html><head><title>t</title></head><body><header>site</header><nav><a href=/>menu</a></nav><div class="cookie-notice">we use cookies, really, yes, we do use a lot of them</div>
<div id=wrap><div class="sidebar"><p>side text, that is long enough to count, with commas, many of them, indeed</p></div>{main}</div><form>mail <input></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("main,want", [
    ("<article><h1>Head</h1><p><b>First one,\n with &amp; sign<br><p>Second, of the paragraphs, is here.</p><script>var t='</p>';</script></article>", "Head First one, with & sign Second, of the paragraphs, is here."),
    ("<div><p>Some real prose, long enough to earn, and more prose.</p><p>Short.</p><p>Another paragraph of real prose, long enough.</p></div><div class='comments'><p>I disagree with this, very much, for many reasons.</p></div>", "Some real prose, long enough to earn, and more prose. Short. Another paragraph of real prose, long enough."),
    ("<main><section><p>Part one has words enough to score, I hope.</p></section><section><p>Part two too.</p></section><aside>ad</aside></main>", "Part one has words enough to score, I hope. Part two too."),
    ("<p>tiny</p>", "tiny"), ("", ""),
])
def test_main_text(main, want):
    assert extraction.main_text(PAGE.format(main=main)) == want


def plain_scores(html):
    """Points of each div by a plain reading of the rule, with the standard library's parser: (id, score) of the best."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.points, self.text, self.linked = [], {}, {}, {}

        def handle_starttag(self, tag, attrs):
            self.open.append([tag, dict(attrs).get("id"), ""])

        def handle_data(self, data):
            n = len(" ".join(data.split()))
            for i, x in enumerate(self.open):
                self.text[x[1]] = self.text.get(x[1], 0) + n
                self.linked[x[1]] = self.linked.get(x[1], 0) + n * any(y[0] == "a" for y in self.open)
                if x[0] == "p" and not any(y[0] == "p" for y in self.open[i + 1 :]):
                    x[2] += data

        def handle_endtag(self, tag):
            own = self.open.pop()
            n = len(" ".join(own[2].split()))
            if tag == "p" and n >= extraction.LEAST:
                for level, x in enumerate(reversed(self.open), 1):
                    self.points[x[1]] = self.points.get(x[1], 0) + (1 + own[2].count(",") + min(n // 100, 3)) / level

    reader = Reader()
    reader.feed(html)
    score = {k: p * (1 - reader.linked[k] / reader.text[k]) for k, p in reader.points.items() if k}
    return max(score, key=score.get), score


def test_scores_decide_without_tags_of_articles():
    """Pages of plain divs: the best container of a plain reading of the rule is the one that is kept."""
    g = np.random.default_rng(4)
    say = lambda n: " ".join("word" + "," * int(g.random() < 0.2) for _ in range(n))
    for _ in range(30):
        story = int(g.integers(3))
        parts = []
        for k in range(3):
            n = int(g.integers(4, 8)) if k == story else int(g.integers(1, 3))
            link = lambda x, k=k: x if k == story else f"<a href=/>{x}</a>"
            parts.append(f"<div id=w{k}><div id=c{k}>" + "".join(f"<p id=p{k}{i}>{link(say(int(g.integers(10, 60))))} P{k}</p>" for i in range(n)) + "</div></div>")
        html = "<html><body>" + "".join(parts) + "</body></html>"
        best, _ = plain_scores(html)
        text = extraction.main_text(html)
        assert best == f"c{story}" and all((f"P{k}" in text) == (k == story) for k in range(3))


def test_names_of_layouts_do_not_cost_the_story():
    story = "<p>A paragraph of the story, long enough to score, with commas.</p>" * 4
    assert extraction.main_text(f"<body><div class='layout has-sidebar'><div>{story}</div></div><div class=sidebar><p>Side words that are long enough, too.</p></div></body>").count("A paragraph") == 4
    assert extraction.main_text(f"<body><div>{story}</div><div class=comments>{story.replace('A paragraph', 'My view') * 3}</div></body>").count("My view") == 0


STORY = "<p>A paragraph of the story, long enough to score, with commas.</p>" * 3


@pytest.mark.parametrize("html,want", [
    ("<article><div class='entry-header'><h1>T</h1><p>Lead.</p></div>{s}</article>", "T Lead. S S S"),
    ("<article><div class='article-header'><h1>T</h1></div>{s}<p class='notice-board'>The notice board at the hall lists dates.</p></article>", "T S S S The notice board at the hall lists dates."),
    ("<div class='post'><div class='entry-header'><h1>T</h1></div>{s}</div>", "T S S S"),
    ("<article>{s}<ul><li><a href=1>Ref one</a></li><li><a href=2>Ref two</a></li><li><a href=3>Ref three</a></li></ul></article>", "S S S Ref one Ref two Ref three"),
    ("<main><ul><li><a>Home</a></li><li><a>News</a></li><li><a>More</a></li></ul>{s}</main>", "S S S"),
    ("<div class='post-comments-enabled'>{s}</div>", "S S S"),
    ("<div class='page-header'><h1>Site</h1></div><div class='post'>{s}</div>", "S S S"),
    ("<article>{s}<div class='notice'>We use cookies, a lot of them, on all of these pages, and on others.</div><div class='post-comments'><p>I disagree, for many reasons, all the same.</p></div><div class='cookie-notice'>Cookies, yes, cookies here, and there.</div></article>", "S S S"),
    ("<article>{s}<header class='related'><h2>More</h2></header><div class='ad-slot'>Buy this, now, here, today, and pay less than ever before.</div></article>", "S S S"),
])
def test_names_that_stories_use_too(html, want):
    """Title blocks, notice paragraphs and closing references stay; notices, adverts, comments and menus go."""
    assert extraction.main_text(f"<body>{html.format(s=STORY)}</body>").replace("A paragraph of the story, long enough to score, with commas.", "S") == want


def test_sibling_articles_are_kept():
    one, two = "Part one of the story, with words enough to score.", "Part two of the story, with words enough to score, too."
    main = f"<main><article><p>{one}</p></article><article><p>{two}</p></article><article><a href=/>A teaser that is long enough, but links.</a></article></main>"
    assert extraction.main_text(PAGE.format(main=main)) == f"{one} {two}"


def test_extraction_of_odd_pages(spark, sf):
    deep = "<div>" * 3000 + "<p>The deepest paragraph, which is long enough, stands here.</p>"
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 5), (3, "u", "no tags, but text &lt;x&gt;", 5), (4, "u", deep, 5), (4, "u", deep, 5), (None, "u", "<p" * 50, 5), (6, "u", "<!-- open <p>x", 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extraction.extract(df).collect()))
    assert [x[1] for x in got if x[0] == 3] == ["no tags, but text <x>"] and [x[2] for x in got if x[0] in (1, 2)] == [0, 0]
    assert [x[1] for x in got if x[0] == 4] == ["The deepest paragraph, which is long enough, stands here."] * 2
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in extraction.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        import html

        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]*>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_url_rules(spark, sf):
    odd = ["http://A.Example.COM/en/7x?y", "https://net/de/", "x://example.net/de/8#q", "http://b.org/es/1", None, "", "nohost/en/", "http://", "http://com", "http://notcom/en/", "a://b://c.com/en/", "http://ecom/en/1", "http://x.com?/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(odd)] + [(0, odd[0])], "page_id long, url string").unionByName(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").withColumn("page_id", F.col("page_id") + 1000))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.page_id: r.url for r in df.collect()}
    got = urlrules.judge(df.withColumn("rule", F.lit(1)).withColumn("key", F.lit(2)), labels).collect()
    assert len(got) == df.count()
    for r in got:
        host, path, rule, verdict = judged(want[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert urlrules.judge(df.filter("false"), labels).count() == 0


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}.site{i % 3}.example.uk/{'win' if i % 8 == 0 else 'news'}/{i}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(0, 800)], "doc_id long, quality int, toxic int")
    mined = [tuple(r.rule) for r in urlrules.learn(pages, labels)[0].collect()]
    assert ("h:bad",) in mined and all("h:bad" not in m or m == ("h:bad",) for m in mined)
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 4 == 0) for i, _ in rows)


def test_mined_rules_against_enumeration(spark):
    """All token sets of labelled pages, counted in Python."""
    from itertools import combinations

    g = np.random.default_rng(8)
    rows = [(i, f"http://{g.choice(['a', 'b', 'c'])}.x/{g.choice(['k', 'l'])}/{g.choice(['m', 'n'])}?{g.choice(['p', 'q'])}=1#{i}") for i in range(600)]
    bad = {i: int(("//a." in u and "/k/" in u) or g.random() < 0.1) for i, u in rows}
    pages = spark.createDataFrame([(i, u.replace("#", f"&z=#").replace("/m?", f"/m/{i}?").replace("/n?", f"/n/{i}?")) for i, u in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", urlrules.tokens_of(F.col("url")).alias("t")).collect()}
    base, found = sum(bad.values()) / len(bad), {}
    for size in (1, 2, 3, 4):
        for rule in combinations(sorted(frozenset().union(*tokens.values())), size):
            hit = [bad[i] for i, t in tokens.items() if t.issuperset(rule)]
            if sum(hit) >= 20 and sum(hit) / len(hit) >= urlrules.CONFIDENCE and sum(hit) / len(hit) / base >= urlrules.LIFT:
                found[rule] = sum(hit) / len(hit)
    want = {r for r, c in found.items() if not any(set(x) < set(r) and found[x] >= c for x in found)}
    rules, alike = urlrules.mine(urlrules.labelled(pages, labels))
    first = {r.member: r.token for r in alike.collect()}
    stand = {}  # tokens of the same pages are one to the rules
    for t in frozenset().union(*tokens.values()):
        stand.setdefault(frozenset(i for i, own in tokens.items() if t in own), set()).add(t)
    assert all(len({first[t] for t in same if t in first}) <= 1 for same in stand.values()) and all(first[t] in same for same in stand.values() for t in same if t in first)
    got = {tuple(r.rule): r.confidence for r in rules.collect()}
    merged = {tuple(sorted({first[t] for t in rule})): rule for rule in want}
    assert want and {r for r in got if len(r) <= 4} == set(merged) and all(abs(got[r] - found[merged[r]]) < 1e-9 for r in merged)


def test_rules_must_hold_on_pages_held_out(spark):
    """Labels that don't depend on urls give no rule; a rule of the mined pages that fails on the others falls."""
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.uk/{'a' if i % 2 else 'b'}/{i}") for i in range(1200)], "page_id long, url string")
    g = np.random.default_rng(6)
    labels = spark.createDataFrame([(i, int(g.random() < 0.7), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    assert urlrules.learn(pages, labels)[0].count() == 0
    marked = urlrules.labelled(pages, labels).withColumn("bad", (F.array_contains("tokens", "h:h1") & ~F.col("held")).cast("int"))
    rules, alike = urlrules.mine(marked.filter("not held").select("tokens", "bad"))
    assert rules.count() > 0 and urlrules.hold(rules, alike, marked.filter("held")).count() == 0
    good = marked.withColumn("bad", F.array_contains("tokens", "h:h1").cast("int"))
    assert urlrules.hold(rules, alike, good.filter("held")).count() == rules.count()


def test_sets_that_hold_a_token_of_the_same_pages(spark):
    """A rule's token also matches by any token that stood on the same labelled pages."""
    rules = spark.createDataFrame([(["a", "x"], 0.9)], "rule array<string>, confidence double")
    alike = spark.createDataFrame([("a", "a"), ("a", "b"), ("x", "x")], "token string, member string")
    sets = spark.createDataFrame([(1, ["b", "x"]), (2, ["a", "b", "x", "y"]), (3, ["b"]), (4, ["x", "y"])], "key long, tokens array<string>")
    assert sorted(r.key for r in urlrules.matched(urlrules.represented(sets, alike), rules).collect()) == [1, 2]


def test_mined_rules_judge_the_given_pages(spark):
    """What the rules block among the pages that no fixed rule fits is worse on held-out labels, or no rule has survived."""
    sf = "/root/testdata/sf0.1"
    pages, labels = spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = urlrules.judge(pages, labels).filter("rule is null")
    marked = urlrules.labelled(pages, labels).filter("held").withColumn("key", F.xxhash64("tokens"))
    blocked = got.filter("verdict = 'block'").join(pages, "page_id").select(F.xxhash64(urlrules.tokens_of(F.col("url"))).alias("key")).distinct()
    share = lambda x: (x.agg(F.avg("bad")).first()[0] or 0.0)
    assert blocked.count() == urlrules.learn(pages, labels)[0].count() == 0 or share(marked.join(blocked, "key", "left_semi")) > 1.2 * share(marked.join(blocked, "key", "left_anti"))


def test_rules_of_deep_tokens(spark):
    """Segments beyond the eighth and suffixes of more than four labels are mined and matched."""
    deep = "/".join("abcdefghi")
    rows = [(i, f"http://site.example.uk/{deep}/{'win' if i % 4 == 0 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 4 == 0) for i, _ in rows)
    tokens = spark.createDataFrame([("http://a.b.c.d.e.f/",)], "url string").select(urlrules.tokens_of(F.col("url")).alias("t")).first().t
    assert {"d:b.c.d.e.f", "d:a.b.c.d.e.f"} <= set(tokens)


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, sf, docs):
    out = corpus_pipeline.run(spark, sf).collect()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = corpus_pipeline.good_quality(spark, docs, sf)
    assert good.columns == docs.columns
    kept = components([(r.doc_id, r.text) for r in good.collect()])
    unique = {c for _, c in kept.values()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert out and {r.doc_id for r in out} <= unique and len({r.doc_id for r in out} & bad) <= 0.1 * max(1, len(bad))
    assert max(r.sequence_id for r in out) + 1 <= 1.02 * sum(r.length for r in out) / 4096 + 10


def test_quality_keeps_all_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    named = odd.withColumn("_score", F.lit(1)).withColumn("_text", F.lit("x"))
    assert quality.keep_good(named, labels).count() == odd.count()
    some = spark.createDataFrame([(4, 1, 0), (7, 0, 0)], labels.schema)
    assert quality.keep_good(named, some).columns == named.columns


def test_pipeline_of_odd_rows(spark, odd, sf):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        stage(spark, docs.filter("false"), sf).count()
    assert corpus_pipeline.packed(spark, docs, sf).count() > 0
