"""Shop pages, JSON inputs, exports and the stream."""

from pyspark.sql import functions as F

from tallyard.plans.inputs import read
from tallyard.sources import elements, json_tables, sinks
from tallyard.streaming import progress

LIST_A = """<ul>
<li><input name="inPcheck" id="inPcheck" value="101"><a class="pLink" href="/product/view.html?qIDX=101"><img alt="alt"></a><div class="m_pdt_list_name">[산리오] 볼펜 10개 바로가기</div>
<a id="btn_addCart"></a><input name="inPcount" id="inPcount"><input name="inMaxStock" id="inMaxStock" value="7">
<li><input name="inPcheck" id="inPcheck" value="102"><a class="pLink" href="/product/view.html?qIDX=102"><img alt="컵 이름"></a><div class="soldout_bg"></div><a id="btn_addCart"></a><input name="inPcount" id="inPcount">
<li><input name="inPcheck" id="inPcheck" value=""></ul><input name="inPcheck" id="inPcheck" value="103"><p id="ProductCount">1,234</p>"""
LIST_B = """<div class="goods_list_cont"><div class="item_cont"><a href="goods_view.php?goodsNo=9">x</a></div></div>
<div class="goods_list"><div class="goods_pick_list"></div><div class="goods_list_cont"><ul>
<li><div class="item_cont"><div class="item_photo_box"><img data-src="/i.jpg" alt="z"></div><a href="/goods/goods_view.php?goodsNo=5"><span class="item_name">도시락 케이스</span></a><b class="item_price">판매가 12,900원</b></div></li>
<li><div class="item_cont"><a href="/goods/goods_view.php?goodsNo=6"><span class="item_name">b</span></a></div><span class="item_soldout">x</span></li></ul></div></div>
<div class="pagination"><a href="?page=3">3</a><a href="?page=12">last</a></div>"""
CART = """<table id="cartTable"><tr class="tr-nth"><td><input name="cartCheck" id="cartCheck" value="c1"><a href="/product/view.html?qIDX=77">p</a><div class="product_dsc"><a class="c">이름 바로가기</a></div>
<span class="dtfont-pd">상품번호[77] 8801234567890</span><ul class="option_list"><li>red</li><li>L</li></ul><input name="num01" id="inPcount" value="30"><input name="inMaxStock" id="inMaxStock" value="20">
<input id="inOnePrice" value="1,000"><input id="inBoxPrice" value="800"><div id="msgDiv">ok</div></td></tr></table>"""
DETAIL_A = """<div id="productView"><b id="navCateTit1">A</b><div class="info_wrap"><p class="pdt_name"><span>연필 12개 1세트</span></p></div><div class="pdt-top-info"><i class="info-number">55</i><i class="info-number">8800000000000</i><i class="inbox">20 EA</i></div>
<div id="tab_01"><div class="info" alt="제품상세정보"><table><tr><th>소재</th><td>면</td><th>무게</th><td>1g</td></tr><tr><th>소재</th><td>나무</td></tr></table></div><div id="viewContent"><img src="/a.jpg"><img data-src="/b.jpg" src="data:x"></div></div>
<table><tr><th>입고비</th><td>100</td></tr></table><input type="checkbox" value="opt" disabled></div>"""
DETAIL_B = """<div class="location_tit"><span>홈</span><span>문구</span></div><div class="item_info_box"><div class="item_detail_tit"><h3>공책 3개</h3></div><dl><dt>판매가</dt><dd>1,500원</dd></dl><dl><dt>브랜드</dt><dd>톰보</dd></dl><dl><dt>박스구성</dt><dd>24개입</dd></dl></div>
<div class="item_photo_slide"><img src="/m.jpg"></div>"""


def els(spark, html):
    return elements.elements(spark.createDataFrame([(1, html), (2, None)], "page int, html string")).cache()


def test_lists(spark):
    e = els(spark, LIST_A)
    found = {r.productId: r for r in elements.list_products_a(e, ["page"]).collect()}
    assert set(found) == {"101", "102"}
    r = found["101"]
    assert (r.productName, r.productUrl, r.cartAddable, r.listMaxStock, r.saleStatus, r.brandHint) == ("[산리오] 볼펜 10개", "https://mall-a.example/product/view.html?qIDX=101", True, "7", "ON_SALE", "산리오")
    assert (found["102"].productName, found["102"].isSoldOut, found["102"].saleStatus) == ("컵 이름", True, "SOLD_OUT")
    assert [r.totalCount for r in elements.total_count(e, ["page"]).collect()] == [1234]
    e = els(spark, LIST_B)
    found = {r.productId: r for r in elements.list_products_b(e, ["page"]).collect()}
    assert set(found) == {"5", "6"}
    assert (found["5"].price, found["5"].isSoldOut, found["5"].imageUrl, found["5"].categoryHint) == (12900, False, "https://mall-b.example/i.jpg", "수납/정리")
    assert found["6"].isSoldOut
    assert [r.linkedLast for r in elements.linked_last_page(e, ["page"]).collect()] == [12]


def test_cart(spark):
    r = elements.cart_rows_a(els(spark, CART), ["page"]).first()
    assert (r.productId, r.barcode, r.productName, r.optionText, r.requestedQty, r.maxStock, r.stockLimited, r.stockStatus) == ("77", "8801234567890", "이름", "red / L", 30, 20, True, "LIMITED")
    assert (r.effectivePrice, r.hasBoxDiscount, r.cartCheckId) == (800, True, "c1")
    b = elements.cart_rows_b(els(spark, '<table><tr><td><a href="/g.php?goodsNo=4">a</a><a href="/g.php?goodsNo=4">b</a><p class="item_name">n</p><input name="goodsCnt[]" value="3"></td></tr></table>'), ["page"]).collect()
    assert [(x.productId, x.productName, x.quantity) for x in b] == [("4", "n", 3)]


def test_details(spark):
    r = elements.details_a(els(spark, DETAIL_A), ["page"]).first()
    assert (r.productNo, r.barcode, r.productName, r.outerBoxQty, r.material, r.weight, r.categoryDepth1) == ("55", "8800000000000", "연필 12개 1세트", 20, "나무", "1g", "A")
    assert [(x.labelKo, x.valueKo, x.sortOrder) for x in r.specRows] == [("소재", "면", 0), ("무게", "1g", 10)]
    assert r.introImageUrls == ["https://mall-a.example/a.jpg", "https://mall-a.example/b.jpg"]
    assert [(x.key, x.value) for x in r.my3pl] == [("입고비", "100")]
    assert [(x.name, x.disabled) for x in r.detailOptions] == [("opt", True)]
    r = elements.details_b(els(spark, DETAIL_B), ["page"]).first()
    assert (r.productName, r.salePrice, r.brandHint, r.outerBoxQty, r.categoryDepth1, r.mainImageUrls) == ("공책 3개", 1500, "톰보", 24, "문구", ["https://mall-b.example/m.jpg"])
    assert [(x.labelKo, x.valueJa, x.sortOrder) for x in r.specRows] == [("박스구성", "24개입", 0)]


def test_specs_without_values(spark):
    pairs = spark.createDataFrame([(1, "a", ""), (2, "판매가", "9"), (3, "b", "x"), (4, "a", "y"), (5, "b", ""), (6, "가격", "z")], "ord int, key string, value string").withColumn("page", F.lit(1))
    of = lambda df: [(x.labelKo, x.valueKo, x.sortOrder) for x in df.first().specRows]
    assert of(elements.spec_rows(pairs, ["page"])) == [("판매가", "9", 0), ("b", "x", 10), ("a", "y", 20), ("가격", "z", 30)]
    assert of(elements.spec_rows_of_map(pairs, ["page"])) == [("a", "y", 0), ("가격", "z", 20)]


def test_json_inputs(spark):
    df = spark.createDataFrame([(1, '﻿[{"id":"a","n":1}]'), (2, '{"products":[{"id":"b"}]}'), (3, "no")], "doc int, json string")
    assert sorted((r.doc, r.id, r.n) for r in json_tables.items(df, {"id": "string", "n": "int"}).collect()) == [(1, "a", 1), (2, "b", None)]
    df = spark.createDataFrame([('{"products":{"1":{"id":"1","nameKo":"x"}}}',), ('{"2":{"id":"2"}}',)], "json string")
    assert sorted(r.id for r in json_tables.archive(df).collect()) == ["1", "2"]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5, "-5", 'a"b', None)], "a string, b int, c string, d string, e string")
    assert sinks.csv_lines(df, ["a", "b", "c", "d", "e"]).first().line == "\"'=1+1\",\"-5\",\"'-5\",\"a\"\"b\",\"\""
    sinks.write_csv(df, f"{tmp_path}/out", ["a", "b"], single=True)
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert files[0].read_text(encoding="utf-8").splitlines() == ["﻿a,b", "\"'=1+1\",\"-5\""]


def test_stream_equals_batch(spark, sf, tmp_path):
    query = progress.stream_state(spark, sf, str(tmp_path / "state"), "progress_rows")
    query.awaitTermination()
    batch = progress.fold(progress.patches(read(spark, sf, "events")), "user_id", ["ts", "event_id"], progress.FIELDS)
    assert sorted(map(tuple, spark.table("progress_rows").collect())) == sorted(map(tuple, batch.collect()))


def test_elements_text(spark):
    e = els(spark, "<p>a<b> b</p><p>c &amp; d<br>e<script>x</script>")
    assert [r.text for r in e.filter("tag = 'p'").orderBy("pos").collect()] == ["a b", "c & d" + "e"]
    assert e.filter(F.col("page") == 2).count() == 0


def test_run_folder(spark, tmp_path):
    rows = spark.createDataFrame([("1", None)], "productId string, name string")
    sinks.write_run({"products": rows, "warnings": rows.limit(0)}, str(tmp_path), "mall-a", "r1")
    assert spark.read.json(f"{tmp_path}/mall-a/r1/products").count() == 1
    assert (tmp_path / "mall-a" / "r1" / "warnings" / "_SUCCESS").exists()


def test_scheduled_batches_see_new_rows_once(spark, tmp_path):
    source, seen = tmp_path / "in", []
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        progress.scheduled(stream, lambda batch, i: seen.append((i, batch.count())), str(tmp_path / "state")).awaitTermination()
    assert seen == [(0, 3), (1, 2)]


def test_references_without_end_stay(spark):
    pages = spark.createDataFrame([(1, '<title>a &amp;&lt;b&#x27; &amp</title><a href="?x=1&b=2">c</a>')], "page int, html string").withColumn("html", elements.ended_references(F.col("html")))
    found = {r.tag: (r.text, r.attrs) for r in elements.elements(pages).collect()}
    assert found["title"][0] == "a &<b' &amp" and found["a"][1] == {"href": "?x=1&b=2"}


def test_readers_gather_no_elements_at_the_driver(spark):
    pages = spark.createDataFrame([(1, LIST_A)], "page int, html string")
    for read in (elements.list_products_a, elements.list_products_b, elements.cart_rows_a, elements.cart_rows_b, elements.details_a, elements.details_b):
        plan = read(elements.elements(pages), ["page"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, read.__name__


def test_lines_without_known_fields(spark):
    rows = elements.cart_rows_a(els(spark, '<table id="cartTable"><tr class="tr-nth"><td><b>x</b></td></tr><tr class="tr-nth"></tr></table><table><tr class="tr-nth"><td>y</td></tr></table>'), ["page"])
    assert [(r["index"], r.productId, r.hasOption) for r in rows.collect()] == [(1, "", False)]


def test_element_columns_of_odd_markup(spark):
    """Flat columns cut into lists: void and closed elements, scripts, repeated attributes, pages without elements between others."""
    pages = spark.createDataFrame([(1, '<li id="a b" class="x  y">p<br>q<li>r</li><script>s</script>t'), (2, None), (3, "u"), (4, '<i a=1 a=2 B><b/></i>')], "page int, html string").coalesce(1)
    got = [(r.page, r.pos, r["last"], r.tag, r.id, r.classes, r.attrs, r.text, r.up, r.path) for r in elements.elements(pages).orderBy("page", "pos").collect()]
    assert got == [
        (1, 0, 1, "li", "a b", ["x", "y"], {"id": "a b", "class": "x  y"}, "pq", [], []), (1, 1, 1, "br", "", [], {}, "", [0], [" li #a_b .x .y "]), (1, 2, 2, "li", "", [], {}, "r", [], []), (1, 3, 3, "script", "", [], {}, "", [], []),
        (4, 0, 1, "i", "", [], {"a": "2", "b": ""}, "", [], []), (4, 1, 1, "b", "", [], {}, "", [0], [" i # "]),
    ]
