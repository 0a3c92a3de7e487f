"""Stored shop pages made from the part table, read back by the page readers, with DuckDB SQL of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.plans.catalogue import query, read
from tallyard.sources import elements
from tallyard.sources.shared import dealt


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _size() -> Column:
    return F.col("p_size")


def _html(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _when(test: Column, html: str) -> Column:
    return F.when(test, html).otherwise("")


def _lists(spark, sf_dir, item: Column, before: str, after: Column) -> DataFrame:
    """Elements of list pages of twenty parts each."""
    rows = read(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 20)).withColumn("item", item)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))), lambda x: x["item"]), "")
    pages = dealt(rows, "page").groupBy("page").agg(items.alias("items")).select("page", F.concat(F.lit(before), "items", after).alias("html"))
    return elements.stored_elements(pages)


def _single(spark, sf_dir, html: Column) -> DataFrame:
    """Elements of one page for each part; few blocks hold all parts, so these are dealt out ahead of the work."""
    return elements.stored_elements(dealt(read(spark, sf_dir, "part"), "p_partkey").select("p_partkey", html.alias("html")))


def _list_a(spark, sf_dir):
    item = _html(
        '<li><input name="inPcheck" id="inPcheck" value="', _key(), '"><a class="pLink" href="/product/view.html?qIDX=', _key(), '"><img alt="', F.col("p_type"), '"></a>',
        F.when(_size() % 4 != 0, _html('<div class="m_pdt_list_name"> ', F.col("p_name"), "  바로가기</div>")).otherwise(""), _when(_size() % 5 == 0, '<div class="soldout_bg"></div>'),
        _when(_size() % 3 != 0, '<a id="btn_addCart"></a>'), '<input name="inPcount" id="inPcount"><input name="inMaxStock" id="inMaxStock" value="', _size(), '">',
    )
    counter = F.when(F.col("page") % 2 == 0, _html('<p id="ProductCount">', F.format_number(F.col("page") + 1000, 0), "</p>")).otherwise(_html("<p>전체 ", F.col("page"), " 개의 상품</p>"))
    last = F.when(F.col("page") % 3 != 0, _html('<div class="pagination"><a href="/list?page=', F.col("page"), '">1</a><a onclick="go(\'', F.col("page") + 7, '\')">last</a></div><a href="?page=999999">x</a>')).otherwise("")
    user = F.when(F.col("page") % 5 == 0, '<a href="/member/logout.html">out</a>').otherwise('<a href="/member/login.html">in</a>')
    return _lists(spark, sf_dir, item, '<body><ul><li><input name="inPcheck" id="inPcheck" value=""></li>', F.concat(F.lit("</ul>"), counter, last, user))


@query("list_pages_a", """SELECT p_partkey // 20 AS page, CAST(p_partkey AS VARCHAR) AS productId, CASE WHEN p_size % 4 <> 0 THEN p_name ELSE p_type END AS productName,
  'https://mall-a.example/product/view.html?qIDX=' || p_partkey AS productUrl, p_size % 5 = 0 AS isSoldOut, p_size % 3 <> 0 AS hasAddButton, p_size % 5 <> 0 AND p_size % 3 <> 0 AS cartAddable,
  CAST(p_size AS VARCHAR) AS listMaxStock, CASE WHEN p_size % 5 <> 0 AND p_size % 3 <> 0 THEN 'ON_SALE' ELSE 'SOLD_OUT' END AS saleStatus FROM part""")
def list_pages_a(spark, sf_dir):
    found = elements.list_products_a(_list_a(spark, sf_dir), ["page"])
    return found.select("page", "productId", "productName", "productUrl", "isSoldOut", "hasAddButton", "cartAddable", "listMaxStock", "saleStatus")


@query("list_page_counts", """SELECT page, CASE WHEN page % 2 = 0 THEN 1000 + page ELSE page END AS totalCount, CASE WHEN page % 3 <> 0 THEN (page + 7)::INTEGER END AS linkedLast, page % 5 = 0 AS loggedIn
  FROM (SELECT DISTINCT p_partkey // 20 AS page FROM part)""")
def list_page_counts(spark, sf_dir):
    els, keys = _list_a(spark, sf_dir), ["page"]
    return elements.total_count(els, keys).join(elements.linked_last_page(els, keys), keys).join(elements.logged_in(els, keys), keys)


@query("list_pages_b", """SELECT p_partkey // 20 AS page, CAST(p_partkey AS VARCHAR) AS productId, p_name AS productName, 'https://mall-b.example/goods/goods_view.php?goodsNo=' || p_partkey AS productUrl,
  'https://mall-b.example/i' || p_partkey || '.jpg' AS imageUrl, p_size * 1000 + 900 AS price, p_size % 5 = 0 OR p_size % 7 = 0 AS isSoldOut FROM part""")
def list_pages_b(spark, sf_dir):
    item = _html(
        '<li><div class="item_cont', _when(_size() % 7 == 0, " item_soldout"), '"><div class="photo"><img ', F.when(_size() % 2 == 0, "data-src").otherwise("src"), '="/i', _key(), '.jpg" alt="z"></div><a href="/goods/goods_view.php?goodsNo=', _key(),
        '"><span class="item_name">', F.col("p_name"), ' 바로가기</span></a><b class="item_price">판매가 ', _size(), ",900원</b></div>", _when(_size() % 5 == 0, '<span class="item_soldout">x</span>'), "</li>",
    )
    other = '<div class="goods_list_cont"><div class="item_cont"><a href="goods_view.php?goodsNo=999999999">x</a></div></div>'
    els = _lists(spark, sf_dir, item, other + '<div class="goods_list"><div class="goods_pick_list"></div><div class="goods_list_cont"><ul>', F.lit("</ul></div></div>" + other))
    return elements.list_products_b(els, ["page"]).select("page", "productId", "productName", "productUrl", "imageUrl", F.col("price").cast("bigint").alias("price"), "isSoldOut")


@query("cart_pages_a", """SELECT p_partkey, 'c' || p_partkey AS cartCheckId, CAST(p_partkey AS VARCHAR) AS productId, '8801234' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS barcode, p_name AS productName,
    CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || ' / L' END AS optionText, p_size % 3 <> 0 AS hasOption, p_size::BIGINT AS requestedQty, 20::BIGINT AS maxStock, p_size > 20 OR p_size % 4 = 0 AS stockLimited,
    CASE WHEN p_size > 20 OR p_size % 4 = 0 THEN 'LIMITED' ELSE 'IN_STOCK' END AS stockStatus, CASE WHEN p_size % 2 = 0 THEN p_size * 100 ELSE 1000 + p_size END::BIGINT AS effectivePrice,
    p_size % 2 = 0 AND p_size * 100 < 1000 + p_size AS hasBoxDiscount FROM part""")
def cart_pages_a(spark, sf_dir):
    html = _html(
        '<table id="cartTable"><tr><td>head</td></tr><tr class="tr-nth"><td><input name="cartCheck" id="cartCheck" value="c', _key(), '">', F.when(_size() % 6 != 0, _html('<a href="/product/view.html?qIDX=', _key(), '">p</a>')).otherwise(""),
        '<div class="product_dsc"><a class="c">', F.col("p_name"), ' 바로가기</a></div><span class="dtfont-pd">상품번호[', _key(), "] 8801234", F.lpad(_key(), 6, "0"), "</span>",
        F.when(_size() % 3 != 0, _html('<ul class="option_list"><li>', F.col("p_type"), "</li><li> </li><li>L</li></ul>")).otherwise(""), '<input name="num01" id="inPcount" value="', _size(), '"><input name="inMaxStock" id="inMaxStock" value="20">',
        '<input id="inOnePrice" value="', F.lit("1,0"), F.lpad(_size().cast("string"), 2, "0"), '"><input id="inBoxPrice" value="', F.when(_size() % 2 == 0, _size() * 100).otherwise(0), '"><div id="msgDiv">', _when(_size() % 4 == 0, "주문가능하신 상품"), "</div></td></tr></table>",
    )
    rows = elements.cart_rows_a(_single(spark, sf_dir, html), ["p_partkey"])
    return rows.select("p_partkey", "cartCheckId", "productId", "barcode", "productName", "optionText", "hasOption", "requestedQty", "maxStock", "stockLimited", "stockStatus", "effectivePrice", "hasBoxDiscount")


@query("cart_pages_b", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS productId, 'https://mall-b.example/goods/goods_view.php?goodsNo=' || p_partkey AS productUrl, p_name AS productName, p_size::BIGINT AS quantity FROM part")
def cart_pages_b(spark, sf_dir):
    link = _html('<a href="/goods/goods_view.php?goodsNo=', _key(), '">a</a>')
    html = _html("<table><tr><td>", link, link, '<p class="item_name">', F.col("p_name"), '</p><input name="goodsCnt[]" value="', _size(), '"></td></tr></table><a href="goods_view.php?goodsNo=999999999">outside</a>')
    return elements.cart_rows_b(_single(spark, sf_dir, html), ["p_partkey"]).select("p_partkey", "productId", "productUrl", "productName", F.col("quantity").cast("bigint").alias("quantity"))


@query("detail_pages_a", """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS productNo, lpad(CAST(p_partkey AS VARCHAR), 13, '8') AS barcode, p_name AS productName, p_brand AS categoryDepth1, p_size AS outerBoxQty,
    (p_size * 100)::BIGINT AS consumerPrice, CASE WHEN p_size % 2 = 0 THEN 'wood' ELSE p_type END AS material, p_size || 'g' AS weight, '소재=' || p_type || '@0,무게=' || p_size || 'g@10' AS specs,
    CASE WHEN p_size % 3 = 0 THEN '입고비=' || p_size END AS fees, CASE WHEN p_size % 5 = 0 THEN '1:red:true' ELSE '1:red:false' END || ',2:blue:false' AS options,
    'https://mall-a.example/a' || p_partkey || '.jpg,https://cdn.example/b.jpg' AS images FROM part""")
def detail_pages_a(spark, sf_dir):
    html = _html(
        '<div id="productView"><b id="navCateTit1">', F.col("p_brand"), '</b><p class="pdt_name"><span>', F.col("p_name"), '</span></p><p class="pdt_code_last"><strong>', _size(), '00원</strong></p><div class="pdt-top-info"><i class="info-number">', _key(),
        '</i><i class="info-number">', F.lpad(_key(), 13, "8"), '</i><i class="inbox">', _size(), ' EA</i></div><div class="info" alt="제품상세정보"><table><tr><th>소재</th><td>', F.col("p_type"), "</td><th>무게</th><td>", _size(), "g</td></tr>",
        _when(_size() % 2 == 0, "<tr><th>소재</th><td>wood</td></tr>"), '</table></div><div id="viewContent"><img src="/a', _key(), '.jpg"><img data-src="//cdn.example/b.jpg" src="data:x"><img src="/a', _key(), '.jpg"><img src="/img/blank.gif"></div>',
        F.when(_size() % 3 == 0, _html("<table><tr><th>입고비</th><td>", _size(), "</td></tr></table>")).otherwise(""), '<input type="checkbox" value="red"', _when(_size() % 5 == 0, " disabled"), '><input type="radio" data-name="blue" value="v"></div>',
    )
    found = elements.details_a(_single(spark, sf_dir, html), ["p_partkey"])
    spec = F.transform("specRows", lambda s: F.concat(s["labelKo"], F.lit("="), s["valueKo"], F.lit("@"), s["sortOrder"].cast("string")))
    option = F.transform("detailOptions", lambda o: F.concat_ws(":", o["index"].cast("string"), o["name"], o["disabled"].cast("string")))
    fees = F.transform("my3pl", lambda x: F.concat_ws("=", x["key"], x["value"]))
    return found.select(
        "p_partkey", "productNo", "barcode", "productName", "categoryDepth1", "outerBoxQty", "consumerPrice", "material", "weight", F.array_join(spec, ",").alias("specs"), F.array_join(fees, ",").alias("fees"),
        F.array_join(option, ",").alias("options"), F.array_join("introImageUrls", ",").alias("images"),
    )


@query("detail_pages_b", """SELECT p_partkey, p_name AS productName, p_brand AS categoryDepth1, 'kind' AS categoryDepth2, 'by ' || p_brand AS brandHint,
    (CASE WHEN p_size % 3 = 0 THEN p_size * 1000 + 500 WHEN p_size % 3 = 1 THEN p_size * 1000 + 700 ELSE p_size * 10 END)::BIGINT AS salePrice, p_size AS outerBoxQty, CASE WHEN p_size % 2 = 0 THEN 'M' || p_partkey ELSE '' END AS modelName,
    '박스구성=' || p_size || '개입@0' AS specs, 'https://mall-b.example/m' || p_partkey || '.jpg' AS images FROM part""")
def detail_pages_b(spark, sf_dir):
    html = _html(
        '<div class="location_tit"><span>홈</span><span>', F.col("p_brand"), '</span><span>&gt;</span><span>kind</span></div><div id="contents"><div class="item_info_box"><div class="item_detail_tit"><h3>', F.col("p_name"), " 바로가기</h3></div>",
        F.when(_size() % 3 == 0, _html("<dl><dt>판매가</dt><dd>", _size(), ",500원</dd></dl>")).otherwise(""), "<dl><dt>브랜드</dt><dd>by ", F.col("p_brand"), "</dd></dl><dl><dt>박스구성</dt><dd>", _size(), "개입</dd></dl>",
        F.when(_size() % 3 == 1, _html('<div class="item_price"><strong>', _size(), ",700원</strong></div>")).otherwise(""), '<input type="hidden" name="goodsPrice" value="', _size(), '0">',
        F.when(_size() % 2 == 0, _html("<table><tr><th>상품 모델명</th><td>M", _key(), "</td></tr></table>")).otherwise(""), '</div></div><div class="item_photo_slide"><img src="/m', _key(), '.jpg"></div>',
    )
    found = elements.details_b(_single(spark, sf_dir, html), ["p_partkey"])
    spec = F.transform("specRows", lambda s: F.concat(s["labelKo"], F.lit("="), s["valueKo"], F.lit("@"), s["sortOrder"].cast("string")))
    return found.select(
        "p_partkey", "productName", "categoryDepth1", "categoryDepth2", "brandHint", F.col("salePrice").cast("bigint").alias("salePrice"), "outerBoxQty", "modelName", F.array_join(spec, ",").alias("specs"),
        F.array_join("mainImageUrls", ",").alias("images"),
    )
