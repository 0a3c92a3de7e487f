"""Option popups made from the part table and read back, and sold-out messages, with DuckDB SQL of what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import cart
from tallyard.plans.catalogue import query, read
from tallyard.plans.pages import _html, _key, _size, _when
from tallyard.sources import elements, popups
from tallyard.sources.shared import dealt

#: Parts of a popup: three, of every fourth three the first alone.
_SQL = """WITH b AS (SELECT p_partkey AS k, p_size AS z, p_name AS nm, p_brand AS br, p_partkey // 3 AS page FROM part WHERE NOT (p_partkey // 3 % 4 = 0 AND p_partkey % 3 <> 0)),
  r AS (SELECT page, CAST(k AS VARCHAR) AS pid, '[new] ' || nm AS pname, nm AS label, z FROM b WHERE z % 7 <> 0),
  v AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS productIndex, count(*) OVER (PARTITION BY page) AS visible, CASE WHEN z % 15 = 4 THEN 'other' ELSE nm END AS label FROM b WHERE z % 11 <> 0),
  c AS (SELECT page, count(*) AS wanted, min(pid) AS alone FROM r GROUP BY page),
  n AS (SELECT v.page, v.k, count(*) AS names, min(r.pid) AS byName FROM v JOIN r USING (page, label) GROUP BY ALL),
  m AS (SELECT v.*, coalesce(wanted, 0) AS wanted, alone, names, byName, r.pid AS byId FROM v LEFT JOIN c USING (page) LEFT JOIN n USING (page, k) LEFT JOIN r ON r.page = v.page AND r.pid = CAST(v.k AS VARCHAR) AND v.z % 5 <> 4),
  p AS (SELECT *, CASE WHEN byId IS NOT NULL THEN 'dom-id' WHEN names = 1 THEN 'exact-name' WHEN wanted = 1 AND visible = 1 THEN 'single-block' ELSE 'unresolved' END AS productMatchMode,
    coalesce(byId, CASE WHEN names = 1 THEN byName WHEN wanted = 1 AND visible = 1 THEN alone END, '') AS productId FROM m),
  o AS (SELECT *, unnest([0, 1, 2]) AS optionIndex FROM p WHERE z % 13 <> 0)"""


def _popups(spark, sf_dir):
    """(elements of the popups, requests of products, requested options)."""
    part = read(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 3)).filter(~((F.col("page") % 4 == 0) & (F.col("p_partkey") % 3 != 0)))
    ids = (
        F.when(_size() % 5 == 0, _html('<div class="product_info"><figure><b><img src="/i/', _key(), '_2.jpg?9"></b></figure></div>'))
        .when(_size() % 5 == 1, _html('<a href="/view?a=1&amp;QIDX=', _key(), '">x</a>')).when(_size() % 5 == 2, _html('<i data-qidx=" ', _key(), ' "></i>'))
        .when(_size() % 5 == 3, _html('<input name="in_qIDX-pop" value="', _key(), '">')).otherwise('<img src="/i/1.jpg"><i data-qidx="x"></i>')
    )
    subject = F.when(_size() % 15 == 4, "other").otherwise(F.col("p_name"))
    row = lambda n, off, stock: _html(
        '<tr id="inOptionTR"><td><input type="checkbox" id="optionCHKPOP" name="optionCHKPOP" value="', "" if n == 0 else _html(_key(), f"-{n}"), '"', off, f'></td><td class="option_txt"> option  {n} </td><td><input id="inOPcount" value="1"><input id="inOPidx" value="s{n}">',
        stock, '<input id="inOPaddPrice" value="1,', F.lpad(_size().cast("string"), 3, "0"), '"></td></tr>',
    )
    stock = lambda n: _html('<input id="inOPMaxStock" value="', _size() - n, '">')
    rows = _html(row(0, "", stock(0)), row(1, _when(_size() % 6 == 0, " disabled"), stock(12)), row(2, "", F.when(_size() % 4 == 0, _html('<input id="inOPMaxStock" value=" ">')).otherwise(stock(30))))
    block = _html(
        '<div class="many_add"', _when(_size() % 11 == 0, ' style="color:red; DISPLAY: none"'), '><div class="subject"><p>[', F.col("p_brand"), "] ", subject, '</p></div><b class="coc_brd_name">[', F.col("p_brand"), ']</b><span class="icon">', _size(), " 개입</span>", ids,
        F.when(_size() % 13 != 0, _html('<table id="opSelectedList"><tr><td><input id="inIDXPOP" value="g', _key(), '"></td></tr>', rows, "</table>")).otherwise(""), "</div>",
    )
    made = dealt(part, "page").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", block.alias("block")))), lambda x: x["block"]), "").alias("html"))
    asked = part.filter("p_size % 7 <> 0").select("page", _key().alias("productId"), F.concat(F.lit("[new] "), "p_name").alias("productName"), "p_size")
    options = asked.filter("p_size % 2 = 0").select("page", "productId", F.concat("productId", F.lit("-1")).alias("optionId"), (F.col("p_size") % 4).alias("quantity"))
    return elements.stored_elements(made), asked.drop("p_size"), options


@query("popup_options", f"""{_SQL} SELECT page, productIndex, optionIndex::INTEGER AS optionIndex, productId, productMatchMode, CASE WHEN productId <> '' THEN '[new] ' || rn ELSE '[' || br || '] ' || label END AS productName, br AS brandText, z::BIGINT AS outerBoxQty,
    wanted AS requestedProductCount, visible AS visibleBlockCount, 'g' || k AS cartGroupId, CASE WHEN optionIndex = 0 THEN '0' ELSE k || '-' || optionIndex END AS optionId, CASE WHEN optionIndex = 0 THEN '' ELSE 'option ' || optionIndex END AS optionText,
    's' || optionIndex AS submitOptionId, stock AS maxStock, off AS disabled, whole AS complete, sel AS selectable, CASE WHEN off THEN 'DISABLED' WHEN stock <= 0 THEN 'OUT_OF_STOCK' WHEN stock <= 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS stockStatus,
    1000 + z AS addPrice, cart AS selectedForCart, CASE WHEN NOT cart THEN 0 WHEN rz % 2 = 0 THEN greatest(1, rz % 4) ELSE 1 END::BIGINT AS requestedQty
  FROM (SELECT *, sel AND (rz IS NULL OR rz % 2 = 1 OR (optionIndex = 1 AND productId = CAST(k AS VARCHAR))) AS cart FROM (SELECT *, whole AND NOT off AND stock > 0 AS sel FROM (
    SELECT o.*, r.label AS rn, r.z AS rz, CASE optionIndex WHEN 0 THEN o.z WHEN 1 THEN o.z - 12 ELSE CASE WHEN o.z % 4 = 0 THEN 0 ELSE o.z - 30 END END::BIGINT AS stock, optionIndex = 1 AND o.z % 6 = 0 AS off, NOT (optionIndex = 2 AND o.z % 4 = 0) AS whole
    FROM o LEFT JOIN r ON r.page = o.page AND r.pid = o.productId)))""")
def popup_options(spark, sf_dir):
    els, asked, options = _popups(spark, sf_dir)
    return popups.popup_rows(els, asked, options, ["page"]).select(
        "page", "productIndex", "optionIndex", "productId", "productMatchMode", "productName", "brandText", "outerBoxQty", "requestedProductCount", "visibleBlockCount", "cartGroupId", "optionId", "optionText",
        "submitOptionId", "maxStock", "disabled", "complete", "selectable", "stockStatus", "addPrice", "selectedForCart", "requestedQty",
    )


@query("popup_blocks", f"""{_SQL} SELECT page, productIndex, productId, productMatchMode, z % 13 <> 0 AS hasTable, CASE WHEN z % 5 <> 4 THEN CAST(k AS VARCHAR) ELSE '' END AS ids, wanted AS requestedProductCount FROM p""")
def popup_blocks(spark, sf_dir):
    els, asked, _ = _popups(spark, sf_dir)
    found = popups.block_products(els, asked, ["page"])
    return found.select("page", "productIndex", "productId", "productMatchMode", F.col("table").isNotNull().alias("hasTable"), F.array_join("explicitProductIds", ",").alias("ids"), "requestedProductCount")


_MESSAGES = """r AS (SELECT DISTINCT l_suppkey AS batch, CAST(l_partkey AS VARCHAR) AS productId, lower(replace(p_name, ' ', '')) || '/' || lower(p_brand) AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
  l AS (SELECT DISTINCT l_suppkey AS batch, l_orderkey * 8 + l_linenumber AS ord, l_partkey AS k, p_name, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 42),
  m AS (SELECT batch, ord, k, '<p>' || CASE WHEN p_size % 3 = 0 THEN k || '</p>' ELSE 'x</p>' END AS html, CASE WHEN p_size % 3 = 1 THEN lower(replace(p_name, ' ', '')) || '/' || lower(p_brand) || 'soldout' ELSE 'soldout' END AS text,
    CASE WHEN p_size % 3 = 2 THEN [CAST(k AS VARCHAR), CAST(p_size AS VARCHAR)] ELSE [CAST(k AS VARCHAR)] END AS unchecked FROM l),
  named AS (SELECT DISTINCT m.batch, m.ord, r.productId, CASE WHEN contains(m.html, r.productId) THEN 'id' ELSE 'name' END AS found FROM m JOIN r ON m.batch = r.batch AND (contains(m.html, r.productId) OR contains(m.text, r.name))),
  new AS (SELECT u.batch, u.productId, min(u.ord) AS ord FROM (SELECT batch, ord, unnest(unchecked) AS productId FROM m) u JOIN (SELECT DISTINCT batch, productId FROM r) d USING (batch, productId) GROUP BY ALL),
  alone AS (SELECT batch, ord, min(productId) AS productId, 'unchecked' AS found FROM new GROUP BY batch, ord HAVING count(*) = 1)"""


def _messages(spark, sf_dir):
    """Requests by supplier, and messages about lines of large quantities: by id, by name, or by an unchecked box."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").distinct()
    # lines are made distinct by their keys, ahead of the names, and meet parts sorted: Spark knows the packed size of the parts alone
    of_part = lambda lines: lines.distinct().join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    batch, lines = F.col("l_suppkey").alias("batch"), read(spark, sf_dir, "lineitem")
    name = F.concat("p_name", F.lit(" / "), "p_brand")
    requests = of_part(lines.filter("l_returnflag = 'R'").select(batch, "l_partkey")).select("batch", _key().alias("productId"), F.concat(F.lit("[A] "), name).alias("productName"))
    told = of_part(lines.filter("l_quantity > 42").select(batch, (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), "l_partkey"))
    messages = told.select(
        "batch", "ord", F.when(_size() % 3 == 0, _html("<p>", _key(), "</p>")).otherwise("<p>x</p>").alias("html"), F.when(_size() % 3 == 1, _html("[x] ", F.upper(name), " Sold Out")).otherwise("sold out").alias("text"),
        F.when(_size() % 3 == 2, F.array(_key(), _size().cast("string"))).otherwise(F.array(_key())).alias("unchecked"),
    )
    return messages, requests


@query("sold_out_messages", f"""WITH {_MESSAGES} SELECT batch, ord, productId, found FROM named UNION ALL SELECT * FROM alone WHERE (batch, ord) NOT IN (SELECT (batch, ord) FROM named)""")
def sold_out_messages(spark, sf_dir):
    messages, requests = _messages(spark, sf_dir)
    return cart.sold_out_in_text(messages, requests)


@query("sold_out_reports", f"""WITH {_MESSAGES} SELECT DISTINCT batch, productId FROM (SELECT batch, ord, productId FROM named UNION ALL SELECT batch, ord, productId FROM alone WHERE (batch, ord) NOT IN (SELECT (batch, ord) FROM named))""")
def sold_out_reports(spark, sf_dir):
    messages, requests = _messages(spark, sf_dir)
    return cart.sold_out_products(cart.sold_out_in_text(messages, requests))


@query("popup_totals", f"""{_SQL} SELECT page, any_value(visible) AS visibleWrapperCount, count(*) FILTER (WHERE z % 13 <> 0) AS optionTableCount, 3 * count(*) FILTER (WHERE z % 13 <> 0) AS optionRowCount,
    count(*) FILTER (WHERE z % 13 <> 0) * 2 + count(*) FILTER (WHERE z % 13 <> 0 AND z % 4 <> 0) AS completeRowCount, bool_and(z % 13 <> 0 AND z % 4 <> 0) AS usable FROM p GROUP BY page""")
def popup_totals(spark, sf_dir):
    els, asked, options = _popups(spark, sf_dir)
    products = popups.block_products(els, asked, ["page"])
    found = popups.popup_state(products, popups.popup_rows(els, asked, options, ["page"], products=products), ["page"])
    return found.drop("selectableRowCount")


@query("selection_states", """WITH r AS (SELECT p_partkey // 10 AS batch, p_partkey AS k, p_size AS n FROM part), s AS (SELECT *, n % 29 = 1 AS missing, n % 31 = 2 AS twice, n % 37 = 3 AS off, n % 41 = 4 AS bare, n % 43 = 5 AS otherq, n % 47 = 6 AS un, n % 23 = 7 AS foreign_ FROM r)
  SELECT batch, count(*) FILTER (WHERE NOT foreign_) AS requested, count(*) FILTER (WHERE missing AND NOT foreign_) AS missing, count(*) FILTER (WHERE twice AND NOT missing AND NOT foreign_) AS duplicate,
    count(*) FILTER (WHERE off AND NOT missing AND NOT foreign_) AS disabled, count(*) FILTER (WHERE bare AND NOT missing AND NOT foreign_) AS withoutCount, 0 AS countDisabled, count(*) FILTER (WHERE un AND NOT missing AND NOT foreign_) AS unchecked,
    count(*) FILTER (WHERE otherq AND NOT bare AND NOT missing AND NOT foreign_) AS otherQuantity, count(*) FILTER (WHERE foreign_ AND NOT missing AND NOT un) AS unexpected,
    count(*) FILTER (WHERE foreign_ AND NOT missing AND NOT un OR NOT foreign_ AND (missing OR twice OR off OR bare OR otherq OR un)) = 0 AND count(*) FILTER (WHERE NOT foreign_) > 0 AND batch % 7 <> 3 AS complete FROM s GROUP BY batch""")
def selection_states(spark, sf_dir):
    n = F.col("p_size")
    part = read(spark, sf_dir, "part").withColumn("batch", F.floor(F.col("p_partkey") / 10)).withColumn("productId", _key())
    requests = part.filter(n % 23 != 7).select("batch", "productId", F.lit(2).alias("quantity"))
    boxes = part.filter(n % 29 != 1).withColumn("time", F.explode(F.when(n % 31 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    checks = boxes.select("batch", "productId", (n % 47 != 6).alias("checked"), (n % 37 == 3).alias("disabled"), (n % 41 != 4).alias("hasCount"), F.lit(False).alias("countDisabled"), F.when(n % 43 == 5, 1).otherwise(2).alias("count"))
    return popups.selection_state(requests, checks, part.select("batch", (F.col("batch") % 7 != 3).alias("ready")).distinct())
