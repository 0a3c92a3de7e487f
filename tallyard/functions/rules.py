"""Brand, category, package, price and status rules of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyard.functions.rows import bound
from tallyard.functions.text import has_text, product_name, squash

# fixed values: brands in order of precedence
BRANDS = (
    "크라운볼펜", "뷰티박스", "스케이터", "Brunch Brother", "산리오", "헬로키티", "시나모롤", "쿠로미", "마이멜로디", "포차코", "한교동", "짱구",
    "카카오프렌즈", "포켓몬", "피카츄", "스누피", "톰보", "무민", "에스더버니", "리락쿠마", "코리락쿠마", "주토피아", "스파이더맨", "커비",
    "위시캣", "캐치티니핑", "헬로카봇", "신비아파트",
)
# fixed values: categories and their keywords in order of precedence
CATEGORIES = (
    ("문구/필기구", ("볼펜", "샤프", "샤프심", "연필", "지우개", "노트", "메모", "바인더", "화이트보드", "필기구")),
    ("캐릭터/완구/취미", ("스퀴시", "말랑이", "피규어", "토이", "장난감", "게임", "랜덤", "가챠", "워터볼", "스티커북", "미로놀이")),
    ("패션잡화/파우치", ("파우치", "지갑", "가방", "키링", "가방고리", "조리개", "런치백")),
    ("수납/정리", ("바스켓", "수납", "정리", "보관함", "박스", "케이스", "홀더")),
    ("주방/도시락/식기", ("도시락", "텀블러", "컵", "식판", "밥그릇", "볼", "스푼", "젓가락", "찜기", "음료 홀더", "푸드용기")),
    ("도서/학습", ("백과", "도감", "수수께끼", "속담", "한자", "색칠놀이", "포스터북", "POSTER BOOK")),
    ("생활/리빙", ("계산기", "거울", "샤워 가운", "홀더", "케이스")),
)
NO_CATEGORY = "미분류"
OUT, LOW, LIMITED, IN = "OUT_OF_STOCK", "LOW_STOCK", "LIMITED", "IN_STOCK"


def infer_brand(name: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """Leading bracketed brand, else the first known brand in the name, else empty."""
    plain = product_name(name)
    known = F.coalesce(*[F.when(plain.contains(b), F.lit(b)) for b in brands], F.lit(""))
    return F.when(plain.rlike(r"^\[[^\]]+\]"), F.trim(F.regexp_extract(plain, r"^\[([^\]]+)\]", 1))).otherwise(known)


def infer_category(name: Column, rules=CATEGORIES, otherwise: str = NO_CATEGORY) -> Column:
    """First category one of whose keywords the name holds, in any case."""
    plain = F.lower(product_name(name))
    hits = []
    for category, words in rules:
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | plain.contains(w.lower())
        hits.append(F.when(any_word, F.lit(category)))
    return F.coalesce(*hits, F.lit(otherwise))


def package_info(name: Column) -> Column:
    """struct(packageQty, packageUnit, packageText) of a name such as ``12개 1세트``."""
    pattern = r"(?i)([0-9]+)\s*개\s*(?:1\s*)?(세트|타|입|P)?"
    plain = product_name(name)
    text = F.regexp_extract(plain, pattern, 0)
    unit = F.regexp_extract(plain, pattern, 2)
    return F.when(
        text != "",
        F.struct(
            F.regexp_extract(plain, pattern, 1).try_cast("bigint").alias("packageQty"),
            F.when(unit == "", F.lit("개")).otherwise(unit).alias("packageUnit"), text.alias("packageText"),
        ),
    ).otherwise(F.struct(F.lit(1).cast("bigint").alias("packageQty"), F.lit("").alias("packageUnit"), F.lit("").alias("packageText")))


def row_status(stock: Column, limited: Column, threshold: int) -> Column:
    return F.when(stock <= 0, OUT).when(stock <= threshold, LOW).when(limited, LIMITED).otherwise(IN)


def product_status(rows: Column, out: Column, low: Column, limited: Column) -> Column:
    """Of a product from numbers of its rows by status."""
    return F.when(out == rows, OUT).when(low > 0, LOW).when(limited > 0, LIMITED).otherwise(IN)


def backend_status(quantity: Column, statuses: Column, threshold: int, unavailable: Column) -> Column:
    """From the quantity if known, else from the set of row statuses."""
    return (
        F.when(unavailable, OUT)
        .when(quantity <= 0, OUT).when(quantity <= threshold, LOW).when(quantity.isNotNull(), IN)
        .when(F.array_contains(statuses, IN) | F.array_contains(statuses, LIMITED), IN)
        .when(F.array_contains(statuses, LOW), LOW).when(F.array_contains(statuses, OUT), OUT).otherwise("")
    )


def sale_status(stock_status: Column, unavailable: Column) -> Column:
    return F.when(unavailable | (stock_status == OUT), "SOLD_OUT").otherwise("ON_SALE")


def unavailable(sold_out: Column, in_cart: Column, sale: Column, addable: Column, button: Column, count_input: Column) -> Column:
    """Explicit flags first, then cartAddable, then the two controls; null means not stated."""
    stated = F.coalesce(sold_out, F.lit(False)) | F.coalesce(in_cart, F.lit(False)) | F.coalesce(squash(sale) == "SOLD_OUT", F.lit(False))
    controls = ~(F.coalesce(button, F.lit(False)) & F.coalesce(count_input, F.lit(False)))
    return F.when(stated, True).when(addable.isNotNull(), ~addable).when(button.isNotNull() | count_input.isNotNull(), controls).otherwise(False)


def effective_price(one: Column, box: Column) -> Column:
    return F.when(box > 0, box).otherwise(one)


def has_box_discount(one: Column, box: Column) -> Column:
    return (box > 0) & (box < one)


def last_category(*levels: Column) -> Column:
    """Last part of the first level that has text."""
    path = F.coalesce(*[F.when(has_text(c), squash(c)) for c in levels], F.lit(""))
    parts = F.filter(F.transform(F.split(path, "[>›»|]"), squash), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def detail_spec(rows: Column, words: list[str]) -> Column:
    """Value of the first row (labelKo, valueKo) whose label holds a word: that of the first word whose row is filled, or null."""
    def first(tidy: Column, word: str) -> Column:
        return F.nullif(squash(F.get(F.filter(tidy, lambda r: r["labelKo"].contains(word)), F.lit(0))["valueKo"]), F.lit(""))

    tidy = F.transform(rows, lambda r: F.struct(squash(r["labelKo"]).alias("labelKo"), r["valueKo"].alias("valueKo")))
    return bound(tidy, lambda t: F.coalesce(*[first(t, w) for w in words]))


#: Row statuses of popup options add one for controls that are switched off.
def popup_status(stock: Column, limited: Column, disabled: Column, threshold: int) -> Column:
    return F.when(disabled, "DISABLED").otherwise(row_status(stock, limited, threshold))
