"""Fixed column orders of exports and the product and option records."""

# fixed values
INVENTORY = (
    "sourceMall categoryCode productId productName brandHint categoryHint optionText barcode hasOption requestedQty maxStock stockStatus "
    "stockLimited onePrice boxPrice effectivePrice hasBoxDiscount packageQty packageUnit packageText isSoldOut msg productUrl"
).split()
SUMMARY = (
    "sourceMall categoryCode productId productName brandHint categoryHint stockStatus totalStock minStock maxStock rowCount optionCount "
    "hasOptions limitedRowCount lowStockRowCount outOfStockRowCount priceMin priceMax hasBoxDiscount packageQty packageUnit packageText "
    "isSoldOut optionNames productUrl"
).split()
PRODUCTS = (
    "sourceMall categoryCode page index productId productName brandHint categoryHint isSoldOut saleStatus price priceText listMaxStock "
    "listPorderMinus packageQty packageUnit packageText productUrl imageUrl"
).split()
DETAILS = (
    "sourceMall categoryCode productId productUrl productName brandHint categoryHint categoryDepth1 categoryDepth2 categoryDepth3 productNo "
    "barcode outerBoxText outerBoxQty consumerPrice manufacturer material packageSize weight origin certification warehouse targetAge "
    "warranty asContact my3plAvailable my3plInboundFee my3plOutboundFee my3plStorageFee packageQty packageUnit packageText "
    "thumbnailImageUrlsText introImageUrlsText detailOptions detailError"
).split()

OPTION = "struct<id:string,barcode:string,name:string,nameKo:string,nameJa:string,nameEn:string,additionalPrice:bigint,stockQuantity:bigint,status:string>"
SPECS = "array<struct<labelKo:string,labelJa:string,valueKo:string,valueJa:string,sortOrder:int>>"

#: Fields of a product, their types and what a new record starts with (SQL).
PRODUCT = {
    "id": ("string", "''"), "barcode": ("string", "null"), "hsCode": ("string", "null"), "sku": ("string", "''"), "slug": ("string", "''"),
    "type": ("string", "'SINGLE'"), "nameKo": ("string", "''"), "nameJa": ("string", "''"), "nameEn": ("string", "''"),
    "categoryId": ("string", "''"), "subcategoryId": ("string", "null"), "brandId": ("string", "''"), "originalPrice": ("decimal(18,4)", "null"),
    "yenPrice": ("bigint", "null"), "convertTime": ("string", "null"), "salePrice": ("decimal(18,4)", "null"), "discountRate": ("double", "null"),
    "currency": ("string", "'KRW'"), "saleStatus": ("string", "'ON_SALE'"), "stockQuantity": ("bigint", "null"),
    "lowStockThreshold": ("int", "10"), "stockStatus": ("string", "''"), "badges": ("array<string>", "array()"),
    "imageUrls": ("array<string>", "array()"), "thumbnailUrl": ("string", "''"), "options": (f"array<{OPTION}>", "array()"),
    "wholesaleEnabled": ("boolean", "false"), "descriptionKo": ("string", "''"), "descriptionJa": ("string", "''"), "specs": (SPECS, "array()"),
    "rating": ("double", "0"), "reviewCount": ("int", "0"), "salesCount": ("int", "0"), "status": ("string", "'PUBLISHED'"),
    "sortOrder": ("int", "0"), "adminMemo": ("string", "''"), "version": ("int", "0"), "createdAt": ("string", "null"), "updatedAt": ("string", "null"),
}
GENERAL_FIELDS = ("type", "nameKo", "nameJa", "nameEn", "saleStatus", "stockQuantity", "lowStockThreshold", "stockStatus")
DETAIL_FIELDS = (
    "barcode", "nameKo", "nameJa", "nameEn", "categoryId", "subcategoryId", "brandId", "originalPrice", "salePrice", "discountRate", "currency",
    "imageUrls", "thumbnailUrl", "descriptionKo", "descriptionJa", "specs",
)
