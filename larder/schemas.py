"""Schemas of landed pages and canonical rows."""

from __future__ import annotations

OFFER = "struct<Price double, ListPrice double, IsAvailable boolean, AvailableQuantity bigint>"
VTEX_PRODUCT = (
    "struct<productId string, productName string, brand string, items array<struct<ean string, nameComplete string,"
    f" images array<struct<imageUrl string>>, sellers array<struct<commertialOffer {OFFER}>>>>>"
)
SHOPIFY_PRODUCT = (
    "struct<id string, title string, vendor string, product_type string, tags string,"
    " variants array<struct<price string, compare_at_price string, available boolean, barcode string>>,"
    " images array<struct<src string>>>"
)
PICKUP_POINT = (
    "struct<id string, friendlyName string, isActive boolean,"
    " address struct<street string, city string, geoCoordinates array<double>>>"
)
PICKUP_PAGE = (
    "struct<paging struct<page int, pageSize int, total int, pages int>,"
    f" items array<struct<distance double, pickupPoint {PICKUP_POINT}>>>"
)
ARA_SHOP = (
    "struct<store_code string, name string, address string, latitude string, longitude string, status string, city string>"
)
DOLLARCITY_PAGE = (
    "struct<StoreLocations array<struct<LocationId string, Name string, Address string,"
    " Location struct<type string, coordinates array<double>>,"
    " ExtraData struct<BusinessStatus int, Name struct<LongName string>,"
    " Address struct<Locality string, CountryCode string>>>>>"
)
WP_SHOP = (
    "struct<id bigint, title struct<rendered string>, content struct<rendered string>,"
    " `tiendas-municipios` array<bigint>, `tiendas-departamento` array<bigint>>"
)
WP_TERM = "struct<id bigint, name string>"
CURATED_BRANCH = (
    "struct<externalId string, name string, address string, city string, latitude double, longitude double>"
)
CURATED_FILE = f"struct<source string, verifiedAt string, coordinates string, branches array<{CURATED_BRANCH}>>"
OSM_HIT = (
    "struct<lat double, lon double, place_rank int, category string, type string, name string,"
    " address map<string,string>, boundingbox array<double>>"
)

FETCH_LOG = "url string, store string, outcome string, reason string"
NORMALIZED_PRODUCT = (
    "external_id string, ean string, name string, brand string, category_slug string, source_bucket string,"
    " unit_kind string, unit_value decimal(10,3), unit_measure string, image_url string, is_available boolean,"
    " price_cop int, list_price_cop int"
)
PRODUCT_COLUMNS = [part.strip().split(" ")[0] for part in NORMALIZED_PRODUCT.replace("decimal(10,3)", "decimal").split(",")]
BRANCH_COLUMNS = ["external_id", "name", "address", "city", "latitude", "longitude"]
CATALOG = (
    "store_slug string, external_id string, id string, ean string, name string, brand string, category_id string,"
    " source_bucket string, unit_kind string, unit_value decimal(10,3), unit_measure string, image_url string,"
    " is_available boolean, first_seen_at timestamp, last_seen_at timestamp"
)
SNAPSHOT = (
    "id bigint, store_product_id string, region_code string, price_cop int, list_price_cop int, captured_at timestamp"
)
CURRENT = "store_product_id string, region_code string, price_cop int, list_price_cop int, captured_at timestamp"
BRANCH = (
    "store_slug string, external_id string, id string, name string, address string, city string, latitude double,"
    " longitude double, source string, is_active boolean, last_seen_at timestamp, created_at timestamp"
)
