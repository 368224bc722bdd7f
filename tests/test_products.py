from shoptrail import schemas
from shoptrail.operators import products
from tests.helpers import plan, rows

CITIES = [(1, "Ald", "China North"), (2, "Bel", "China North"), (3, "Cor", "West South"),
          (4, "Dun", "Elsewhere")]


def clicks(spark, *pairs):
    return spark.createDataFrame(list(pairs), "city_id long, product_id long")


def cities(spark, rows=CITIES):
    return spark.createDataFrame(rows, schemas.CITY_INFO)


def goods(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.PRODUCT_INFO)


def test_counts_and_cities_per_area(spark):
    df = clicks(spark, (1, 5), (1, 5), (2, 5), (3, 5), (9, 5))
    got = products.area_product_click_count(df, cities(spark))
    assert rows(got) == [("China North", 5, 3, "1:Ald,2:Bel"), ("West South", 5, 1, "3:Cor")]


def test_counting_before_the_join_equals_counting_after(spark):
    df = clicks(spark, (1, 5), (1, 5), (2, 5), (3, 6))
    doubled = cities(spark, [*CITIES, (1, "Ald", "China North")])
    late = products.click_product_basic(df, doubled).groupBy("area", "product_id").count()
    early = products.area_product_click_count(df, doubled)
    assert rows(early.select("area", "product_id", "click_count")) == rows(late)


def test_status_and_unknown_products(spark):
    df = clicks(spark, (1, 5), (1, 6), (1, 7), (1, 8))
    listed = goods(spark, (5, "a", '{"product_status": 0}'), (6, "b", '{"product_status": 1}'),
                   (7, "c", None))
    counts = products.area_product_click_count(df, cities(spark))
    got = products.area_full_product(counts, listed).select("product_id", "product_status")
    assert rows(got) == [(5, "Self"), (6, "Third Party"), (7, "Third Party")]


def test_top3_levels_and_ties(spark):
    df = clicks(spark, *[(1, p) for p in (9, 8, 7, 6, 6)], (3, 9), (4, 9))
    listed = goods(spark, *[(p, "x", None) for p in (6, 7, 8, 9)])
    full = products.area_full_product(
        products.area_product_click_count(df, cities(spark)), listed
    )
    got = products.area_top3_product(full, 2)
    assert got.columns == list(schemas.AREA_TOP3_PRODUCT)
    assert rows(got.select("area", "area_level", "product_id")) == [
        ("China North", "A level", 6), ("China North", "A level", 7),
        ("China North", "A level", 8), ("Elsewhere", "D Level", 9),
        ("West South", "C Level", 9),
    ]
    assert "row_number(), 3, Partial" in plan(got)


def test_salted_count_equals_plain_count(spark):
    df = clicks(spark, *[(i, 1) for i in range(50)], *[(i, 2) for i in range(3)])
    got = products.salted_count(df, ["product_id"], ["city_id"], salts=4)
    assert rows(got) == [(1, 50), (2, 3)]
