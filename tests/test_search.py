import datetime

from pricelore.operators import insight as I

ITEMS = [
    (1, "blue anvil", 5000, "A", 1),
    (2, "blue anvil 매입", 5000, "A", 2),
    (3, "blue anvil case", 5000, "A", 3),
    (4, "blue anvil", 500, "A", 4),
    (5, "blue anvil", 3000, "B", 5),
    (6, "red hammer", 3000, "B", 6),
]


def items(spark):
    rows = [(k, t, "", "", price, "", p, datetime.datetime(2024, 1, day)) for k, t, price, p, day in ITEMS]
    return spark.createDataFrame(rows, "item_id long, title string, canonical_name string, category_name string, current_price long, status string, platform string, crawled_at timestamp")


def found(spark, query, **more):
    return [int(r["document_id"]) for r in I.field_search(I.documents(items(spark)), query, **more).collect()]


def test_noise_and_implausible_prices_are_dropped(spark):
    assert sorted(found(spark, "blue anvil")) == [1, 5]


def test_accessories_are_found_if_asked_for(spark):
    assert found(spark, "anvil case") == [3]


def test_platforms(spark):
    assert found(spark, "blue anvil", platforms=("B",)) == [5]


def test_sort_and_pages(spark):
    assert found(spark, "anvil", sort="low_price") == [5, 1] and found(spark, "anvil", sort="recent") == [5, 1]
    assert found(spark, "anvil", sort="low_price", limit=1, page=2) == [1]


def test_combined_search_passes_them_on(spark):
    got = lambda **more: [r["item_id"] for r in I.combined_search(items(spark), "blue anvil", **more).collect()]
    assert sorted(got()) == [1, 5] and got(platforms=("A",)) == [1] and got(sort="low_price", limit=1, page=2) == [1]


def test_titles_are_judged_once_and_documents_read_once(spark):
    """No flag of a title is a filter of the scan, and what is ranked comes from one reading of the documents."""
    plan = I.searchable(I.documents(items(spark)), "anvil")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [title" in plan and not [line for line in plan.splitlines() if "맥세이프" in line and "current_price" in line]
    plan = I.field_search(I.documents(items(spark)), "blue anvl")._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "regexp" not in plan
