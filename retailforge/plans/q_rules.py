"""Basket and association-rule queries (71, 85-91).

Oracle: itemsets of size 1-3 counted by self-joins of distinct (basket, item)
pairs; at these supports no larger set is frequent, so FP-growth with the
reference's limit of ten items gives the same sets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retailforge.functions.strings import marketplace_product_label, retail_product_label
from retailforge.operators import baskets as B
from retailforge.operators import tidlists as T
from retailforge.plans.oracle_views import MERGED, RETAIL_LINES, with_views
from retailforge.plans.pipelines import marketplace_lines
from retailforge.plans.q_aggs import BRAND_BASKETS_SQL, brand_baskets
from retailforge.plans.registry import query
from retailforge.sources.views import retail_lines

ITEMSET_SUPPORT = 0.01
RULE_SUPPORT, RULE_CONFIDENCE = 0.005, 0.01
MAX_LEN = 10


def _itemset_ctes(support: float) -> str:
    return f"""
nb AS (SELECT count(DISTINCT basket) AS n FROM bb),
thr AS (SELECT ceil(CAST({support} AS DOUBLE) * n) AS t, n FROM nb),
s1 AS (SELECT item AS a, count(*) AS c FROM bb GROUP BY 1 HAVING count(*) >= (SELECT t FROM thr)),
f AS (SELECT * FROM bb WHERE item IN (SELECT a FROM s1)),
s2 AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM f x JOIN f y ON x.basket = y.basket AND x.item < y.item
       GROUP BY 1, 2 HAVING count(*) >= (SELECT t FROM thr)),
s3 AS (SELECT x.item AS a, y.item AS b, z.item AS d, count(*) AS c
       FROM f x JOIN f y ON x.basket = y.basket AND x.item < y.item JOIN f z ON z.basket = x.basket AND y.item < z.item
       GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT t FROM thr))"""


@query("q_frequent_itemsets", f"""WITH {BRAND_BASKETS_SQL.strip()},{_itemset_ctes(ITEMSET_SUPPORT)}
SELECT '{{' || a || '}}' AS items, 1 AS size, c / (SELECT n FROM nb) AS support, c AS count FROM s1
UNION ALL SELECT '{{' || a || ',' || b || '}}', 2, c / (SELECT n FROM nb), c FROM s2
UNION ALL SELECT '{{' || a || ',' || b || ',' || d || '}}', 3, c / (SELECT n FROM nb), c FROM s3""")
def q_frequent_itemsets(spark, sf):
    baskets = B.basket_lists(brand_baskets(spark, sf), "basket", "item")
    return B.frequent_itemsets(baskets, ITEMSET_SUPPORT, max_len=MAX_LEN).withColumn("size", F.col("size").cast("int"))


RULES_SQL = f"""WITH {BRAND_BASKETS_SQL.strip()},{_itemset_ctes(RULE_SUPPORT)},
cand AS (
  SELECT '{{' || a || '}}' AS ante_txt, b AS cons, c, (SELECT c FROM s1 WHERE s1.a = s2.a) AS ca FROM s2
  UNION ALL SELECT '{{' || b || '}}', a, c, (SELECT c FROM s1 WHERE s1.a = s2.b) FROM s2
  UNION ALL SELECT '{{' || a || ',' || b || '}}', d, c, (SELECT c FROM s2 WHERE s2.a = s3.a AND s2.b = s3.b) FROM s3
  UNION ALL SELECT '{{' || a || ',' || d || '}}', b, c, (SELECT c FROM s2 WHERE s2.a = s3.a AND s2.b = s3.d) FROM s3
  UNION ALL SELECT '{{' || b || ',' || d || '}}', a, c, (SELECT c FROM s2 WHERE s2.a = s3.b AND s2.b = s3.d) FROM s3),
scored AS (
  SELECT ante_txt || ' => {{' || cons || '}}' AS rules, c / (SELECT n FROM nb) AS support, c / ca AS confidence,
         (c / ca) / ((SELECT c FROM s1 WHERE s1.a = cand.cons) / (SELECT n FROM nb)) AS lift
  FROM cand)
SELECT rules, support, confidence, support / confidence AS coverage, lift,
       CAST(round(support * (SELECT n FROM nb)) AS BIGINT) AS count
FROM scored WHERE confidence >= CAST({RULE_CONFIDENCE} AS DOUBLE) AND lift > 1"""


@query("q_association_rules", RULES_SQL)
def q_association_rules(spark, sf):
    baskets = B.basket_lists(brand_baskets(spark, sf), "basket", "item")
    return B.association_rules(baskets, RULE_SUPPORT, RULE_CONFIDENCE, min_len=2, max_len=MAX_LEN, min_lift=1.0)


@query("q_baskets_invoice", f"""{with_views(RETAIL_LINES)}
SELECT InvoiceNo AS basket, array_to_string(list_sort(list_distinct(list(Description || ' (' || StockCode))), '|') AS items,
       count(DISTINCT Description || ' (' || StockCode) AS n_items
FROM retail_lines GROUP BY InvoiceNo""")
def q_baskets_invoice(spark, sf):
    b = B.basket_lists(retail_lines(spark, sf), "InvoiceNo", retail_product_label())
    return b.select("basket", F.concat_ws("|", "items").alias("items"), F.size("items").cast("long").alias("n_items"))


@query("q_baskets_customer_quarter", f"""{with_views(MERGED)}
SELECT CAST(customer_unique_id AS VARCHAR) || '-' || strftime(order_purchase_timestamp, '%y/') || '0'
         || CAST(quarter(order_purchase_timestamp) AS VARCHAR) AS basket,
       array_to_string(list_sort(list_distinct(list(CAST(seller_id AS VARCHAR)))), '|') AS sellers,
       array_to_string(list_sort(list_distinct(list(product_category_name_english || '/' || CAST(seller_id AS VARCHAR)
                       || ' (' || CAST(product_id AS VARCHAR) || ')'))), '|') AS products
FROM merged GROUP BY 1""")
def q_baskets_customer_quarter(spark, sf):
    m = marketplace_lines(spark, sf)
    key = B.customer_quarter_key("customer_unique_id", "order_purchase_timestamp")
    sellers = B.basket_lists(m, key, "seller_id")
    products = B.basket_lists(m, key, marketplace_product_label())
    return sellers.select("basket", F.concat_ws("|", "items").alias("sellers")).join(
        products.select("basket", F.concat_ws("|", "items").alias("products")), "basket")


MATRIX_ITEMS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"]
_MATRIX_COLS = ", ".join("max(CASE WHEN item = '%s' THEN 1 ELSE 0 END) AS \"%s\"" % (i, i) for i in MATRIX_ITEMS)


@query("q_basket_matrix", f"""WITH {BRAND_BASKETS_SQL.strip()}
SELECT basket, {_MATRIX_COLS}
FROM bb GROUP BY basket""")
def q_basket_matrix(spark, sf):
    return B.basket_matrix(brand_baskets(spark, sf), "basket", "item", MATRIX_ITEMS)


@query("q_rules_export", RULES_SQL.replace(
    "SELECT rules, support, confidence, support / confidence AS coverage, lift,",
    "SELECT CAST(row_number() OVER (ORDER BY rules) AS VARCHAR) AS \"row\", rules, support, confidence, "
    "support / confidence AS coverage, lift,"))
def q_rules_export(spark, sf):
    """Rules written as CSV with a leading row id (4, 5) and read back with an explicit schema (1, 3)."""
    from retailforge.session import checkpoint_dir
    from retailforge.sources.csv_io import read_csv, with_row_id, write_csv
    import uuid
    baskets = B.basket_lists(brand_baskets(spark, sf), "basket", "item")
    rules = B.association_rules(baskets, RULE_SUPPORT, RULE_CONFIDENCE, min_len=2, max_len=MAX_LEN, min_lift=1.0)
    path = f"{checkpoint_dir(spark).rstrip('/')}/retailforge-exports/rules-{uuid.uuid4().hex}"
    write_csv(with_row_id(rules, "rules", name="row"), path)
    schema = "row string, rules string, support double, confidence double, coverage double, lift double, count long"
    return read_csv(spark, path, schema=__import__("pyspark.sql.types", fromlist=["_parse_datatype_string"])
                    ._parse_datatype_string(schema))


# Rule jobs of the study by vertical lists.  Fixed values: support, confidence and least count of its scripts.
LOW_SUPPORT = 5e-5
SELLER_CONFIDENCE, PRODUCT_CONFIDENCE, INVOICE_CONFIDENCE = 0.05, 0.1, 0.01
SELLER_COUNT, PAIR_COUNT = 5, 2
QUARTER_SQL = """CAST(customer_unique_id AS VARCHAR) || '-' || strftime(order_purchase_timestamp, '%y/') || '0'
         || CAST(quarter(order_purchase_timestamp) AS VARCHAR)"""


def _low_support_sql(pairs: str, confidence: float, min_count: int, select: str) -> str:
    """``pairs``: text from WITH on, ending in a CTE ``bb(basket, item)``.  Sets of up to five items by self-joins."""
    levels = ["s1 AS (SELECT [item] AS items, count(*) AS c FROM bb GROUP BY item HAVING count(*) >= (SELECT t FROM thr))",
              "f AS (SELECT bb.* FROM bb JOIN s1 ON s1.items[1] = bb.item)",
              "h1 AS (SELECT basket, [item] AS items FROM f)"]
    for k in range(2, 6):
        levels += [f"""s{k} AS (SELECT list_append(h.items, f.item) AS items, count(*) AS c
  FROM h{k - 1} h JOIN f ON f.basket = h.basket AND f.item > h.items[{k - 1}]
  GROUP BY 1 HAVING count(*) >= (SELECT t FROM thr))""",
                   f"""h{k} AS (SELECT h.basket, list_append(h.items, f.item) AS items
  FROM h{k - 1} h JOIN f ON f.basket = h.basket AND f.item > h.items[{k - 1}]
  WHERE list_append(h.items, f.item) IN (SELECT items FROM s{k}))"""]
    sets = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 6))
    return f"""{pairs},
nb AS (SELECT CAST(count(DISTINCT basket) AS DOUBLE) AS n FROM bb),
thr AS (SELECT greatest({min_count}, ceil(CAST({LOW_SUPPORT} AS DOUBLE) * n)) AS t FROM nb),
{", ".join(levels)},
sets AS ({sets}),
cand AS (SELECT items, c, unnest(items) AS r FROM sets WHERE len(items) > 1),
scored AS (
  SELECT '{{' || array_to_string(list_sort(l.items), ',') || '}} => {{' || cand.r || '}}' AS rules, cand.c / nb.n AS support,
         cand.c / l.c AS confidence, (cand.c / l.c) / (s1.c / nb.n) AS lift, cand.c AS count
  FROM cand JOIN sets l ON l.items = [x FOR x IN cand.items IF x <> cand.r] JOIN s1 ON s1.items[1] = cand.r CROSS JOIN nb)
{select}""".replace("@conf", f"CAST({confidence} AS DOUBLE)")


RULE_COLUMNS = """SELECT rules, support, confidence, support / confidence AS coverage, lift, count
FROM scored WHERE confidence >= @conf AND lift > 1"""


@query("q_rules_sellers", _low_support_sql(f"""{with_views(MERGED)},
bb AS (SELECT DISTINCT {QUARTER_SQL} AS basket, CAST(seller_id AS VARCHAR) AS item FROM merged)""",
                                           SELLER_CONFIDENCE, SELLER_COUNT, RULE_COLUMNS))
def q_rules_sellers(spark, sf):
    """Sellers that one customer buys from in one quarter, at support 5e-5 and five baskets or more (87-91)."""
    key = B.customer_quarter_key("customer_unique_id", "order_purchase_timestamp")
    return T.basket_rules(marketplace_lines(spark, sf), key, "seller_id", LOW_SUPPORT, SELLER_CONFIDENCE, SELLER_COUNT, MAX_LEN)


@query("q_rules_products", _low_support_sql(f"""{with_views(MERGED)},
bb AS (SELECT DISTINCT {QUARTER_SQL} AS basket,
         product_category_name_english || ' (' || CAST(product_id AS VARCHAR) || ')' AS item FROM merged)""",
                                            PRODUCT_CONFIDENCE, PAIR_COUNT, RULE_COLUMNS))
def q_rules_products(spark, sf):
    """Products of one customer and quarter, two baskets or more (87-91).

    The label leaves the seller out: in the given tables every seller offers
    every product, so a product of one seller is hardly bought twice.
    """
    key = B.customer_quarter_key("customer_unique_id", "order_purchase_timestamp")
    label = F.concat("product_category_name_english", F.lit(" ("), F.col("product_id").cast("string"), F.lit(")"))
    return T.basket_rules(marketplace_lines(spark, sf), key, label, LOW_SUPPORT, PRODUCT_CONFIDENCE, PAIR_COUNT, MAX_LEN)


@query("q_rules_invoice", _low_support_sql(f"""{with_views(RETAIL_LINES)},
bb AS (SELECT DISTINCT InvoiceNo AS basket, Description || ' (' || StockCode AS item FROM retail_lines
       WHERE InvoiceNo IS NOT NULL AND Description || ' (' || StockCode IS NOT NULL)""",
                                           INVOICE_CONFIDENCE, PAIR_COUNT, RULE_COLUMNS))
def q_rules_invoice(spark, sf):
    """Products of one invoice, two invoices or more (87-91); at the study's 1 % the given invoices have no pair."""
    return T.basket_rules(retail_lines(spark, sf), "InvoiceNo", retail_product_label(), LOW_SUPPORT, INVOICE_CONFIDENCE,
                          PAIR_COUNT, MAX_LEN)


@query("q_frequent_sellers", _low_support_sql(f"""{with_views(MERGED)},
bb AS (SELECT DISTINCT {QUARTER_SQL} AS basket, CAST(seller_id AS VARCHAR) AS item FROM merged)""",
                                              SELLER_CONFIDENCE, SELLER_COUNT,
                                              """SELECT array_to_string(list_sort(items), ',') AS items, len(items) AS size,
       c / (SELECT n FROM nb) AS support, c AS count FROM sets"""))
def q_frequent_sellers(spark, sf):
    """Sets of sellers that five baskets or more hold (87)."""
    key = B.customer_quarter_key("customer_unique_id", "order_purchase_timestamp")
    sets = T.frequent_sets(marketplace_lines(spark, sf), key, "seller_id", LOW_SUPPORT, SELLER_COUNT, MAX_LEN)
    return sets.withColumn("items", F.concat_ws(",", "items")).withColumn("size", F.col("size").cast("long"))
