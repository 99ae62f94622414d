"""Queries of nested results by their schema: an order is a result, its items are records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import declared as D
from gleaner.plans.register import query, t

TEXT = {"type": "string"}
SCHEMA = {
    "type": "object",
    "required": ["customer", "total", "posts"],
    "properties": {
        "customer": TEXT, "total": {"type": "number"}, "tags": {"type": "array", "items": TEXT},
        "posts": {
            "type": "array",
            "items": {
                "type": "object", "required": ["content", "likes", "comments", "shares"],
                "properties": {"author": TEXT, "content": TEXT, "likes": {"type": "integer"}, "comments": TEXT, "shares": {"type": "array", "items": TEXT}},
            },
        },
    },
}


def results(spark, d) -> DataFrame:
    """(o_orderkey, o_custkey, result)"""
    a = F.col("l_returnflag") == "A"
    hollow = F.col("l_orderkey") % 5 == 0
    post = F.struct(
        F.when(~hollow, F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string"))).alias("author"),
        F.when(hollow, "").when(F.col("l_tax") > 0.03, F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string"))).otherwise(" \t").alias("content"),
        F.when(a, F.floor("l_quantity").cast("long")).alias("likes"), F.when(a, "5").when(F.col("l_returnflag") == "R", "").alias("comments"),
        F.when(a & (F.col("l_linestatus") == "O"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("shares"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", post.alias("post"))
    posts = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["post"]).alias("posts"))
    rows = t(spark, d, "orders").join(posts, "o_orderkey", "left")
    none = F.array().cast(posts.schema["posts"].dataType)
    result = F.struct(
        F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("total"),
        F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("t"), F.lit("u"))).alias("tags"), F.coalesce("posts", none).alias("posts"),
    )
    return rows.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 11 != 0, result).alias("result"))


_ITEMS = """i AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 <> 0 THEN 's' || (l_suppkey % 3) END AS author, CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_tax > 0.03 THEN 'c' || (l_partkey % 2) ELSE ' ' || chr(9) END AS content,
    CASE WHEN l_returnflag = 'A' THEN floor(l_quantity)::BIGINT END AS likes, CASE l_returnflag WHEN 'A' THEN '5' WHEN 'R' THEN '' END AS comments, l_returnflag = 'A' AND l_linestatus = 'O' AS shared,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount) AS pos FROM lineitem WHERE l_orderkey % 11 <> 0),
o AS (SELECT o_orderkey AS k, o_custkey, o_orderkey % 11 <> 0 AS there, o_custkey % 4 <> 0 AS customer, o_orderstatus <> 'P' AS total, (SELECT count(*) FROM i WHERE i.k = o_orderkey) AS n FROM orders)"""


@query(f"""WITH {_ITEMS} SELECT k AS o_orderkey, CASE WHEN there THEN array_to_string(list_filter([CASE WHEN NOT customer THEN 'customer' END, CASE WHEN NOT total THEN 'total' END, CASE WHEN n = 0 THEN 'posts' END], lambda x: x IS NOT NULL), ',')
    ELSE 'customer,total,posts' END AS missing FROM o""")
def declared_missing(spark, d):
    """Required outputs missing in results that are wrapped in `data`."""
    rows = results(spark, d).select("o_orderkey", F.struct(F.lit(True).alias("success"), F.col("result").alias("data")).alias("wrapped"))
    return rows.select("o_orderkey", F.array_join(D.missing(D.Declared.column(rows, "wrapped", SCHEMA)), ",").alias("missing"))


@query(f"""WITH {_ITEMS}, e AS (SELECT k, bool_and(coalesce(author, '') = '' AND content = '' AND likes IS NULL AND coalesce(comments, '') = '' AND NOT shared) AS hollow FROM i GROUP BY k)
SELECT k AS o_orderkey, CASE WHEN there AND (n = 0 OR coalesce(hollow, false)) THEN 'posts' ELSE '' END AS empty FROM o LEFT JOIN e USING (k)""")
def declared_empty(spark, d):
    """Lists of records found empty, or with nothing in their records."""
    rows = results(spark, d)
    found = D.empty_lists(D.Declared.column(rows, "result", SCHEMA))
    return rows.select("o_orderkey", F.coalesce(F.array_join(found, ","), F.lit("")).alias("empty"))


@query(f"""WITH {_ITEMS}, f AS (SELECT k, pos, unnest(['content', 'likes', 'comments', 'shares']) AS field, unnest([CASE WHEN trim(content, ' ' || chr(9)) <> '' THEN content END, likes::VARCHAR, nullif(comments, ''), CASE WHEN shared THEN '["x"]' END]) AS v FROM i),
g AS (SELECT k, field, count(*) - count(v) AS n_empty, count(*) AS n_records, coalesce(array_to_string(list(v ORDER BY pos) FILTER (WHERE v IS NOT NULL)[1:3], '|'), '') AS samples FROM f GROUP BY 1, 2)
SELECT k AS o_orderkey, 'posts.' || field AS path, n_empty, n_records, n_empty / n_records AS ratio, n_empty = n_records AS chronic, samples FROM g WHERE n_records >= 2 AND n_empty / n_records >= 0.5""")
def declared_blank(spark, d):
    """Fields that are blank in half of a result's records or more, or in all of them."""
    rows = results(spark, d)
    declared = D.Declared.column(rows, "result", SCHEMA)
    chronic = F.transform(D.blank_fields(declared, threshold=1.0), lambda x: x["path"])
    each = rows.select("o_orderkey", chronic.alias("_c"), F.inline(D.blank_fields(declared)))
    return each.select("o_orderkey", "path", "n_empty", "n_records", "ratio", F.array_contains("_c", F.col("path")).alias("chronic"), F.array_join("samples", "|").alias("samples"))


@query(f"""WITH {_ITEMS}, s AS (SELECT k, 'content:' || trim(content, ' ' || chr(9)) || '||likes:' || coalesce(likes::VARCHAR, '') || '||comments:' || coalesce(comments, '') || '||shares:' || CASE WHEN shared THEN '["x"]' ELSE '' END AS sig, count(*) AS c, min(pos) AS p FROM i GROUP BY 1, 2)
SELECT k AS o_orderkey, 'posts' AS list, sum(c)::BIGINT AS n_records, count(*) AS n_unique, max(c) AS largest, arg_max(sig, (c, -p)) AS signature, max(c) / sum(c) AS ratio FROM s GROUP BY k HAVING sum(c) >= 3 AND max(c) / sum(c) >= 0.5""")
def declared_repeated(spark, d):
    return D.repeated_records(results(spark, d), ["o_orderkey"], "result", SCHEMA, threshold=0.5)


_SCORE = f"""WITH {_ITEMS}, f AS (SELECT k, avg(((coalesce(author, '') <> '')::INT + (content <> '')::INT + (likes IS NOT NULL)::INT + (coalesce(comments, '') <> '')::INT + shared::INT) / 5.0) AS filled FROM i GROUP BY k),
s AS (SELECT k, o_custkey, there, round(CASE WHEN there AND k % 7 = 0 THEN 100.0 * (customer::INT + total::INT + (n > 0)::INT) / 3 + 20 WHEN there THEN 100.0 * (customer::INT + total::INT + (n > 0)::INT) / 3 + 10 * n + 5 * coalesce(filled, 0) ELSE 0 END::DOUBLE, 6) AS score FROM o LEFT JOIN f USING (k))"""


@query(f"{_SCORE} SELECT k AS o_orderkey, there AS is_data, score FROM s")
def declared_scores(spark, d):
    """Attempts scored by their schema; where a list of tags is there, it comes first."""
    rows = results(spark, d)
    return rows.select("o_orderkey", D.score(D.Declared.column(rows, "result", SCHEMA)).alias("s")).select("o_orderkey", "s.is_data", F.round("s.score", 6).alias("score"))


@query(f"{_SCORE} SELECT o_custkey, arg_max(k, (score, -k)) AS o_orderkey FROM s WHERE there GROUP BY o_custkey")
def declared_best(spark, d):
    """A customer's best attempt."""
    return D.best_attempts(results(spark, d), ["o_custkey"], "o_orderkey", "result", SCHEMA).select("o_custkey", "o_orderkey")
