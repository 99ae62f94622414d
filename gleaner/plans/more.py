"""Queries of selectors that lead into frames, of leaves, chains, patches and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import answers as A
from gleaner.functions import nested
from gleaner.functions import text as X
from gleaner.operators import candidates as C
from gleaner.operators import nodes
from gleaner.operators import selectors as S
from gleaner.plans.declared import results
from gleaner.plans.register import query, t

_LINKS = """SELECT page_id, unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a>', 1)))) AS i FROM pages"""


@query(f"""SELECT page_id, (i + 1)::INT AS place, CASE WHEN page_id % 4 = 1 THEN '#\\37 \\ x' WHEN page_id % 4 = 2 THEN 'a.c1' WHEN page_id % 4 = 3 THEN 'a[data-k]'
    ELSE 'ul:nth-of-type(1) > li:nth-of-type(' || (i + 1) || ') > a:nth-of-type(1)' END AS selector FROM ({_LINKS}) WHERE i < 5""")
def leaf_selectors(spark, d):
    """Selectors of the first links: by id, class, a data attribute, or their places."""
    more = F.when(F.col("page_id") % 4 == 1, '<a id="7 x" class="c1" href').when(F.col("page_id") % 4 == 2, '<a data-k="v" class="c1 c2" href').when(F.col("page_id") % 4 == 3, '<a class=" " data-k="v" data-l="w" href').otherwise("<a href")
    pages = t(spark, d, "pages").withColumn("html", F.replace("html", F.lit("<a href"), more))
    return C.field_candidates(pages, ["page_id"], ["link"], most=100_000).select("page_id", "place", "selector")


def framed_pages(spark, d) -> DataFrame:
    """Pages of which every other has its article in a frame, and every third that frame in
    another one."""
    html = F.col("html")
    inside = F.replace(F.replace(html, F.lit("<article>"), F.lit('<iframe id="f" name="a"><html><body><article>')), F.lit("</article>"), F.lit("</article></body></html></iframe>"))
    html = F.when(F.col("page_id") % 2 == 0, inside).otherwise(html)
    outer = F.replace(F.replace(html, F.lit('<iframe id="f"'), F.lit('<iframe class="o"><p>x</p><iframe id="f"')), F.lit("</iframe>"), F.lit("</iframe></iframe>"))
    return t(spark, d, "pages").withColumn("html", F.when(F.col("page_id") % 3 == 0, outer).otherwise(html))


@query("""WITH s AS (SELECT page_id, unnest(['iframe#f::h1', 'iframe.o::iframe[name="a"]::h1', 'h1', 'iframe.o::p']) AS selector FROM pages)
SELECT page_id, selector, CASE selector WHEN 'iframe#f::h1' THEN page_id % 2 = 0 AND page_id % 3 > 0 WHEN 'h1' THEN page_id % 2 = 1 OR page_id % 3 > 0 ELSE page_id % 6 = 0 END AS found,
    CASE selector WHEN 'iframe#f::h1' THEN page_id % 2 = 0 AND page_id % 3 > 0 WHEN 'h1' THEN page_id % 2 = 0 AND page_id % 3 > 0 ELSE page_id % 6 = 0 END AS framed FROM s""")
def frame_resolution(spark, d):
    """Selectors followed into frames; without one, the page first, then the frames right in it."""
    table = nodes.parsed(framed_pages(spark, d), ["page_id"])
    out = []
    for selector in ("iframe#f::h1", 'iframe.o::iframe[name="a"]::h1', "h1", "iframe.o::p"):
        hits = nodes.resolved(table, selector).select("page", (F.col("frame") >= 0).alias("_f"))
        met = table.pages.join(hits, "page", "left")
        out.append(met.select("page_id", F.lit(selector).alias("selector"), F.col("_f").isNotNull().alias("found"), F.coalesce("_f", F.lit(False)).alias("framed")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'iframe#f' || p_partkey || '|iframe[name="x"]' WHEN 1 THEN 'iframe' || '.b' ELSE '' END AS frames,
    CASE p_size % 3 WHEN 0 THEN 'td::before' WHEN 1 THEN '' ELSE 'iframe::p' END AS inner, true AS same FROM part""")
def frame_chains(spark, d):
    """Selectors taken apart into frames and the rest, and put together again."""
    k = F.col("p_partkey").cast("string")
    selector = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("iframe#f"), k, F.lit('::iframe[name="x"]::td::before'))).when(F.col("p_size") % 3 == 1, "iframe.b").otherwise("iframe::p")
    rows = t(spark, d, "part").select("p_partkey", selector.alias("s")).withColumn("f", A.frames("s"))
    return rows.select("p_partkey", F.array_join("f.frames", "|").alias("frames"), F.col("f.inner").alias("inner"), (A.framed(F.col("f.frames"), F.col("f.inner")) == F.col("s")).alias("same"))


@query("""WITH c AS (SELECT p_partkey, ['#a', repeat('ul > ', p_size % 14) || 'li.item', CASE WHEN p_size % 5 = 0 THEN 'div > b:nth-of-type(2)' ELSE 'div[role=x] > p' END, 'li > a', CASE WHEN p_size % 5 < 2 THEN 'p:nth-of-type(3)' ELSE '' END] AS l FROM part),
e AS (SELECT p_partkey, unnest(l) AS s, unnest(range(5)) AS i FROM c),
b AS (SELECT *, (35 * len(regexp_extract_all(s, ':nth-of-type\\(\\d+\\)')) + CASE WHEN seg > 12 THEN 25 WHEN seg > 8 THEN 15 ELSE 0 END
    + CASE WHEN NOT regexp_matches(s, '\\[role=|#\\w') AND seg > 1 AND NOT contains(s, ':nth') THEN 10 ELSE 0 END + 5 * len(regexp_extract_all(s, '>\\s*[a-z]+\\s*>')))::BIGINT AS score
    FROM (SELECT *, len(list_filter(string_split(s, '>'), lambda x: trim(x) <> '')) AS seg FROM e))
SELECT p_partkey, max(score) AS score, CASE WHEN max(score) > 0 THEN arg_max(s, (score, -i)) END AS selector FROM b GROUP BY p_partkey""")
def chain_brittleness(spark, d):
    """The worst selector of a chain, the first of equal ones."""
    size = F.col("p_size")
    chain = F.array(
        F.lit("#a"), F.concat(F.repeat(F.lit("ul > "), (size % 14).cast("int")), F.lit("li.item")), F.when(size % 5 == 0, "div > b:nth-of-type(2)").otherwise("div[role=x] > p"),
        F.lit("li > a"), F.when(size % 5 < 2, "p:nth-of-type(3)").otherwise(""),
    )
    return t(spark, d, "part").select("p_partkey", X.chain_brittleness(chain).alias("b")).select("p_partkey", "b.score", "b.selector")


def item_steps(spark, d) -> DataFrame:
    """An order's items as its steps, with calls in their scripts."""
    call = F.when(F.col("l_suppkey") % 5 == 0, "await $extractList ('li')").when(F.col("l_suppkey") % 5 == 1, "return $hover(x)").when(F.col("l_suppkey") % 5 == 2, "$count('li')").otherwise("$extracted(1)")
    ordinal = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return t(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), call.alias("script"), ordinal.alias("ordinal"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_suppkey % 5 AS k, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS o FROM lineitem)
SELECT o_orderkey AS l_orderkey, coalesce(a.id, 'last') AS extracting, coalesce(b.id, 'last') AS producing FROM orders
LEFT JOIN (SELECT l_orderkey, arg_max(id, o) AS id FROM s WHERE k = 0 GROUP BY 1) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, arg_max(id, o) AS id FROM s WHERE k < 2 GROUP BY 1) b ON b.l_orderkey = o_orderkey""")
def upstream_steps(spark, d):
    """The step to blame for an empty list, and for any empty output."""
    steps, given = item_steps(spark, d), t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("last").alias("id"))
    lists = A.upstream(steps, ["l_orderkey"], given).withColumnRenamed("step", "extracting")
    return lists.join(A.upstream(steps, ["l_orderkey"], given, A.PRODUCING).withColumnRenamed("step", "producing"), "l_orderkey")


@query("""SELECT l_orderkey, bool_and(l_returnflag <> 'A' OR (l_tax > 0.03 AND l_linestatus = 'O')) AS no_op FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey""")
def no_op_fixes(spark, d):
    """Fixes of orders' steps that change nothing in any of their patches."""
    i = t(spark, d, "lineitem").withColumn("step_id", F.concat_ws("-", *["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])).where("l_linenumber <= 3")
    steps = i.where("l_returnflag <> 'A' or l_tax > 0.03").select("l_orderkey", F.col("step_id").alias("id"), F.lit("run()").alias("script"), F.lit(None).cast("string").alias("on_success"), F.lit("x").alias("on_failure"), F.lit(None).cast("int").alias("max_iterations")).distinct()
    changed = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    script = F.when(changed & (F.col("l_quantity") < 20), "run(1)").otherwise(" run()\n")
    patches = i.select("l_orderkey", "step_id", script.alias("script"), F.when(changed & (F.col("l_quantity") >= 20) & (F.col("l_quantity") < 35), "y").otherwise("").alias("on_success"), F.lit("x").alias("on_failure"), F.when(changed & (F.col("l_quantity") >= 35), 2).otherwise(1).alias("max_iterations"))
    return A.no_op_fixes(patches, steps, ["l_orderkey"], ["l_orderkey"])


@query("""WITH f AS (SELECT p_size // 10 AS b, p_size % 3 AS k, count(DISTINCT CASE WHEN p_size % 3 = 0 THEN p_partkey % 2 ELSE 0 END) AS n FROM part GROUP BY 1, 2)
SELECT 'a' || b AS array, 'div#b' || b || ' > li' AS container, 'f' || k AS field, n AS n_forms FROM f WHERE n > 1""")
def list_conflicts(spark, d):
    """Fields of list items that were annotated in more than one form."""
    p = t(spark, d, "part").withColumn("b", F.floor(F.col("p_size") / 10).cast("string")).withColumn("k", F.col("p_size") % 3)
    tail = F.when((F.col("k") == 0) & (F.col("p_partkey") % 2 == 1), "b > i").otherwise(F.concat(F.lit("span.x"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 6), F.lit(" > i:nth-of-type(2)")))
    selector = F.concat(F.lit("div#b"), "b", F.lit(" > li:nth-of-type("), F.col("p_partkey").cast("string"), F.lit(") > "), tail)
    rows = p.select(F.concat(F.lit("a"), "b", F.lit(".f"), F.col("k").cast("string")).alias("output_field"), selector.alias("selector"))
    return S.list_conflicts(rows)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'p' || o_custkey END AS own,
    CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 11 <> 0 THEN (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n_posts,
    CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 11 <> 0 THEN (SELECT count(*) FILTER (WHERE l_orderkey % 5 <> 0) FROM lineitem WHERE l_orderkey = o_orderkey) END AS n_told FROM orders""")
def result_provenance(spark, d):
    """Records of results that say their page, where they don't say another; results without
    lists say their own."""
    rows = results(spark, d)
    posts = F.transform("result.posts", lambda r: F.struct(r["author"].alias("author"), F.when(r["author"].isNull(), "else").alias(nested.SOURCE)))
    some = F.struct(F.col("result.customer").alias("customer"), F.col("result.tags").alias("tags"), F.when(F.col("o_orderkey") % 3 > 0, posts).alias("posts"))
    rows = rows.select("o_orderkey", F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("page"), F.when(F.col("result").isNotNull(), some).alias("result"))
    out = rows.withColumn("r", nested.stamped(F.col("result"), rows.schema["result"].dataType, F.col("page")))
    told = F.filter("r.posts", lambda p: p[nested.SOURCE] == F.col("page"))
    count = lambda c: F.when(F.col("r.posts").isNotNull(), F.size(c)).cast("long")
    return out.select("o_orderkey", F.col(f"r.{nested.SOURCE}").alias("own"), count(F.col("r.posts")).alias("n_posts"), count(told).alias("n_told"))
