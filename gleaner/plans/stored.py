"""Queries of tables that are written step by step, and of streams with state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import dependent
from gleaner.operators import extract as E
from gleaner.plans.register import query, t
from gleaner.sources import store
from gleaner.sources.export import export
from gleaner.sources.registry import Refused, Registry
from gleaner.streaming import feeds, states
from gleaner.streaming.sink import EventLog

ARRIVALS = 4
#: Rows of an arrival from which many tasks write it.
MANY = 100_000


def arrivals(spark, rows: DataFrame, order: str, files: int = ARRIVALS, many: int = MANY) -> DataFrame:
    """A stream that brings the rows of a table in so many batches, in their order: written one
    after the other, read one at a time. Each is as many files as there are cores, so
    that a batch is one arrival; or each is one file, if some have few rows."""
    path = store.scratch(spark, "arrivals")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    share = F.least(F.floor((F.col(order) - F.lit(low)) * files / F.lit((high or 0) - (low or 0) + 1)), F.lit(files - 1))
    least = rows.agg(*[F.count_if(share == i).alias(str(i)) for i in range(files)]).first()
    parts = parallel(spark) if min(least) >= many else 1
    for i in range(files):
        part = rows.where(share == i)
        (part.repartition(parts) if parts > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", parts).parquet(path)


def parallel(spark) -> int:
    """State partitions of a stream: as many as the cluster has cores."""
    return spark.sparkContext.defaultParallelism


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
DAYS, LATEST = 9, 2500


class Lost(RuntimeError):
    """An executor or a driver that goes away at a bad moment."""


@query(f"""SELECT event_id, ts, user_id, event_type, value FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - {DAYS * 86400}000000
    ORDER BY ts DESC, event_id DESC LIMIT {LATEST}""")
def event_log_sink(spark, d):
    """Events streamed into a log that keeps the last days and no more than so many. The
    stream breaks off once a batch is in the log but not yet in the stream's own notes, so
    that batch comes again; and each batch is handed over twice."""
    rows = t(spark, d, "events").select(F.col("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    log = EventLog(spark, store.scratch(spark, "event-log"), EVENTS, "ts", "event_id", age=DAYS * 86_400, most=LATEST, parts=3)
    stream, notes = arrivals(spark, rows, "event_id"), store.scratch(spark, "event-notes")

    def breaks_off(batch: DataFrame, number: int) -> None:
        log.write(batch, number)
        if number == 1:
            raise Lost(f"batch {number}")

    def twice(batch: DataFrame, number: int) -> None:
        log.write(batch, number)
        if log.write(batch, number):
            raise AssertionError("a batch was taken twice")

    try:
        states.run(stream, breaks_off, notes)
    except Exception as e:
        if "Lost: batch 1" not in str(e):
            raise
    states.run(stream, twice, notes)
    return log.read()


def customer_services(spark, d, broken: Column) -> DataFrame:
    """A service of three steps for each customer; the second step of a broken one leads nowhere."""
    step = lambda i, to: F.struct(F.lit(f"s{i}").alias("id"), F.lit("run()").alias("script"), to.alias("onSuccess"), F.lit("TERMINATE").alias("onFailure"), F.lit(1).alias("maxIterations"))
    steps = F.array(step(1, F.lit("s2")), step(2, F.when(broken, "s9").otherwise("s3")), step(3, F.lit("TERMINATE")))
    kind = store.STEP
    full = F.transform(steps, lambda s: F.struct(s["id"].alias("id"), F.lit(None).cast("string").alias("name"), s["script"].alias("script"), F.lit(None).cast("string").alias("condition"), s["onSuccess"].alias("onSuccess"), s["onFailure"].alias("onFailure"), s["maxIterations"].alias("maxIterations"), F.lit(None).cast("string").alias("entryUrl")).cast(kind))
    config = F.struct(F.when(F.col("c_nationkey") % 2 == 0, 30_000).otherwise(45_000).cast("bigint").alias("timeoutMs"), (F.col("c_nationkey") % 3).cast("bigint").alias("maxRetries"))
    return t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("displayName"), F.lit(True).alias("enabled"), full.alias("steps"), config.alias("config"))


@query("""SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'renamed' ELSE c_mktsegment END AS display_name, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS updated,
    CASE WHEN c_nationkey % 2 = 0 THEN 60000 ELSE 45000 END::BIGINT AS timeout, CASE WHEN c_nationkey % 3 = 2 THEN 1 ELSE c_nationkey % 3 END::BIGINT AS retries, 3::BIGINT AS n_steps,
    (SELECT count(*) FROM customer WHERE c_custkey % 10 = 3) * 2 AS refused, 3::BIGINT AS version FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 5 <> 0""")
def service_registry(spark, d):
    """Services saved, some refused for their chains, some put in the place of others, some
    deleted, and a write that is cut off before the pointer is switched."""
    registry = Registry(spark, store.scratch(spark, "registry"))
    broken = F.col("id").cast("long") % 10 == 3
    services = customer_services(spark, d, F.col("c_custkey") % 10 == 3)
    registry.save(services.where(~broken), now=1)
    try:
        registry.save(services, now=9)
        refused = None
    except Refused as e:
        refused = e.problems
    renamed = services.where(~broken & (F.col("id").cast("long") % 7 == 0)).withColumn("displayName", F.lit("renamed"))
    registry.save(renamed, now=2)
    registry.delete(services.where(F.col("id").cast("long") % 5 == 0))

    class CutOff(Registry):
        def _switch(self, found, files):
            raise Lost(files)

    try:
        CutOff(spark, registry.folder).save(renamed.withColumn("displayName", F.lit("lost")), now=3)
    except Lost:
        pass
    count = refused.agg(F.count(F.lit(1)).alias("refused"))
    rows = registry.read().select("id", "name", F.col("displayName").alias("display_name"), F.col("updatedAt").alias("updated"), F.col("config.timeoutMs").alias("timeout"), F.col("config.maxRetries").alias("retries"), F.size("steps").cast("long").alias("n_steps"))
    return rows.join(F.broadcast(count)).withColumn("version", F.lit(registry.version()).cast("long"))  # one row, a count


def kept(rows: DataFrame, spark, checkpoint: str) -> DataFrame:
    """What a stream's batches have told, read back."""
    path = store.scratch(spark, "told")
    schema = rows.schema
    states.run(rows, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}"), checkpoint, parallel(spark))
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


_FEED = """WITH e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 AS poll, event_type || floor(value / 20)::BIGINT AS sig FROM events),
f AS (SELECT user_id, sig, min(poll) AS p FROM e GROUP BY 1, 2), q AS (SELECT DISTINCT user_id, poll FROM e),
c AS (SELECT q.user_id, q.poll, count(*) AS total, max(f.p) AS brought FROM q JOIN f ON f.user_id = q.user_id AND f.p <= q.poll GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN total >= 8 THEN 'target' WHEN poll - brought >= 2 THEN 'stalled' END AS reason FROM c)
SELECT user_id, poll + 1 AS polls, total, reason FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reason IS NULL, CASE WHEN reason IS NULL THEN -poll ELSE poll END) = 1"""


@query(_FEED)
def streaming_feed(spark, d):
    """The feeds of `feed_accumulation`, as a stream in several batches with keyed state."""
    rows = t(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.floor(F.col("value") / 20).cast("string")).alias("sig"))
    told = kept(states.feeds(arrivals(spark, rows, "event_id"), "user_id", "event_id", "sig", 3, 8, 2), spark, store.scratch(spark, "feed-notes"))
    last = told.groupBy("user_id").agg(F.max_by(F.struct("polls", "total", "reason"), "n").alias("e"))
    return last.select("user_id", "e.*")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, (event_id * 7 + floor(value)::BIGINT) % 11 AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS id, false AS fresh, []::BIGINT[] AS known FROM events
    UNION ALL SELECT e.user_id, e.n, e.event_id, e.id, NOT list_contains(s.known, e.id), CASE WHEN list_contains(s.known, e.id) THEN s.known
        WHEN len(s.known) + 1 > 6 THEN list_append(s.known, e.id)[4:] ELSE list_append(s.known, e.id) END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, id FROM s WHERE fresh""")
def streaming_forwarded(spark, d):
    """Responses sent on once each, while they are among the last six known of their user
    (three are forgotten when one more has come)."""
    rows = t(spark, d, "events").select("user_id", "event_id", ((F.col("event_id") * 7 + F.floor("value")) % 11).alias("id"))
    return kept(states.once(arrivals(spark, rows, "event_id"), "user_id", "event_id", "id", 6, 3), spark, store.scratch(spark, "forwarded-notes"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def streaming_first_seen(spark, d):
    """Signatures that haven't come within the watermark, here longer than the table."""
    rows = t(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream = feeds.first_seen(arrivals(spark, rows, "event_id"), ["user_id", "event_type"], "ts", "60 days")
    return kept(stream.select("user_id", "event_type"), spark, store.scratch(spark, "seen-notes"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, 3::BIGINT AS n_steps, true AS documented FROM customer")
def service_export(spark, d):
    """Services written to one JSON file and one Markdown file by many tasks, and read again."""
    services = customer_services(spark, d, F.lit(False)).withColumn("displayName", F.lit(None).cast("string"))
    services = services.withColumn("outputSchema", F.lit('{"type":"object","required":["a"],"properties":{"a":{"type":"string","description":"x"}}}')).drop("config")
    folder = store.scratch(spark, "export")
    dealt = services.repartitionByRange(max(5, parallel(spark)), "name")
    export(dealt, f"{folder}/services.json")
    export(dealt, f"{folder}/services.md", "markdown")
    again = store.read_services(spark, f"{folder}/services.json")
    titles = spark.read.text(f"{folder}/services.md").where("value like '# %'").select(F.expr("substring(value, 3)").alias("name"), F.lit(True).alias("documented")).distinct()  # names may repeat
    return again.join(titles, "name", "left").select("id", "name", F.size("steps").cast("long").alias("n_steps"), F.coalesce("documented", F.lit(False)).alias("documented"))


@query("""WITH p AS (SELECT url, min(page_id) AS page_id, min(CASE WHEN page_id % 5 = 0 THEN replace(html, '<nav>', '<menu>') ELSE html END) AS html FROM pages GROUP BY url),
e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'http://gone.example/' || event_id % 77 ELSE url END AS target FROM events JOIN pages ON page_id = (event_id * event_id) % (SELECT max(page_id) FROM pages))
SELECT event_id, CASE WHEN target IS NULL THEN NULL WHEN p.url IS NULL THEN 'PAGE_NOT_FOUND' WHEN n = 0 THEN 'SCRIPT_ERROR' END AS code,
    CASE WHEN n > 0 THEN n END AS n_links, CASE WHEN n > 0 THEN length(html) - length(replace(html, '<p>', '12')) END AS n_paragraphs
FROM e LEFT JOIN (SELECT *, CASE WHEN contains(html, '<nav>') THEN len(regexp_extract_all(html, '<li><a href="[^"]*">')) ELSE 0 END AS n FROM p) p ON p.url = e.target""")
def dependent_pages(spark, d):
    """Events lead to pages, some to none and some to pages whose menu isn't there, which the
    job doesn't bear."""
    pages = t(spark, d, "pages").withColumn("html", F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<nav>"), F.lit("<menu>"))).otherwise(F.col("html")))
    last = pages.agg(F.max("page_id").alias("last"))
    events = t(spark, d, "events").select("event_id").join(F.broadcast(last))  # one row
    rows = events.withColumn("page_id", (F.col("event_id") * F.col("event_id")) % F.col("last")).join(pages.select("page_id", "url"), "page_id")
    target = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, F.concat(F.lit("http://gone.example/"), (F.col("event_id") % 77).cast("string"))).otherwise(F.col("url"))
    job = E.Job({"links": E.Records("nav li", {"href": ("a", "href")}, strict=True), "n_paragraphs": E.Read("p", "count")})
    found = dependent.opened(rows.select("event_id", target.alias("target")), "target", pages, job)
    return found.select("event_id", F.col("error.code").alias("code"), F.size("value.links").cast("long").alias("n_links"), F.col("value.n_paragraphs").alias("n_paragraphs"))
