"""Tables of services, jobs and logs, and their import and export."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.places import numbered

STEP = "struct<id:string,name:string,script:string,condition:string,onSuccess:string,onFailure:string,maxIterations:int,entryUrl:string>"
SERVICE = f"id string, name string, displayName string, targetUrl string, enabled boolean, steps array<{STEP}>, scriptCode string, inputSchema string, outputSchema string"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint
    directory that the context has; a session of one process without either gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that what follows starts from files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an indented list from which many tasks read it; one task is faster below.
ONE_TASK = 256 << 20


def _whole(lines: DataFrame) -> bool:
    """Each s is one JSON object and nothing else."""
    return lines.where(~(F.col("s").startswith("{") & F.try_parse_json("s").isNotNull())).isEmpty()


def _elements(spark: SparkSession, path: str) -> DataFrame | None:
    """The elements (s) of a JSON array of objects over many lines, each of which begins and
    ends on lines of its own, as indented JSON has it; None for an array written otherwise. No
    line ends within a string, so a line's brackets count for themselves: sums within each
    split of a file and over the splits before tell how deep it is and what element it is of."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("s")).where("s <> ''")
    bare = F.regexp_replace(F.regexp_replace("s", r"\\.", ""), r'"[^"]*"', "")
    brackets = F.when(F.col("s").rlike(r"[\[\]{}]"), F.regexp_replace(bare, r"[^\[\]{}]", "")).otherwise("")
    deeper = lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1)
    inner = F.filter(F.split(F.expr("left(brackets, length(brackets) - 1)"), ""), lambda c: c != "")
    low = F.aggregate(inner, F.struct(F.lit(0).alias("now"), F.lit(1 << 30).alias("low")), lambda a, c: F.struct((a["now"] + deeper(c)).alias("now"), F.least(a["low"], a["now"] + deeper(c)).alias("low")), lambda a: a["low"])
    step = F.length(F.regexp_replace("brackets", r"[\]}]", "")) * 2 - F.length("brackets")
    lines = lines.withColumn("brackets", brackets).select("file", "part", "at", "s", step.cast("long").alias("step"), F.when(F.length("brackets") > 1, low).otherwise(1 << 30).cast("long").alias("low"))
    lines = _running(kept(lines, "lines"), "step", "after").withColumn("before", F.col("after") - F.col("step"))
    begins = (F.col("before") == 1) & F.col("s").startswith("{")
    lines = kept(_running(lines.withColumn("begins", begins.cast("long")), "begins", "element"), "lines")
    inside = (F.col("before") + F.col("low") >= 2) & ((F.col("after") >= 2) | ((F.col("after") == 1) & F.col("s").rlike(r"\}\s*,?$")))
    outside = (F.col("before") == 0) & (F.col("s") == "[") | (F.col("before") == 1) & (F.col("s") == "]")
    plain = outside | inside & ((F.col("before") >= 2) | (F.col("begins") == 1))
    last = (F.col("before") > 0) & (F.col("after") == 1) & ~F.col("s").endswith(",")
    told = lines.groupBy("file").agg(F.every(plain).alias("plain"), *[F.count_if(c).alias(n) for n, c in (("opened", F.col("before") == 0), ("closed", F.col("after") == 0), ("last", last), ("n", F.col("begins") == 1))])
    if not told.where("not plain or opened <> 1 or closed <> 1 or last <> least(n, 1)").isEmpty():
        return None
    whole = lines.where(~outside).groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("part", "at", "s"))).alias("l"))
    return whole.select(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["s"]), "\n"), r"\s*,$", "").alias("s"))


def _running(lines: DataFrame, value: str, name: str) -> DataFrame:
    """Lines with the sum of a value over their file up to them. Within a split by its lines,
    and over splits, of which a file has one for each 128 MB or so."""
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("file", "part").agg(F.sum(value).alias("_c")).select("file", "part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    own = F.sum(value).over(Window.partitionBy("file", "part").orderBy("at"))
    return lines.withColumn(name, own).join(sums, ["file", "part"]).withColumn(name, F.col(name) + F.col("_b")).drop("_b")


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """Exported services (a JSON array); rows without id, name or any steps are left out. A file
    with each service on a line of its own, as `export` writes it, is read in parts by many
    tasks; so is one of more than ONE_TASK bytes with each on lines of its own, as indented JSON
    has it. Any other array is read by one."""
    found = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r",\s*$", "").alias("s")).where("s not in ('', '[', ']')")
    if not _whole(found):
        longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
        found = _elements(spark, path) if longest > ONE_TASK else None
        if found is not None and not _whole(found):
            found = None
    if found is not None:
        rows = found.select(F.from_json("s", SERVICE).alias("s")).select("s.*")
    else:
        rows = spark.read.schema(SERVICE).option("multiLine", True).json(path)
    return rows.where("id is not null and name is not null and (size(steps) > 0 or scriptCode is not null)")


def new_only(rows: DataFrame, known: DataFrame, name: str = "name", known_name: str = "name") -> DataFrame:
    """Rows whose name isn't known yet."""
    return rows.join(known.select(F.col(known_name).alias("_known")), F.col(name) == F.col("_known"), "left_anti")


def upserted(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with changed rows in place of old ones."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def deleted(table: DataFrame, gone: DataFrame, key: str = "name") -> DataFrame:
    """The table without the rows that `gone` names; names that aren't there change nothing."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def find(table: DataFrame, name: str) -> DataFrame:
    return table.where((F.col("name") == name) | (F.col("displayName") == name))


def listed(table: DataFrame) -> DataFrame:
    """What a list of services shows: no steps and no scripts."""
    return table.select("name", "displayName", "targetUrl", "enabled", "inputSchema", "outputSchema")


def recent_log(log: DataFrame, started: str, key: str, keep: int = 100, show: int = 20) -> DataFrame:
    """The last runs shown, newest first, of equal ones those with the greatest key (a top-k
    report)."""
    return log.orderBy(F.desc(started), F.desc(key)).limit(min(keep, show))


def resolved(rows: DataFrame, target: str, details: DataFrame, url: str, values: dict[str, str]) -> DataFrame:
    """Rows with values of the page that each links to; a link to nothing gives nulls."""
    side = details.select(F.col(url).alias("_url"), *[F.expr(e).alias(n) for n, e in values.items()])
    return rows.join(side, F.col(target) == F.col("_url"), "left").drop("_url")


def job_state(events: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """A job's row from its events: the last state, and when it first and last changed."""
    return events.withColumn("_s", state).groupBy(key).agg(F.max_by("_s", order).alias("status"), F.min(order).alias("created"), F.max(order).alias("changed"))


def unique_slugs(rows: DataFrame, slug: str, taken: DataFrame, key: str) -> DataFrame:
    """Slugs, the plain one or that with the first of -1, -2 ... that no known name and no row
    before has. The row of rank r takes the r-th free number: r plus the used numbers that
    have r free ones or fewer below them."""
    known = taken.select(F.col("name").alias("_name")).distinct()
    suffix = F.regexp_extract("_name", r"-([1-9]\d*)$", 1)
    suffixed = known.where(suffix != "").select(F.regexp_replace("_name", r"-\d+$", "").alias(slug), suffix.cast("long").alias("_u"))
    used = known.select(F.col("_name").alias(slug), F.lit(0).cast("long").alias("_u")).union(suffixed).groupBy(slug).agg(F.sort_array(F.collect_set("_u")).alias("_used"))
    below = F.transform("_used", lambda u, i: u - i)
    ranked = numbered(rows, [slug], [key], "_r").withColumn("_r", F.col("_r") - 1)
    out = ranked.join(used.select(slug, below.alias("_below")), slug, "left")
    n = F.col("_r") + F.coalesce(F.size(F.filter("_below", lambda b: b <= F.col("_r"))), F.lit(0))
    return out.withColumn("unique_slug", F.when(n == 0, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), n.cast("string")))).drop("_r", "_below")


def queue_status(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.agg(F.count_if(F.col(status) == "queued").alias("length"), (F.count_if(F.col(status) == "running") > 0).alias("running"))
