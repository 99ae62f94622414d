"""Pages that rows lead to: each opened once, whatever comes of it.

The targets of all rows are made distinct first, so a page that a third of the rows lead to is
read once; what was read, or why nothing was, is joined back. A target that fails is a value
of its row, never a failed task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from gleaner.operators.extract import Job
from gleaner.sources import html as H

ERROR = "struct<code:string,message:string>"
#: Characters of a message that are kept.
MESSAGE = 500


def captured(job: Job, html: str | Column = "html") -> Column:
    """struct(value, error): what a job reads of a page, or the error that ended it. Parts that
    fail take the whole page's value with them, as a script that throws does."""
    kind = _parse_datatype_string(f"struct<value:{job.type()},error:{ERROR}>")
    arrow_type = None

    def run(pages: pa.Array) -> pa.Array:
        nonlocal arrow_type
        rows = []
        for page in pages:
            try:
                nodes = H.parse(page.as_py() or "")
                rows.append({"value": {name: part.read(nodes) for name, part in job.parts.items()}, "error": None})
            except H.Invalid as e:
                rows.append({"value": None, "error": {"code": "INVALID_SELECTOR", "message": str(e)[:MESSAGE]}})
            except Exception as e:
                rows.append({"value": None, "error": {"code": "SCRIPT_ERROR", "message": str(e)[:MESSAGE]}})
        if arrow_type is None:
            arrow_type = to_arrow_type(kind)
        return pa.array(rows, arrow_type)

    return F.arrow_udf(run, kind)(html)


def opened(rows: DataFrame, target: str, pages: DataFrame, job: Job, url: str = "url", html: str = "html") -> DataFrame:
    """rows with `value` (what the job read of the page that `target` names) and `error` (code,
    message): exactly one of them is set, but for a null target, which has neither. Several
    pages of one url are one: the least by its html."""
    wanted = rows.select(F.col(target).alias("_target")).where("_target is not null").distinct()
    known = pages.groupBy(F.col(url).alias("_target")).agg(F.min(html).alias("_html"), F.lit(True).alias("_there"))
    met = wanted.join(known, "_target", "left").withColumn("_x", F.when(F.col("_there"), captured(job, "_html")))
    missing = F.struct(F.lit("PAGE_NOT_FOUND").alias("code"), F.col("_target").alias("message"))
    told = met.select("_target", F.col("_x.value").alias("value"), F.when(F.col("_there"), F.col("_x.error")).otherwise(missing).alias("error"))
    return rows.join(told, F.col(target) == F.col("_target"), "left").drop("_target")
