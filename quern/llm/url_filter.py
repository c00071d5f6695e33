"""URL filters with a temporal list join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import small, staged

#: Days that one row of a domain's intervals covers.
BUCKET_DAYS = 30


def host_of(url: Column) -> Column:
    """The lower-case host of an http or https URL, as a browser finds it, without user, port and final dots; null if there is none.

    Blanks and control characters around the URL and tabs and line breaks inside don't count, a backslash is a slash, the user ends at the
    last @ before the path. An IPv6 address stands without its brackets.
    """
    plain = F.translate(F.regexp_replace(F.regexp_replace(F.lower(url), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""), "\\", "/")
    host = F.regexp_extract(plain, r"^https?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    return F.nullif(domain_of(host), F.lit(""))


def domain_of(name: Column) -> Column:
    """A listed domain or a host in one spelling: lower case, without blanks around it, final dots and the brackets of an IPv6 address."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"^[\x00-\x20\[]+|[\x00-\x20\]]+$", ""), r"\.+$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, the longest first; the host alone if it has one label or is an
    IP address, which has no parents."""
    parts = F.split(host, r"\.")
    address = host.rlike(r"^\d+\.\d+\.\d+\.\d+$|:")
    count = F.when(address, 1).otherwise(F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """From dated entries (domain, listed_at, action, category) the validity intervals
    (domain, category, valid_from, valid_to): from a 'block' entry to the domain's next entry, open at the end.

    Domains count in one spelling (``domain_of``). Of several entries of one domain and time the last in order of (action, category)
    counts, and nulls in domain or time, empty domains, and other actions than block and allow, don't count. 'allow' ends an interval.
    """
    usable = entries.where("listed_at is not null and action in ('block', 'allow')").withColumn("domain", domain_of(F.col("domain"))).where("domain <> ''")
    last = usable.groupBy("domain", "listed_at").agg(F.max(F.struct("action", F.coalesce("category", F.lit("")).alias("category"))).alias("x"))
    after = F.lead("listed_at").over(Window.partitionBy("domain").orderBy("listed_at"))
    spans = last.select("domain", "listed_at", "x.action", "x.category", after.alias("valid_to"))
    return spans.where("action = 'block'").select("domain", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def bucket(time: Column) -> Column:
    """The number of the stretch of BUCKET_DAYS days that a time falls in."""
    return F.floor(F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS)


def pieces(spans: DataFrame, first: int, last: int) -> DataFrame:
    """(domain, bucket, spans): the intervals that touch each bucket from ``first`` to ``last``, in an array."""
    begin, end = F.greatest(bucket(F.col("valid_from")), F.lit(first)), F.least(F.coalesce(bucket(F.col("valid_to")), F.lit(last)), F.lit(last))
    touched = spans.withColumn("begin", begin).withColumn("end", end).where("begin <= end").withColumn("bucket", F.explode(F.sequence("begin", "end")))
    return touched.groupBy("domain", "bucket").agg(F.collect_list(F.struct("valid_from", "valid_to", "category")).alias("spans"))


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Every capture with host, blocked, matched_domain, category and valid_from as of its fetch time.

    A capture is blocked if an interval of its host or a parent domain holds its time (start included, end
    excluded); the longest such domain is reported. Captures with a null or other URL, or a null time, aren't
    blocked and take no part in the join. The captures' distinct (host, time) pairs are joined, not the rows, so a host
    with a third of them is combined map-side first. The as-of join is by (domain, stretch of time): there is one row
    at most with all intervals that touch it, of which at most one holds the time, so no capture meets a domain's other
    intervals and a host level makes one row at most. That side is broadcast behind a check of its number, else the
    join is shuffled with skew handling. Repeated captures each keep their row; other columns aren't read.
    """
    rows = captures.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched_at")).withColumn("host", host_of(F.col("url")))
    usable = F.col("host").isNotNull() & F.col("fetched_at").isNotNull()
    asked = rows.where(usable).select("host", "fetched_at").distinct()
    first, last = rows.where(usable).agg(F.min(bucket(F.col("fetched_at"))), F.max(bucket(F.col("fetched_at")))).first()
    spans = small(staged(pieces(intervals(entries), first or 0, last or 0)))
    levels = asked.select("host", "fetched_at", bucket(F.col("fetched_at")).alias("bucket"), F.posexplode(suffixes(F.col("host"))).alias("depth", "domain"))
    holds = lambda s: (s["valid_from"] <= F.col("fetched_at")) & (s["valid_to"].isNull() | (F.col("fetched_at") < s["valid_to"]))
    active = levels.join(spans, ["domain", "bucket"]).withColumn("span", F.get(F.filter("spans", holds), F.lit(0))).where("span is not null")
    best = active.groupBy("host", "fetched_at").agg(F.min(F.struct("depth", "domain", "span.category", "span.valid_from")).alias("m"))
    joined = rows.where(usable).join(best, ["host", "fetched_at"], "left")
    joined = joined.unionByName(rows.where(~usable).withColumn("m", F.lit(None).cast(best.schema["m"].dataType)))
    return joined.select("page_id", "host", "fetched_at", F.col("m").isNotNull().alias("blocked"), F.col("m.domain").alias("matched_domain"), F.col("m.category").alias("category"), F.col("m.valid_from").alias("valid_from"))
