"""Not-modified revisits of a crawl archive, resolved to the full responses that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipmotif.llm.common import col

#: header fields that a not-modified answer may replace in the stored response (fixed values)
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
SPAN_SECONDS = 86_400  # of one span of the as-of join


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without default port or "www.", no fragment, no tracking parameters, the others
    sorted, no trailing slash; http counts as https.  Null and blank stay null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^(?i)https?://", "https://")
    host = F.lower(F.regexp_extract(u, "^https://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    rest = F.regexp_replace(u, "^https://[^/?]*", "")
    path = F.regexp_replace(F.regexp_replace(rest, "\\?.*$", ""), "/+$", "")
    query = F.regexp_extract(rest, "\\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|gclid|fbclid|ref)(=|$)")))
    joined = F.array_join(pairs, "&")
    whole = F.when(u.rlike("^https://"), F.concat(F.lit("https://"), host, path)).otherwise(path)
    whole = F.concat(whole, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))
    return F.when(F.trim(url) == "", None).otherwise(whole)


def _headers(text: Column) -> Column:
    """Header lines "Name: value" as a map with lower-case names; of a repeated name the last counts."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"])
    return F.map_from_arrays(names, last)


def _tag(tag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """Rows (record_id, canonical, ts, status, response_id, response_ts, payload_digest, payload_length, headers), one per revisit.

    ``records`` has record_id, url, ts (seconds), type, http_status, headers (lines of text), payload_digest
    and payload_length.  A full response has type "response" and status 200; a revisit has type "revisit"
    and status 304.  A revisit belongs to the latest full response of its canonical URL that is strictly
    earlier; of equal times the greatest record_id counts.  Its status is
      resolved           an ETag of both agrees by weak comparison, or, if one lacks it, Last-Modified agrees,
      mismatch           a validator of both differs,
      no_validator       they share none,
      no_response        no earlier full response.
    Resolved revisits have the response's payload and its headers, with the PERMITTED ones replaced by the
    revisit's, as "name: value" lines sorted by name; the others have null there.

    URLs are cut into spans of time, and captures are gathered by URL and second first, so that a URL with very many
    captures is spread: a window holds at most ``span`` rows, and the latest response of earlier spans comes from
    one row per URL and span.  Null URLs and times make no_response; repeated
    revisits are answered each; other columns are not read; an empty table gives no row.
    """
    own = records.select(
        col("record_id").cast("long").alias("record_id"), canonical_url(col("url").cast("string")).alias("canonical"), col("ts").cast("long").alias("ts"),
        F.lower(col("type").cast("string")).alias("type"), col("http_status").cast("int").alias("http_status"), _headers(col("headers").cast("string")).alias("h"),
        col("payload_digest").cast("string").alias("payload_digest"), col("payload_length").cast("long").alias("payload_length"),
    )
    full = (F.col("type") == "response") & (F.col("http_status") == 200) & F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    revisit = (F.col("type") == "revisit") & (F.col("http_status") == 304)
    own = own.withColumn("full", F.coalesce(full, F.lit(False))).where(F.col("full") | F.coalesce(revisit, F.lit(False)))
    own = own.withColumn("span", F.floor(F.col("ts") / span))
    answer = F.struct("ts", "record_id", "payload_digest", "payload_length", "h")
    keyed = own.where("canonical IS NOT NULL AND ts IS NOT NULL")
    steps = keyed.groupBy("canonical", "span", "ts").agg(F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).alias("here"), F.max(~F.col("full")).alias("asks"))
    within = Window.partitionBy("canonical", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    near = steps.withColumn("near", F.max("here").over(within)).where("asks").select("canonical", "span", "ts", "near")
    spans = steps.groupBy("canonical", "span").agg(F.max("here").alias("latest"))
    past = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("canonical", "span", F.max("latest").over(past).alias("far"))
    asked = near.join(spans, ["canonical", "span"], "left").withColumn("at", F.coalesce("near", "far"))
    asked = asked.select("canonical", "ts", F.col("at.record_id").alias("response_id"), F.col("at.ts").alias("response_ts"))
    found = keyed.where("NOT full").drop("full", "span").join(asked, ["canonical", "ts"], "left")
    responses = own.where("full").select(F.col("canonical").alias("rc"), F.col("record_id").alias("rid"), answer.alias("r"))
    responses = responses.withColumn("rts", F.col("r.ts")).groupBy("rc", "rid", "rts").agg(F.max_by("r", F.struct("r.payload_digest", "r.payload_length")).alias("r"))
    same = [F.col("canonical") == F.col("rc"), F.col("response_id").eqNullSafe(F.col("rid")), F.col("response_ts") == F.col("rts")]
    # dealt anew, so that the join reads plain partitions and Spark can split those of a response with very many revisits
    found = found.join(responses.hint("rebalance"), same, "left").drop("rc", "rid", "rts")
    lost = own.where("NOT full AND (canonical IS NULL OR ts IS NULL)").select(*[F.col(c) for c in ("canonical", "record_id", "ts", "type", "http_status", "h", "payload_digest", "payload_length")])
    found = found.unionByName(lost, allowMissingColumns=True)
    get = lambda m, k: F.element_at(m, k)
    theirs = F.col("r.h")
    by_tag = _tag(get(F.col("h"), "etag")) == _tag(get(theirs, "etag"))
    by_date = get(F.col("h"), "last-modified") == get(theirs, "last-modified")
    status = F.when(F.col("response_ts").isNull(), "no_response").when(F.coalesce(by_tag, by_date).isNull(), "no_validator").when(F.coalesce(by_tag, by_date), "resolved").otherwise("mismatch")
    fresh = F.map_filter(F.col("h"), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, v: ~F.map_contains_key(fresh, k))
    merged = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_concat(kept, fresh)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    found = found.withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "resolved", c)
    return found.select(
        "record_id", "canonical", "ts", "status", only(F.col("response_id")).alias("response_id"), only(F.col("response_ts")).alias("response_ts"),
        only(F.col("r.payload_digest")).alias("payload_digest"), only(F.col("r.payload_length")).alias("payload_length"), only(merged).alias("headers"),
    )
