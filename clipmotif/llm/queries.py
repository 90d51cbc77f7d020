"""The operators applied to the synthetic tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipmotif.llm import classifier, decontaminate, html, lines, mixing, negatives, periods, rules, secrets, simhash, spans, warc, wavelet
from clipmotif.llm.common import table

#: integer weights by level of the tree; "*" is for names that are not listed
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "*": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2, "*": 1}, "source": {"*": 1}}
MIX_RATIO = 0.5
MIX_EPOCHS = 2
MIX_SEED = "mix-1"


def domain() -> Column:
    """The domain of a document: its source's number modulo 4."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), (F.coalesce(F.when(number == "", None).otherwise(number).cast("long"), F.lit(3)) % 4).cast("string"))


def mix(docs: DataFrame) -> DataFrame:
    """``mixing.mix`` of the documents by the weights above; nulls, ties, repeated rows and clashing columns as it says."""
    return mixing.mix(docs, domain(), WEIGHTS, MIX_RATIO, MIX_EPOCHS, MIX_SEED)


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made of ``pages``: a response of each page, and revisits at other spellings of its URL.

    The response is a 404 for every 17th page.  Revisits come 100 seconds to 5 days later; by page_id modulo 4
    they repeat the ETag, repeat it as a weak one, have another one, or have Last-Modified alone.  Every tenth
    page also has a revisit before any response.
    """
    p, t = F.col("page_id"), F.col("page_id") * 600
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), F.lit('"'))
    line = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    join = lambda *x: F.concat_ws("\r\n", *x)
    answer = F.struct(
        (p * 3).alias("record_id"), F.col("url").alias("url"), t.alias("ts"), F.lit("response").alias("type"), F.when(p % 17 == 0, 404).otherwise(200).alias("http_status"),
        join(line("Content-Type: text/html"), line("ETag: ", tag), line("Last-Modified: day ", p % 7), line("Date: ", t), line("Cache-Control: max-age=60")).alias("headers"),
        F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("payload_digest"), F.length(F.coalesce(F.col("html"), F.lit(""))).cast("long").alias("payload_length"),
    )
    later = t + 100 + (p % 5) * 108_000
    kind = p % 4
    seen = F.when(kind == 0, line("ETag: ", tag)).when(kind == 1, line("ETag: W/", tag)).when(kind == 2, line('ETag: "other"')).otherwise(line("Last-Modified: day ", p % 7))
    none = lambda kind: F.lit(None).cast(kind)
    again = F.struct(
        (p * 3 + 1).alias("record_id"), F.concat(F.regexp_replace(F.col("url"), "#.*$", ""), F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("http_status"),
        join(seen, line("Date: ", later), line("Server: edge")).alias("headers"), none("string").alias("payload_digest"), none("long").alias("payload_length"),
    )
    early = F.struct(
        (p * 3 + 2).alias("record_id"), F.col("url").alias("url"), F.lit(-1).cast("long").alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("http_status"),
        line("ETag: ", tag).alias("headers"), none("string").alias("payload_digest"), none("long").alias("payload_length"),
    )
    records = F.explode(F.array_compact(F.array(answer, again, F.when(p % 10 == 0, early))))
    return pages.select("page_id", "url", "html").select(records.alias("r")).select("r.*")


def planted_periods(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with a period made in the documents whose crc32 of the doc_id is divisible by 10.

    From word a on such a text repeats p words; a and p follow from the crc32 and the number of words.  A null doc_id or
    a text without words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select(F.col("doc_id"), F.col("text"), F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    own = own.select("doc_id", "text", "g", F.when(F.col("g").isNotNull(), words).alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice("words", a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")
    return own.select("doc_id", F.when(F.col("g").isNotNull() & F.col("words").isNotNull() & (n > 0), text).otherwise(F.col("text")).alias("text"))


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(captures(table(spark, sf_dir, "pages")))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels"), f"NOT {classifier.held_out()}")
    scored = classifier.score_quality(docs, model)
    return scored.select("doc_id", F.expr(classifier.held_out()).alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_decisions(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = periods.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, x: F.when(more(best, x), x).otherwise(best))
    said = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    own = own.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("1000 * best.length div best.period")
    return own.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the vocabulary files are

    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


NEGATIVES_SQL = """
WITH own AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY m.score DESC, m.vec_id)::INTEGER AS rank,
  m.vec_id AS negative_id, p.positive_score, m.score AS negative_score
FROM positive p JOIN met m USING (anchor_id)
WHERE NOT m.same AND 30 * p.positive_score <= 100 * m.score AND 100 * m.score <= 90 * p.positive_score QUALIFY rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": _op1,
        "op2_decontaminate": _op2,
        "op3_sentence_spans": _op3,
        "op4_secret_scan": _op4,
        "op5_quality_rules": _op5,
        "op6_warc_revisits": _op6,
        "op7_html_text": _op7,
        "op8_quality_classifier": _op8,
        "op9_line_dedup": _op9,
        "op10_simhash": _op10,
        "op11_periodic_runs": _op11,
        "op12_hard_negatives": _op12,
        "op13_token_files": _op13,
    }


def _weights_sql(level: str, name: str) -> str:
    own = WEIGHTS[level]
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in own.items() if k != "*")
    return f"CASE {name} {cases} ELSE {own['*']} END" if cases else str(own["*"])


def _share_sql(level: str, parent: list[str], name: str, source: str) -> str:
    """SQL for one level: siblings are filled in order of capacity by weight."""
    keys = ", ".join(parent)
    on = " AND ".join(f"c.{k} = p.{k}" for k in parent)
    return f"""
{name}_n AS (SELECT {keys}, {level}, sum(capacity)::BIGINT AS capacity, any_value({_weights_sql(level, level)}) AS weight
  FROM leaf GROUP BY {keys}, {level}),
{name}_o AS (SELECT c.*, p.budget AS given,
    coalesce(sum(c.capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
    sum(c.weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS weights
  FROM {name}_n c JOIN {source} p ON {on} WHERE c.weight > 0 AND c.capacity > 0
  WINDOW w AS (PARTITION BY {", ".join("c." + k for k in parent)} ORDER BY c.capacity / c.weight, c.{level})),
{name}_f AS (SELECT *, capacity::HUGEINT * weights <= (given - used) * weight AS filled FROM {name}_o),
{name}_r AS (SELECT *, coalesce(sum(capacity) FILTER (filled) OVER (PARTITION BY {keys}), 0) AS kept,
    coalesce(sum(weight) FILTER (NOT filled) OVER (PARTITION BY {keys}), 0) AS rest FROM {name}_f),
{name} AS (SELECT {keys}, {level}, CASE WHEN filled THEN capacity ELSE ((given - kept)::HUGEINT * weight) // rest END::BIGINT AS budget FROM {name}_r)"""


def mix_sql(docs: str = "documents", columns: str = "doc_id, domain, lang, source, n_tokens, copies") -> str:
    """DuckDB SQL of ``mix`` over the table expression ``docs``."""
    return f"""
WITH base AS (SELECT d.*, coalesce(lang, '') AS k_lang, coalesce(source, '') AS k_source,
    'd' || (coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '')::BIGINT, 3) % 4)::VARCHAR AS k_domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> ''))::BIGINT AS k_tokens FROM {docs} d),
leaf AS (SELECT 1 AS one, k_domain AS domain, k_lang AS lang, k_source AS source, sum(k_tokens)::BIGINT AS tokens, (sum(k_tokens) * {MIX_EPOCHS})::BIGINT AS capacity
  FROM base WHERE k_tokens > 0 GROUP BY ALL),
root AS (SELECT 1 AS one, least(floor(sum(tokens)::BIGINT * {MIX_RATIO}::DOUBLE), sum(capacity))::BIGINT AS budget FROM leaf),
{_share_sql("domain", ["one"], "lv1", "root")},
{_share_sql("lang", ["one", "domain"], "lv2", "lv1")},
{_share_sql("source", ["one", "domain", "lang"], "lv3", "lv2")},
plan AS (SELECT l.domain, l.lang, l.source, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest
  FROM leaf l JOIN lv3 b USING (domain, lang, source) WHERE b.budget > 0),
ordered AS (SELECT base.*, p.whole, p.rest, sum(k_tokens) OVER (PARTITION BY k_domain, k_lang, k_source
    ORDER BY md5('{MIX_SEED}:' || p.whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, k_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM base JOIN plan p ON k_domain = p.domain AND k_lang = p.lang AND k_source = p.source WHERE k_tokens > 0),
taken AS (SELECT * EXCLUDE (k_domain, k_lang, k_source, k_tokens, whole, rest, upto), k_domain AS domain, k_tokens AS n_tokens,
  (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM ordered)
SELECT {columns} FROM taken WHERE copies > 0"""


def _canonical_sql(url: str) -> str:
    """The canonical form of a URL in DuckDB."""
    u = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^https?://', 'https://', 'i')"
    rest = f"regexp_replace({u}, '^https://[^/?]*', '')"
    host = f"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^https://([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '')"
    path = f"regexp_replace(regexp_replace({rest}, '\\?.*$', ''), '/+$', '')"
    pairs = f"list_sort(list_filter(string_split(regexp_extract({rest}, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)')))"
    query = f"array_to_string({pairs}, '&')"
    whole = f"CASE WHEN starts_with({u}, 'https://') THEN 'https://' || {host} || {path} ELSE {path} END"
    return f"CASE WHEN trim({url}) = '' THEN NULL ELSE {whole} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END"


def warc_sql() -> str:
    """DuckDB SQL of the revisits of ``captures(pages)``, resolved."""
    return f"""
WITH p AS (SELECT page_id AS p, page_id * 600 AS t, {_canonical_sql("url")} AS canonical,
    {_canonical_sql("regexp_replace(url, '#.*$', '') || '#again'")} AS again, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n FROM pages),
full_ AS (SELECT p * 3 AS rid, canonical AS rc, t AS rts, digest, n, p % 7 AS day FROM p WHERE p % 17 <> 0 AND canonical IS NOT NULL),
rev AS (SELECT p * 3 + 1 AS record_id, again AS canonical, t + 100 + (p % 5) * 108000 AS ts,
    CASE p % 4 WHEN 0 THEN digest WHEN 1 THEN digest WHEN 2 THEN 'other' END AS tag,
    CASE p % 4 WHEN 0 THEN '' WHEN 1 THEN 'W/' WHEN 2 THEN '' END AS weak, CASE WHEN p % 4 = 3 THEN p % 7 END AS day, TRUE AS dated FROM p
  UNION ALL SELECT p * 3 + 2, canonical, -1, digest, '', NULL, FALSE FROM p WHERE p % 10 = 0),
best AS (SELECT rev.*, max(struct_pack(rts := rts, rid := rid, digest := f.digest, n := f.n, day := f.day)) AS r
  FROM rev LEFT JOIN full_ f ON f.rc = rev.canonical AND f.rts < rev.ts GROUP BY ALL),
judged AS (SELECT *, CASE WHEN r.rts IS NULL THEN 'no_response' WHEN coalesce(tag = r.digest, day = r.day) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM (SELECT * REPLACE (CASE WHEN r.rts IS NULL THEN NULL ELSE r END AS r) FROM best))
SELECT record_id, canonical, ts::BIGINT AS ts, status,
  CASE WHEN status = 'resolved' THEN r.rid END AS response_id, CASE WHEN status = 'resolved' THEN r.rts END AS response_ts,
  CASE WHEN status = 'resolved' THEN r.digest END AS payload_digest, CASE WHEN status = 'resolved' THEN r.n END AS payload_length,
  CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60', 'content-type: text/html',
    'date: ' || (CASE WHEN dated THEN ts ELSE r.rts END)::VARCHAR, 'etag: ' || CASE WHEN tag IS NULL THEN '"' || r.digest || '"' ELSE weak || '"' || tag || '"' END,
    'last-modified: day ' || coalesce(day, r.day)::VARCHAR) END AS headers
FROM judged"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix_sql(), "op6_warc_revisits": warc_sql(), "op12_hard_negatives": NEGATIVES_SQL}
