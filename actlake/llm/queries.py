"""The opN_<name> queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate as DC, exact_dedup as ED, lang_id as LI, line_dedup as LD, mixing as MX, ngram_join as NJ, \
    periodic_runs as PR, pii_feistel as PF, ranked_search as RS, recompression as RC, sharding as SH, suffix_dedup as SD, \
    warc_revisit as WR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op6_bfd_shards")
def op6_bfd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by best-fit-decreasing packing of groups of equal texts (law: bytes)."""
    out = SH.shard_groups(documents(spark, sf_dir), n_shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


MIX_SEED, MIX_POWER, MIX_EPOCHS = "mix-1", 0.7, 1.0
OP8_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {MIX_POWER}) AS w FROM documents GROUP BY source),
total AS (SELECT sum(n) AS n, sum(w) AS w FROM counts),
rates AS (SELECT source, ({MIX_EPOCHS}::DOUBLE * t.n / t.w) * c.w / c.n AS rate FROM counts c, total t),
cdf(source, rate, k, f, c) AS (
  SELECT source, rate, 0, 0.0::DOUBLE, exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, f + ln(k + 1), c + exp((k + 1) * ln(rate) - rate - f - ln(k + 1))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
drawn AS (SELECT d.doc_id, d.text, d.source, '{MIX_SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') AS k,
  ('0x' || substr(md5('{MIX_SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents d),
copies AS (SELECT d.doc_id, d.text, d.source, d.k, any_value(rate) AS rate, count(*) AS n
  FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY d.doc_id, d.text, d.source, d.k),
exploded AS (SELECT doc_id, text, source, k, rate, n, unnest(range(1, n + 1)) AS i FROM copies)
SELECT doc_id, text, source, i::INT AS mix_copy, n::INT AS mix_copies, round(rate, 9) AS mix_rate, md5(k || ':' || i) AS mix_key
FROM exploded
"""


@query("op8_poisson_mix", OP8_SQL)
def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by its Poisson number of copies, source shares lifted to count ** 0.7, globally shuffled."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    out = MX.poisson_mix(docs, MIX_SEED, power=MIX_POWER, epochs=MIX_EPOCHS)
    return out.withColumn("mix_rate", F.round("mix_rate", 9))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS len, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS s FROM n),
g AS (SELECT *, count(*) OVER (PARTITION BY s) AS group_size,
  first_value(doc_id) OVER (PARTITION BY s ORDER BY len DESC, doc_id) AS keep_id FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g
"""


@query("op10_bloom_exact_dedup", OP10_SQL)
def op10_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of every group of texts that are equal without blanks."""
    return ED.exact_dedup(documents(spark, sf_dir))


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, '"' || md5(html) || '"' AS tag, sha1(html) AS digest,
  to_timestamp(1700000000 + page_id * 60)::TIMESTAMP AS t0 FROM pages),
r AS (
  SELECT page_id * 4 AS record_id, url, t0 AS ts, true AS is_full, tag AS etag, strftime(t0, '%Y-%m-%d %H:%M:%S') AS lm,
    strftime(t0, '%Y-%m-%d %H:%M:%S') AS dt, 'max-age=60' AS cc, digest FROM p
  UNION ALL SELECT page_id * 4 + 1, url || '#again', t0 + INTERVAL 1 HOUR, false, 'W/' || tag, NULL,
    strftime(t0 + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), 'max-age=120', NULL FROM p
  UNION ALL SELECT page_id * 4 + 2, 'HTTPS://WWW.' || regexp_replace(url, '^[a-z]+://(www\.)?', ''), t0 + INTERVAL 30 HOUR, false, NULL,
    strftime(t0, '%Y-%m-%d %H:%M:%S'), strftime(t0 + INTERVAL 30 HOUR, '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM p
  UNION ALL SELECT page_id * 4 + 3, url, t0 - INTERVAL 1 HOUR, false, NULL, NULL,
    strftime(t0 - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM p),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''),
    '^www[0-9]*\.', '') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT
    regexp_matches(lower(q), '^(utm_[a-z]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$'))), '&') AS query FROM b),
d AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS u FROM c),
e AS (SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest} END IGNORE NULLS) OVER
  (PARTITION BY u ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM d),
f AS (SELECT *, CASE WHEN o IS NULL THEN 'no-response'
  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = o.etag THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = o.lm THEN 'resolved' ELSE 'mismatch' END ELSE 'no-validator' END AS verdict FROM e WHERE NOT is_full)
SELECT record_id, u AS canonical_url, o.id AS response_id, verdict, CASE WHEN verdict = 'resolved' THEN
  'cache-control: ' || coalesce(cc, 'max-age=60') || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || dt || chr(10) ||
  'etag: ' || coalesce(etag, o.etag) || chr(10) || 'last-modified: ' || coalesce(lm, o.lm) || chr(10) || 'server: origin' END AS headers,
  CASE WHEN verdict = 'resolved' THEN o.digest END AS payload_digest FROM f
"""


@query("op1_warc_revisit", OP1_SQL)
def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of all pages resolved to their latest earlier response."""
    out = WR.resolve_revisits(WR.captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.withColumn("headers", F.array_join(lines, "\n"))


@query("op2_zstd_lang")
def op2_zstd_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by zstandard dictionaries fitted on the labelled documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = LI.fit_dictionaries(docs.filter(rest != 2).select("text", "lang"))
    return LI.predict(docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text"), model).drop("text")


@query("op3_line_runs")
def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three lines, or of over 50 words, that also start earlier, deleted from every document."""
    return LD.remove_repeated_lines(documents(spark, sf_dir), min_words=LD.MIN_WORDS).select(
        "doc_id", "n_lines", "n_removed", F.size("runs").cast("long").alias("n_runs"), "text")


#: A stand-in: a real run takes its secret from the caller.
PII_KEY = "documents-1"


@query("op4_feistel_pii")
def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with validated numbers, dates and mailbox names replaced by format-preserving pseudonyms."""
    return PF.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY)


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents covered by a 100-byte string that also starts earlier, removed."""
    out = SD.remove_repeats(documents(spark, sf_dir), 100)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_bm25_leaks")
def op7_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that a passage of a document holds."""
    items = DC.question_and_answer(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return DC.find_leaks(documents(spark, sf_dir), items)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


@query("op9_grouped_prefix_join", OP9_SQL)
def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: Jaccard of three-word shingles of at least 0.9."""
    return NJ.jaccard_join(documents(spark, sf_dir), 3, (90, 100)).select("doc_id", "n_shingles", "component_id")


#: crc32 of the decimal digits of doc_id, unsigned: the bitwise rule of the reflected polynomial.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, x: list_reduce(list_concat([xor(c, x)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda d, z: xor(d // 2, 3988292384 * (d % 2)))), 4294967295::BIGINT)"""
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC_SQL} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM a),
e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
v AS (SELECT doc_id, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w, n FROM e),
x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM v),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM m),
t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, grp HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY doc_id, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r),
g AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(g.n_runs, 0) AS n_runs, o.start, o.length, o.period, 1000 * o.length // o.period AS exponent_milli,
  sha256(coalesce(g.lines, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN (FROM o WHERE place = 1) o ON o.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""


def _with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth document (by crc32 of its id) repeats its tail: word i >= a is word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words"), F.floor(h / 10)
    some = some.withColumn("a", F.when(n > 0, g % n)).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    place = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.get("words", F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return some.select("doc_id", F.when(n > 0, F.array_join(place, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", OP11_SQL)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least six words and four periods in every document, the greatest exponent, and the words that stay."""
    runs = PR.periodic_runs(_with_period(documents(spark, sf_dir).select("doc_id", "text")))
    # runs come by start, then period: a later one must be strictly greater
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
                       lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    out = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "kept")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
                      F.sha2("lines", 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
q AS (SELECT row_number() OVER () AS qr, item_id, list_distinct({_TERMS_SQL}) AS t FROM benchmark),
qt AS (SELECT qr, item_id, unnest(t) AS term FROM q),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) x
  WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT qr, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN f USING (term) JOIN p USING (term), s GROUP BY qr, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0) y WHERE rank <= 50
"""


@query("op12_taat_daat_search", OP12_SQL)
def op12_taat_daat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item by accumulators of short lists and skipping over long ones."""
    return RS.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM d),
v AS (SELECT doc_id, unnest(list_transform(range(len(w) - 49), lambda i: array_to_string(w[i + 1:i + 50], ' '))) AS win,
  unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win),
late AS (SELECT v.doc_id, v.i FROM v JOIN f USING (win) WHERE v.doc_id > f.first),
y AS (SELECT x.*, max(late.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS UNBOUNDED PRECEDING) AS last_late
  FROM x LEFT JOIN late ON late.doc_id = x.doc_id AND late.i = x.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE last_late > i - 50) AS n_removed,
  string_agg(word, ' ' ORDER BY i) FILTER (WHERE last_late IS NULL OR last_late <= i - 50) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""


@query("op13_recompression_dedup", OP13_SQL)
def op13_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents covered by a 50-word window that also starts in a smaller document, removed."""
    out = RC.remove_repeated_windows(documents(spark, sf_dir), 50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
