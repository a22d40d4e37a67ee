"""Queries of this subpackage over the driver's tables: (spark, sf_dir) -> DataFrame, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import codes, fingerprint, html_text, licences, minhash, mixing, periodic, pieces, quality, secret_scan, substrings, vectors, warc
from .common import words


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op3_html_extraction(spark, sf_dir):
    out = html_text.extract(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), n=2, percent=80)


def op5_substring_dedup(spark, sf_dir):
    return substrings.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), within_sentences=True)


def op6_licence_scan(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, licences.train(docs)).select("doc_id", "n_paragraphs", "licence", F.array_join("licences", ",").alias("licences"), F.size("hits").alias("n_hits"))


def op7_document_fingerprints(spark, sf_dir):
    return fingerprint.fingerprints(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark, sf_dir):
    model = pieces.load()
    coded = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    out = pieces.decode(coded, model)
    return out.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_score", F.get("runner_up", F.lit(0)).alias("second_score"),
        F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op9_source_mixing(spark, sf_dir):
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def op10_warc_round_trip(spark, sf_dir):
    out = warc.archive_and_read(_read(spark, sf_dir, "pages"), with_payload=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_secret_scan(spark, sf_dir):
    out = secret_scan.scan(_read(spark, sf_dir, "documents"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("spans", lambda s: s["kind"])
    n = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return out.select("doc_id", *n, F.sha2(written(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def made_periodic(docs):
    """doc_id and text, which in a tenth of the documents repeats a stretch of words to its end, as the query's contract fixes."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.when(F.size("w") > 0, F.size("w").cast("long")))
    rows = rows.withColumn("a", F.col("g") % F.col("n"))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int")))
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    out = periodic.runs(made_periodic(_read(spark, sf_dir, "documents")))
    out = out.withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.less")).alias("length"), "best.period",
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_vector_codes(spark, sf_dir):
    out, books = codes.compress(_read(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("numbers", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_quality_classifier, op3_html_extraction, op4_minhash_near_dedup, op5_substring_dedup, op6_licence_scan, op7_document_fingerprints, op8_sentencepiece, op9_source_mixing, op10_warc_round_trip, op11_secret_scan, op12_periodic_runs, op13_vector_codes)}

# a block of all pairs: at the size of the oracle's tables this is quick
OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, v.vec_id) AS component_id, v.vec_id = coalesce(c, v.vec_id) AS kept
FROM v LEFT JOIN comp ON comp.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""

# the pages of the tables mark their article plainly, so tags suffice to say what the text is
OP3_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(?:p|h1)>'), lambda t: regexp_replace(t, '<[^>]*>', ' ', 'g')) AS raw FROM a),
c AS (SELECT page_id, url, list_transform(raw, lambda t: regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g')) AS plain FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(plain, lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))), lambda t: t <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pair AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
last AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
bits AS (SELECT page_id, top, octet_length(encode(p.h)) AS size, array_to_string(list_transform(string_split(sha1(p.h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS b FROM p JOIN last ON p.h = last.h)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER) + CAST(substr(b, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits
"""

# places by adding up the lengths of what lies before; RE2 finds the same matches without a look behind
_ASSIGN = r"""(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
_MATCHES = "SELECT doc_id, {kind} AS kind, {least} AS least, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {g}) AS parts, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (""" + " UNION ALL ".join(
    _MATCHES.format(kind=k, least=n, p=p, g=g)
    for k, n, p, g in ((0, 8, f"{_ASSIGN}([A-Za-z0-9+/_.=-]+)", 1), (1, 16, "AKIA[A-Z0-9]+", 0), (2, 32, "[0-9a-f]+", 0), (3, 20, f"{_ASSIGN}[A-Za-z0-9+/_.=-]+|([A-Za-z0-9+/_-]{{20,}})={{0,2}}", 1))
) + """),
n AS (SELECT *, list_transform(hits, lambda x: length(x)) AS h, list_transform(gaps, lambda x: length(x)) AS g FROM m),
u AS (SELECT doc_id, kind, least, h, g, parts, unnest(list_filter(range(1, len(hits) + 1), lambda i: length(parts[i]) >= least)) AS i FROM n),
s AS MATERIALIZED (SELECT doc_id, kind, CAST(list_sum(g[:i]) + coalesce(list_sum(h[:i - 1]), 0) AS BIGINT) AS a, CAST(list_sum(g[:i]) + list_sum(h[:i]) AS BIGINT) AS z, parts[i] AS part FROM u),
c AS (SELECT DISTINCT part, CASE WHEN regexp_full_match(part, '[0-9]+') THEN {'e': 'decimal', 'x': '0123456789'} WHEN regexp_full_match(part, '[0-9a-f]+') THEN {'e': 'hex', 'x': '0123456789abcdef'}
    WHEN regexp_full_match(part, '[0-9A-F]+') THEN {'e': 'upper hex', 'x': '0123456789ABCDEF'} WHEN regexp_full_match(part, '[a-z]+') THEN {'e': 'letters', 'x': low}
    WHEN regexp_full_match(part, '[A-Z]+') THEN {'e': 'upper letters', 'x': upper(low)} WHEN regexp_full_match(part, '[A-Z2-7]+') THEN {'e': 'base32', 'x': upper(low) || '234567'}
    WHEN regexp_full_match(part, '[0-9a-z]+') THEN {'e': 'base36', 'x': low || '0123456789'} WHEN regexp_full_match(part, '[0-9A-Z]+') THEN {'e': 'upper base36', 'x': upper(low) || '0123456789'}
    WHEN regexp_full_match(part, '[0-9A-Za-z]+') THEN {'e': 'base62', 'x': low || upper(low) || '0123456789'} WHEN regexp_full_match(part, '[0-9A-Za-z+/]+') THEN {'e': 'base64', 'x': low || upper(low) || '0123456789+/'}
    WHEN regexp_full_match(part, '[0-9A-Za-z_-]+') THEN {'e': 'base64url', 'x': low || upper(low) || '0123456789-_'} END AS b
  FROM s, (SELECT 'etaoinshrdlucmfwypvbgkjqxz' AS low) WHERE kind = 3 AND NOT regexp_matches(part, 'AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}')),
v AS (SELECT part, b.e AS e, length(part) AS n, length(b.x) AS k, CASE WHEN length(part) < 32 THEN 3 WHEN length(part) < 64 THEN 5 ELSE 9 END AS c, list_transform(string_split(part, ''), lambda y: instr(b.x, y) - 1) AS v FROM c WHERE b IS NOT NULL),
w AS (SELECT *, list_sum(list_transform(list_transform(range(c), lambda j: {'o': len(list_filter(v, lambda y: y * c // k = j)), 'w': n * (ceil((j + 1) * k / c) - ceil(j * k / c)) / k}), lambda y: (y.o - y.w) * (y.o - y.w) / y.w)) AS uneven,
  2 * list_sum(list_transform(range(1, n), lambda i: CASE WHEN (v[i] * 2 < k) <> (v[i + 1] * 2 < k) THEN 1 ELSE 0 END)) - (n - 1) AS runs, list_sum(list_transform(range(1, n), lambda i: (2 * v[i] - k + 1) * (2 * v[i + 1] - k + 1))) AS serial FROM v),
q AS (SELECT part, e, n, c, (uneven + runs * runs / (n - 1) + CAST(serial AS DOUBLE) * serial / (((k * k - 1) / 3.0) * ((k * k - 1) / 3.0) * (n - 1))) / 2 AS h FROM w),
p AS (SELECT part, e || ':' || CAST(floor(log2(n)) AS INTEGER) AS stratum, CAST(floor(1000 * exp(-h) * (1 + h + CASE WHEN c >= 5 THEN h * h / 2 ELSE 0 END + CASE WHEN c = 9 THEN h * h * h / 6 + h * h * h * h / 24 ELSE 0 END)) AS INTEGER) AS level FROM q),
l AS (SELECT stratum, level, count(*) AS n FROM p GROUP BY 1, 2),
f AS (SELECT stratum, level, sum(n) OVER (PARTITION BY stratum ORDER BY level DESC) AS below, sum(CASE WHEN level >= 500 THEN n ELSE 0 END) OVER (PARTITION BY stratum) AS half FROM l),
cut AS (SELECT stratum, min(level) AS cut FROM f WHERE 1000 * below - 2 * half * (1000 - level) <= 0.1 * 1000 * below GROUP BY 1),
spans AS (SELECT doc_id, a, kind, z FROM s WHERE kind < 3 UNION ALL SELECT doc_id, a, 3, z FROM s JOIN p USING (part) JOIN cut USING (stratum) WHERE kind = 3 AND level >= cut),
o AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_random,
  string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY a, kind) AS spans FROM (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || a || ':' || z AS x FROM spans) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)
"""

# stretches of six equal words at two places of a document; a run holds one. CRC-32 bit by bit
OP12_SQL = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) AS h FROM documents),
e AS (SELECT doc_id, w, h, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
f AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM e),
six AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM f WHERE n > 5)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
o AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m),
r AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 6 + q AS length, q FROM o GROUP BY doc_id, q, k),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM r WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY 1),
best AS (SELECT doc_id, arg_min(struct_pack(s := start, l := length, p := period), row(-length, start, period)) AS b FROM runs GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS c FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM f) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM f LEFT JOIN t USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_NEAREST = """, a{k} AS MATERIALIZED (SELECT x.vec_id, x.part, arg_min(e.entry, row(list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e.entry)) AS entry,
  min(list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM x JOIN e{k} e ON x.part = e.part GROUP BY 1, 2)"""
_MEANS = """, e{next} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{k} e LEFT JOIN (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS v FROM (SELECT a.part, a.entry, pos, sum(x.v[pos]) AS s, count(*) AS n FROM a{k} a JOIN x USING (vec_id, part), range(1, 17) r(pos) GROUP BY 1, 2, 3) GROUP BY 1, 2
  ) m USING (part, entry))"""
# rounds are written out; vectors of 64 components
OP13_SQL = """
WITH ok AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, part, q[16 * part + 1 : 16 * part + 16] AS v FROM ok, range(4) r(part)),
e0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM x WHERE vec_id IN (SELECT vec_id FROM ok ORDER BY vec_id LIMIT 256))
""" + "".join(_NEAREST.format(k=k) + _MEANS.format(k=k, next=k + 1) for k in range(4)) + _NEAREST.format(k=4) + """
, c AS (SELECT vec_id, string_agg(lpad(printf('%x', CAST(entry AS INTEGER)), 2, '0'), '' ORDER BY part) AS code, sum(d) AS error FROM a4 GROUP BY 1)
SELECT vec_id, code, CAST(error AS BIGINT) AS error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM e4) AS codebooks_sha256
FROM c JOIN ok USING (vec_id)
"""

SQL = {"op1_embedding_near_dedup": OP1_SQL, "op3_html_extraction": OP3_SQL, "op4_minhash_near_dedup": OP4_SQL, "op10_warc_round_trip": OP10_SQL, "op11_secret_scan": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_vector_codes": OP13_SQL}
