"""Registered queries of this subpackage: key -> (spark, sf_dir) -> DataFrame.

Each query applies one operator with its production parameters to a whole
table and derives the result columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revlens.llm import bottom_k, decontaminate, divergence, html_extract, language_id, ngram_join, packing, quality, secret_scan, simhash, spelling, token_shards, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), whole=True))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def part(modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the contract's split of the rows (NULL, so not learned from, without an id)."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), part(5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(part(5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, part(4) != 2)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(part(4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.histories(table(spark, sf_dir, "pages")))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.digest(bottom_k.compare_with_edit(table(spark, sf_dir, "documents")))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_shards.materialise(table(spark, sf_dir, "documents"))
    return token_shards.read_back(shards, token_shards.total_rows(shards))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_bottom_k": op8_bottom_k,
    "op9_token_shards": op9_token_shards,
    "op10_pack": op10_pack,
    "op11_ngram_join": op11_ngram_join,
    "op12_source_divergence": op12_source_divergence,
    "op13_spelling_variants": op13_spelling_variants,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: DuckDB SQL by key, for the queries that SQL can express.
ORACLE: dict[str, str] = {
    # every window of every item against every place of every document
    "op5_decontaminate": f"""WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM item)),
place AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM item))),
found AS (SELECT doc_id, place.size, i, item_id FROM place JOIN win ON place.win = win.win AND place.size = win.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
own AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
    sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op7_warc": """WITH page AS (SELECT page_id, url, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
    if(strlen(body) >= 1000 AND page_id <> top, 'revisit', 'response') AS record_type,
    CASE WHEN strlen(body) >= 1000 AND page_id <> top THEN top END AS refers_to,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www[.]', ''), '.')), ',') || ')' ||
        lower(if(regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) = '', '/', regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1))) ||
        lower(regexp_extract(url, '^[^?#]*([?][^#]+)', 1)) AS url_key,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp
FROM page""",
    # every two documents that share a shingle
    "op11_ngram_join": f"""WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT r, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM doc)),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
link AS (SELECT a.r AS a, b.r AS b FROM gram a JOIN gram b ON a.g = b.g AND a.r <> b.r JOIN size x ON x.r = a.r JOIN size y ON y.r = b.r
    GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (WITH RECURSIVE t AS (SELECT r AS a, r AS b FROM doc UNION SELECT t.a, link.b FROM t JOIN link ON link.a = t.b) SELECT * FROM t)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM doc d JOIN reach ON reach.a = d.r JOIN doc o ON o.r = reach.b LEFT JOIN size ON size.r = d.r GROUP BY d.r, d.doc_id""",
    # every source with every kept term of its language, counts of zero included
    "op12_source_divergence": f"""WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM doc),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
cell AS (SELECT lang, source, term, coalesce(cnt.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 2)) // (coalesce(tot.n, 0) + 2 * v.v) AS p,
        1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
    FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN tot USING (lang, source) LEFT JOIN cnt USING (lang, source, term)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
part AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM cell WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM part
QUALIFY part = 'pair' OR rank <= 10""",
    # CRC-32 byte by byte from its 256 values; replacements by the word without the place, deletions directly
    "op13_spelling_variants": f"""WITH bits AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)),
        lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) t(i))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
often AS (SELECT doc_id, run, count(*) AS n FROM run WHERE len(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(strlen(coalesce(doc_id::VARCHAR, '') || ':' || run)),
        lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c & 255, b) + 1)::INTEGER]))) AS h FROM often, bits),
word AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % len(run))::INTEGER) || substr(run, (h % len(run) + 2)::INTEGER) ELSE run END AS word, n FROM hashed)
    WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT DISTINCT word, n, i, left(word, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM word)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND len(a.word) = len(b.word)
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
own AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
    FROM word LEFT JOIN best USING (word)),
path AS (WITH RECURSIVE p AS (SELECT word, word AS here, 0 AS k FROM own UNION ALL SELECT p.word, own.form, k + 1 FROM p JOIN own ON own.word = p.here WHERE own.form IS NOT NULL) SELECT * FROM p)
SELECT own.word, form, arg_max(here, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n FROM own JOIN path USING (word) GROUP BY own.word, form""",
}
