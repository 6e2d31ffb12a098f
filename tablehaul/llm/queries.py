"""The registered queries of this package and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm import collocations, decontamination, exact, extraction, imatch, mixing, packing, search, sharding, simhash, suffix, toxicity, windows
from tablehaul.llm.common import keyed, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Phrases and document words as lists, joined on the joined words of every stretch of a phrase's length.
ORACLES["op1_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0) t),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
stretches AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM phrases) l WHERE len(w) >= n) t),
hits AS (SELECT s.doc_id, s.p, s.n, f.item_id FROM stretches s JOIN phrases f ON s.phrase = f.phrase AND s.n = f.n),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM hits) t GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) t GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

# Every string of 100 bytes as 200 hex digits; all but the first of each cover their bytes.
ORACLES["op5_suffix_array"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p - 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS p FROM docs WHERE length(h) >= 200) t),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM strings) t WHERE n > 1),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS b FROM
  (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM
    (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM later) t) u
  GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b + 1 AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1 AS b FROM
  (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, 0, 0 FROM docs) t),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (coalesce(b, length(h) // 2) - a + 1)), '' ORDER BY a) AS h
  FROM gaps JOIN docs USING (doc_id) WHERE coalesce(b, length(h) // 2) >= a GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n, sum(b - a + 1) AS removed FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN spans USING (doc_id)"""


def learned_rows():
    """Labels to learn from: those whose crc32 of the id as text leaves a remainder other than 1 by 3."""
    return ~held_out_rows()


def held_out_rows():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@register
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's words inside benchmark phrases of 10 words."""
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's SimHash of three-word shingles and its group at two bits."""
    prints = simhash.fingerprints(table(spark, folder, "documents"), shingle=3)
    return simhash.near_groups(prints, distance=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@register
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids, packed into rows of 2048."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@register
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 40 shards that hold equal counts and the same mixture of sources."""
    text = F.coalesce("text", F.lit(""))
    docs = keyed(table(spark, folder, "documents")).select(
        "__row", "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return docs.join(sharding.assign(docs, 40), "__row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@register
def op5_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes that strings of 100 bytes cover which start earlier."""
    made = suffix.remove_repeats(table(spark, folder, "documents"), 100, keep_text=False)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


@register
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    scored = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), learned_rows())
    return scored.select(
        "doc_id", held_out_rows().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "terms", "nearest",
    )


@register
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mixture of its sources at weights 1, 2, 3 in turn takes."""
    docs = keyed(table(spark, folder, "documents"))
    taken = mixing.mix(docs).taken
    return docs.select("__row", "doc_id").join(taken, "__row").drop("__row", "h")


@register
def op8_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate passages of 50 words or more of different documents."""
    return windows.near_passages(table(spark, folder, "documents"))


@register
def op9_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return imatch.compare_edited(table(spark, folder, "documents"))


@register
def op10_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's main text."""
    return extraction.extract(table(spark, folder, "pages"))


@register
def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the one that stays of all that are equal but for white space."""
    return exact.duplicates(table(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


ORACLES["op13_exact"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, count(*) OVER (PARTITION BY t) AS group_size,
  first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept FROM d
  WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM r"""


@register
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """Each language's 2000 phrases of two to five words that score highest."""
    return collocations.collocations(table(spark, folder, "documents"))


# Every phrase with its count, its cuts and their parts' counts, and the phrases of one word more around it.
ORACLES["op11_collocations"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))) AS g
  FROM w, (SELECT unnest(range(1, 6)) AS k) t WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 100),
cuts AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS c FROM f WHERE k > 1),
scored AS (SELECT c.lang, c.k, c.g, c.c, c.a, l.f AS l, r.f AS r, n,
    CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.k = c.c AND l.g = list_slice(c.g, 1, c.c)
  JOIN f r ON r.lang = c.lang AND r.k = c.k - c.c AND r.g = list_slice(c.g, c.c + 1, c.k)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, c) = 1),
inner_ AS (SELECT lang, k, g[1:k-1] AS g, a FROM best UNION ALL SELECT lang, k, g[2:k], a FROM best),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.k = b.k + 1 AND i.g = b.g AND 100 * i.a >= 100 * b.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000"""


@register
def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item's ten documents that rank highest."""
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

# All scores of items and documents, summed over their common terms.
ORACLES["op12_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
corpus AS (SELECT CAST(sum(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d) t GROUP BY k, doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, corpus GROUP BY term, n_docs),
items AS (SELECT i, item_id, term, count(*) AS times FROM
  (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) t GROUP BY i, item_id, term),
scores AS (SELECT i, item_id, k, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term), corpus GROUP BY i, item_id, k, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10"""
