"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.session import share_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _remainder(n: int) -> Column:
    """crc32 of the doc_id as text, mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def toxicity_model(docs: DataFrame, labels: DataFrame):
    from tidemark.llm.toxicity import learn

    return learn(docs, labels, _remainder(3) != 1)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learn(docs, _remainder(5) != 0))
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in a folder for each source, a hundred ids to a folder in it. One whose text speaks of a licence
    states its own for its folder."""
    from tidemark.llm.license_scan import licence_scan

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("path", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string")))
    return licence_scan(docs, F.col("text").rlike("(?i)licen[cs]e"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_language_id": op6_language_id,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
}

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _folded(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM d WHERE len(ws) >= 50),
w AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
g AS (SELECT doc_id, p FROM w JOIN m USING (k) WHERE least < doc_id),
i AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT i.doc_id, i.i, i.word, coalesce(max(g.p) OVER (PARTITION BY i.doc_id ORDER BY i.i ROWS UNBOUNDED PRECEDING) >= i.i - 49, false) AS gone FROM i LEFT JOIN g ON g.doc_id = i.doc_id AND g.p = i.i),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op3_decontamination": f"""
WITH b AS (SELECT item_id, regexp_extract_all({_folded("text")}, {_ALNUM}) AS ws FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_folded("text")}, {_ALNUM}) AS ws FROM documents),
s AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM x) WHERE len(ws) >= n),
h AS (SELECT s.doc_id, s.p, s.n, x.item_id FROM s JOIN x ON x.n = s.n AND x.k = array_to_string(s.ws[s.p:s.p + s.n - 1], ' ')),
e AS (SELECT doc_id, p, max(p + n - 1) AS e FROM h GROUP BY ALL),
i AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT i.doc_id, coalesce(max(e.e) OVER (PARTITION BY i.doc_id ORDER BY i.i ROWS UNBOUNDED PRECEDING) >= i.i, false) AS hit FROM i LEFT JOIN e ON e.doc_id = i.doc_id AND e.p = i.i),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (hit) AS n_hit FROM c GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items, list(item ORDER BY item) AS item_ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c""",
    "op7_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_folded("text")}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + least(len(ws), 4) - 1], ' ') || ' ' || least(len(ws), 4) AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op5_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
s AS (SELECT doc_id, raw, unnest(range(1, octet_length(raw) - 198)) AS p FROM d WHERE octet_length(raw) >= 200),
w AS (SELECT doc_id, p, md5_number(array_slice(raw, p, p + 199)) AS k FROM s),
g AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
i AS (SELECT *, max(p + 199) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g),
o AS (SELECT *, sum(CASE WHEN seen IS NULL OR p > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM i),
r AS (SELECT doc_id, span, min(p) AS a, max(p) + 199 AS b FROM o GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM r UNION ALL SELECT doc_id, max(b) + 1, 9000000000 FROM r GROUP BY doc_id),
t AS (SELECT k.doc_id, string_agg(hex(array_slice(raw, x, least(y, octet_length(raw)))), '' ORDER BY x) AS kept FROM k JOIN d USING (doc_id) WHERE x <= least(y, octet_length(raw)) GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, octet_length(raw) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN raw ELSE unhex(coalesce(kept, '')) END) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
}


def _license_sql(threshold: float = 0.8) -> str:
    """Every unit against every template, whatever words it holds, and the nearest folder above by its depth."""
    from tidemark.llm.license_scan import TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    words = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')".format
    templates = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    code = r"[ \t]*[^\s#/*;%-]"
    return f"""
WITH d AS (SELECT doc_id, concat_ws('/', source, CAST(floor(doc_id / 100) AS BIGINT), doc_id) AS path, text, coalesce(regexp_matches(text, '(?i)licen[cs]e'), false) AS grants FROM documents),
t(k, licence, text) AS (VALUES {templates}),
tw AS (SELECT k, licence, w, count(*) AS n FROM (SELECT k, licence, unnest({words("text")}) AS w FROM t) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM d),
df AS (SELECT w, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({words("text")}) AS w FROM d) WHERE w IN (SELECT w FROM tw) GROUP BY w),
idf AS (SELECT w, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), total),
tv AS (SELECT k, licence, w, tw.n * idf / sqrt(sum(tw.n * idf * tw.n * idf) OVER (PARTITION BY k)) AS weight FROM tw JOIN idf USING (w)),
low AS (SELECT doc_id, grants, lower(text) AS l FROM d WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(string_split(l, chr(10))) AS u FROM low
UNION SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_split_to_array(l, '\n(?:[^a-z0-9\n]*\n)+')) AS u FROM low) WHERE contains(u, chr(10))
UNION SELECT doc_id, u FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(l, '\n({code})', chr(1) || '\1', 'g'), chr(1))), '^{code}[^\n]*\n', '') AS u FROM low) WHERE contains(u, chr(10))
UNION SELECT doc_id, u FROM (SELECT doc_id, unnest(regexp_extract_all(l, '(?s)/\\*.*?\\*/')) AS u FROM low) WHERE contains(u, chr(10))
UNION SELECT doc_id, l FROM low WHERE grants),
units AS (SELECT u, row_number() OVER () AS id FROM (SELECT DISTINCT u FROM pieces)),
uw AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({words("u")}) AS w FROM units) GROUP BY ALL),
ux AS (SELECT id, w, uw.n * coalesce(idf, ln(1 + total.n) + 1) AS x FROM uw LEFT JOIN idf USING (w), total),
norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM ux GROUP BY id),
dots AS (SELECT id, k, licence, sum(x * weight) AS dot FROM ux JOIN tv USING (w) GROUP BY ALL),
near AS (SELECT id, licence, round(dot / norm, 9) AS score FROM dots JOIN norms USING (id) WHERE round(dot / norm, 9) >= {threshold}),
own AS (SELECT doc_id, max(score) AS score, min(licence) FILTER (score = top) AS own FROM (SELECT doc_id, licence, score, max(score) OVER (PARTITION BY doc_id) AS top FROM pieces JOIN units USING (u) JOIN near USING (id)) GROUP BY doc_id),
base AS (SELECT d.doc_id, path, grants, own, score, regexp_replace(path, '/?[^/]*$', '') AS folder FROM d LEFT JOIN own USING (doc_id)),
given AS (SELECT folder, min(path) AS licence_path, arg_min(own, path) AS licence FROM base WHERE grants AND own IS NOT NULL GROUP BY folder),
above AS (SELECT b.doc_id, arg_max(g.licence_path, length(g.folder)) AS licence_path, arg_max(g.licence, length(g.folder)) AS licence FROM base b JOIN given g ON b.own IS NULL AND (g.folder = '' OR b.folder = g.folder OR starts_with(b.folder, g.folder || '/')) GROUP BY b.doc_id)
SELECT b.doc_id, b.path, coalesce(b.own, a.licence) AS licence, b.score, b.own IS NULL AND a.licence IS NOT NULL AS inherited, a.licence_path FROM base b LEFT JOIN above a USING (doc_id)"""


ORACLE_SQL["op8_license_scan"] = _license_sql()
