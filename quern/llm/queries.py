"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from quern.llm.bpe_index import encode
from quern.llm.mixing import mix_sources
from quern.llm.near_minhash import near_duplicate_classes
from quern.llm.near_vectors import near_duplicate_vectors
from quern.llm.packing import pack_documents
from quern.llm.pii_information import personal_data_digest
from quern.llm.quality_gam import score_quality
from quern.llm.sharding import assign_shards
from quern.llm.telephony_audio import text_media
from quern.llm.toxicity_ngrams import score_toxicity
from quern.llm.url_filter import judge_pages
from quern.llm.vector_codes import compress_vectors
from quern.llm.whitening import whiten
from quern.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; one in a small file or two is dealt out to all cores."""
    return read_table(spark, sf_dir, name, spread=True)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _of_documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _of_labelled(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def _of_embeddings(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "embeddings"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_gam": _of_labelled(score_quality),
    "op2_pii_information": _of_documents(personal_data_digest),
    "op3_mixing": _op3,
    "op4_toxicity_ngrams": _of_labelled(score_toxicity),
    "op5_near_vectors": _op5,
    "op6_telephony_audio": _of_documents(text_media),
    "op7_url_filter": _op7,
    "op8_bpe_index": _op8,
    "op9_near_minhash": _of_documents(near_duplicate_classes),
    "op10_sharding": _of_documents(assign_shards),
    "op11_packing": _op11,
    "op12_whitening": _of_embeddings(whiten),
    "op13_vector_codes": _of_embeddings(compress_vectors),
    "pipeline": _pipeline,
}

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_KEY = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '#' || md5(coalesce(text, ''))), 1, 15))::BIGINT"


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach(node, component)`` of ``links(a, b)`` over ``nodes(node)``."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
      walk(node, seen) AS (SELECT node, node FROM {nodes} UNION SELECT walk.node, b FROM walk JOIN both_ways ON a = seen),
      reach AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)"""


def _nearest(book: str) -> str:
    """``(vec_id, label, part, v, error, entry)``: each part's nearest entry of ``book(part, entry, w)``, the lowest of equal ones."""
    return f"""SELECT vec_id, label, part, any_value(v) AS v, min(far) // 64 AS error, min(far) % 64 AS entry FROM (
      SELECT p.*, 64 * ((v[1] - w[1]) * (v[1] - w[1]) + (v[2] - w[2]) * (v[2] - w[2]) + (v[3] - w[3]) * (v[3] - w[3]) + (v[4] - w[4]) * (v[4] - w[4])) + entry AS far FROM p JOIN {book} USING (part)) GROUP BY vec_id, label, part"""


def _refined(book: str, near: str) -> str:
    """The entries of ``book`` as floored means of the parts that ``near`` gave them; unused ones stay."""
    means = ", ".join(f"floor(sum(v[{k}])::DOUBLE / count(*))::BIGINT" for k in (1, 2, 3, 4))
    return f"""SELECT part, entry, coalesce(mean, w) AS w FROM {book} LEFT JOIN (SELECT part, entry, [{means}] AS mean FROM {near} GROUP BY part, entry) USING (part, entry)"""


ORACLE_SQL: dict[str, str] = {
    "op13_vector_codes": f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
      p AS MATERIALIZED (SELECT vec_id, label, part, x[4 * part + 1 : 4 * part + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
      book0 AS MATERIALIZED (SELECT part, entry, v AS w FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),
      near0 AS MATERIALIZED ({_nearest("book0")}), book1 AS MATERIALIZED ({_refined("book0", "near0")}),
      near1 AS MATERIALIZED ({_nearest("book1")}), book2 AS MATERIALIZED ({_refined("book1", "near1")}), near2 AS MATERIALIZED ({_nearest("book2")}),
      coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM near2 GROUP BY vec_id, label)
      SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
        (SELECT sha256(string_agg(w[1] || ',' || w[2] || ',' || w[3] || ',' || w[4], ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256 FROM coded""",
    "op3_mixing": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size, {_KEY} AS k FROM documents),
      s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
      w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
      l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
      t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
      p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
      SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN size > 0 THEN (whole + (2 * before + size <= 2 * (target - whole * source_size))::INT) * size ELSE 0 END::BIGINT AS taken FROM p""",
    "op5_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id AS node, label, embedding::DOUBLE[] AS e FROM embeddings),
      links AS (SELECT x.node AS a, y.node AS b FROM v x JOIN v y ON x.label = y.label AND x.node <> y.node AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93::DOUBLE), {_components("v", "links")}
      SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component AS component_id, node = component AS kept FROM reach""",
    "op7_url_filter": r"""WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
      tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url LIKE '%://%'),
      named AS (SELECT url, trim(replace(CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''>]+)', 1)
        WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"''>]*)', 1) END, '&amp;', '&')) AS link FROM tags),
      ends AS (SELECT url, CASE WHEN link LIKE '%://%' THEN link WHEN link LIKE '//%' THEN split_part(url, ':', 1) || ':' || link WHEN link LIKE '/%' THEN regexp_extract(url, '^.*?://[^/?#]*') || link
        ELSE regexp_extract(regexp_extract(url, '^.*?://[^?#]*'), '^(.*?://.*/)', 1) || link END AS target FROM named WHERE link <> ''),
      clean AS (SELECT regexp_replace(url, '#.*$', '') AS a, regexp_replace(target, '#.*$', '') AS b FROM ends),
      urls AS (SELECT DISTINCT u FROM (SELECT regexp_replace(url, '#.*$', '') AS u FROM pages UNION SELECT a FROM clean UNION SELECT b FROM clean) WHERE u IS NOT NULL),
      parts AS (SELECT u, lower(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
      own AS (SELECT u, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
      edges AS (SELECT a, b FROM clean UNION SELECT b, a FROM clean),
      walk(u, seen) AS (SELECT u, u FROM urls UNION SELECT walk.u, b FROM walk JOIN edges ON a = seen),
      bad AS (SELECT DISTINCT walk.u FROM walk JOIN own ON own.u = seen WHERE own.verdict = 'block')
      SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own.verdict, CASE WHEN bad.u IS NOT NULL AND pages.url LIKE '%://%' THEN 'block' ELSE 'allow' END) AS verdict
      FROM pages LEFT JOIN own ON own.u = regexp_replace(pages.url, '#.*$', '') LEFT JOIN bad ON bad.u = own.u""",
    "op9_near_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id AS node, regexp_extract_all({_AZ}, {_WORDS}) AS w FROM documents),
      s AS (SELECT node, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w),
      n AS (SELECT node, len(s) AS n FROM s), single AS (SELECT node, unnest(s) AS g FROM s),
      common AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM single x JOIN single y ON x.g = y.g AND x.node < y.node GROUP BY 1, 2),
      links AS (SELECT a, b FROM common JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE 100 * c >= 85 * (x.n + y.n - c)), {_components("n", "links")}
      SELECT node AS doc_id, n::BIGINT AS n_shingles, component AS component_id, node = component AS kept FROM reach JOIN n USING (node)""",
}
