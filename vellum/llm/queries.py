"""The registered queries opN_<name>: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return deco


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_toxicity")
def op1(spark, sf):
    from vellum.llm.toxicity import fit_documents, held_out, score
    docs = table(spark, sf, "documents")
    model = fit_documents(docs, table(spark, sf, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_fingerprints")
def op2(spark, sf):
    from vellum.llm.iblt import fingerprint_documents
    return fingerprint_documents(table(spark, sf, "documents"))


@query("op3_decontamination")
def op3(spark, sf):
    from vellum.llm.decontam import find_items
    return find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op4_licenses")
def op4(spark, sf):
    from vellum.llm.licenses import scan
    return scan(table(spark, sf, "documents"))


@query("op5_token_file")
def op5(spark, sf):
    from vellum.llm.token_store import round_trip
    return round_trip(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"))


@query("op6_packing")
def op6(spark, sf):
    from vellum.llm.packing import pack_documents
    return pack_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))


#: Production shards of op7.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _op7_sql() -> str:
    from vellum.llm.sharding import TABLE_SIZE, fill_table
    owner = ",".join(map(str, fill_table(SHARDS, TABLE_SIZE)))
    return f"""
WITH lookup AS (SELECT unnest(range({TABLE_SIZE})) AS slot, unnest(string_split('{owner}', ','))::INT AS owner),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(owner::VARCHAR, 3, '0') AS shard FROM placed JOIN lookup USING (slot)"""


@query("op7_sharding", _op7_sql())
def op7(spark, sf):
    from vellum.llm.sharding import place
    return place(table(spark, sf, "documents"), SHARDS).select("doc_id", "slot", "shard")


@query("op8_simhash")
def op8(spark, sf):
    from vellum.llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


#: The contract's rules of op9: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_OP9_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'),
                                           ('allow','com','/fr/'), ('block','com','/de/')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS rn, page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.rn, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS best
         FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.rn)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rn)"""


@query("op9_url_filter", _OP9_SQL)
def op9(spark, sf):
    from vellum.llm.urlfilter import filter_urls, rule_table
    pages = table(spark, sf, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query("op10_token_counts")
def op10(spark, sf):
    from vellum.llm.wordpiece import count_tokens
    return count_tokens(table(spark, sf, "documents").select("doc_id", "text"), tokenizer("word_bpe_49k.json")) \
        .select("doc_id", "n_words", "n_tokens")


_OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, c.rn AS other, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.rn <> c.rn AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op12_topk_join", _OP12_SQL)
def op12(spark, sf):
    from vellum.llm.knn_join import knn_join
    return knn_join(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM d WHERE len(terms) > 0),
normal AS (SELECT rn, doc_id, 75 + (25 * len(terms)::BIGINT * big_n) // big_l AS m FROM d, total WHERE len(terms) > 0),
post AS (SELECT rn, term, count(*)::BIGINT AS tf FROM (SELECT rn, unnest(terms) AS term FROM d) GROUP BY rn, term),
weight AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, total GROUP BY term, big_n),
q AS (SELECT row_number() OVER () AS qn, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT qn, item_id, term, count(*)::BIGINT AS c FROM (SELECT qn, item_id, unnest({_TERMS}) AS term FROM q) GROUP BY qn, item_id, term),
scored AS (SELECT qn, item_id, rn, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
           FROM asked JOIN weight USING (term) JOIN post USING (term) JOIN normal USING (rn) GROUP BY qn, item_id, rn, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""


@query("op11_lexical_search", _OP11_SQL)
def op11(spark, sf):
    from vellum.llm.lexical import build_index, query_terms, search
    items = table(spark, sf, "benchmark").select("item_id", "text")
    return search(build_index(table(spark, sf, "documents"), query_terms(items)), items, k=20)


@query("op13_tokenizer_alignment")
def op13(spark, sf):
    from vellum.llm.align import align_documents
    return align_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
