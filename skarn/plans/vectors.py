"""Vector, hybrid and store queries over the embedding and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.functions.embed import embedded
from skarn.functions.exprs import chunk_id, cosine_distance, parse_vector, vector_text
from skarn.operators import chunks as C, merge, search, stats

from .base import Tables, query


def chunk_table(t: Tables) -> DataFrame:
    """Embedded documents as chunks: the source stands for type and path, the language for language."""
    docs = t.documents.select("doc_id", "text", "lang", "source")
    return t.embeddings.join(docs, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("id"), F.col("source").alias("chunk_type"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), "embedding",
    )


def query_vector(t: Tables) -> list[float]:
    row = t.embeddings.where("vec_id = 0").select("embedding").first()
    return list(row[0])


def query_set(t: Tables) -> DataFrame:
    """The stated queries: every row whose id is divisible by 20."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


PAIRS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
chunks AS (SELECT vec_id AS id, source AS chunk_type, 'doc_' || doc_id AS name, source AS file_path, text AS content, lang AS language, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id)"""


@query("""SELECT vec_id, label, round(d, 6) AS similarity_distance, round(d, 6) AS distance, round(1 - d, 6) AS similarity_score
FROM (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings)
ORDER BY d, vec_id LIMIT 10""")
def vector_topk(t):
    found = search.similar(t.embeddings.withColumnRenamed("vec_id", "id"), query_vector(t), 10)
    return found.select(F.col("id").alias("vec_id"), "label", *[F.round(c, 6).alias(c) for c in ("similarity_distance", "distance", "similarity_score")])


@query("""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, round(1 - list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 12) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT query_id, id, label, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d) WHERE n <= 10""")
def vector_topk_all(t):
    found = search.similar_many(t.embeddings.withColumnRenamed("vec_id", "id"), query_set(t), 10)
    return found.select("query_id", "id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PAIRS}, d AS (SELECT query_id, id, chunk_type, language, round(1 - list_cosine_similarity(e, v), 12) AS d FROM q, chunks WHERE chunk_type = 'src1' AND language = 'en')
SELECT query_id, id, chunk_type, language, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d) WHERE n <= 10""")
def vector_topk_filtered(t):
    found = search.similar_many(chunk_table(t), query_set(t), 10, {"chunk_type": "src1", "language": "en", "limit": 3})
    return found.select("query_id", "id", "chunk_type", "language", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PAIRS}, d AS (SELECT query_id, id, file_path, round(1 - list_cosine_similarity(e, v), 12) AS d FROM q, chunks WHERE file_path LIKE '%rc1%')
SELECT query_id, id, file_path, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d) WHERE n <= 10""")
def vector_topk_path_like(t):
    found = search.similar_many(chunk_table(t), query_set(t), 10, {"file_path": "rc1"})
    return found.select("query_id", "id", "file_path", F.round("distance", 6).alias("distance"))


@query(f"""WITH {PAIRS}, d AS (SELECT query_id, id, name, round(1 - list_cosine_similarity(e, v), 12) AS d, CASE WHEN contains(lower(content), 'the') THEN 0.2::DOUBLE WHEN contains(lower(name), 'the') THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS kw
FROM q, chunks WHERE contains(lower(content), 'the') OR contains(lower(name), 'the'))
SELECT query_id, id, name, round(d, 6) AS distance, kw AS keyword_score, round(1 - d + kw, 6) AS combined_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d - kw, id) AS n FROM d) WHERE n <= 10""")
def hybrid_search(t):
    found = search.hybrid_many(chunk_table(t), query_set(t), "THE", 10)
    return found.select("query_id", "id", "name", F.round("distance", 6).alias("distance"), "keyword_score", F.round("combined_score", 6).alias("combined_score"))


@query(f"""WITH {PAIRS}, d AS (SELECT query_id, id, name, file_path, round(1 - list_cosine_similarity(e, v), 12) AS d, CASE WHEN contains(lower(content), 'ing') THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS kw FROM q, chunks WHERE chunk_type = 'src2')
SELECT query_id, name, file_path, round(d, 6) AS distance, kw AS keyword_boost FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d - kw, id) AS n FROM d) WHERE n <= 10""")
def hybrid_search_boost_only(t):
    found = search.boosted_many(chunk_table(t), query_set(t), "ing", 10, {"chunk_type": "src2"})
    return found.select("query_id", "name", "file_path", F.round("distance", 6).alias("distance"), "keyword_boost")


@query("""SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_pair_distance(t):
    a, b = (t.embeddings.select(F.col("vec_id").alias(f"{k}_id"), F.col("embedding").alias(k)) for k in "ab")
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("SELECT count(*) AS queries, 10 * count(*) AS found, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def ann_index_search(t):
    """The index's ten nearest for every stated query, held against the exact ones: the queries' own rows don't count."""
    rows = t.embeddings.withColumnRenamed("vec_id", "id")
    index = search.SignIndex(len(query_vector(t)))
    others = F.col("id") != F.col("query_id")
    near = index.search_many(index.build(rows), query_set(t), 11).select("query_id", "id")
    exact = search.similar_many(rows, query_set(t), 11).where(others).select("query_id", "id", F.lit(True).alias("right"))
    both = near.where(others).join(exact, ["query_id", "id"], "left")
    total = both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("found"), F.count("right").alias("right"))
    return total.select("queries", "found", (F.col("right") >= 0.9 * 10 * F.col("queries")).alias("recall_reached"))


class Vowels:
    """A provider that SQL can repeat: how often a text has each vowel."""

    dimension = 5

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float((text or "").count(c)) for c in "aeiou"] for text in texts]


@query("""WITH v AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE) AS e FROM documents WHERE text IS NOT NULL),
d AS (SELECT q.doc_id AS query_id, v.doc_id AS id, round(1 - list_cosine_similarity(v.e, q.e), 12) AS d FROM v q, v WHERE q.doc_id % 20 = 0 AND list_sum(q.e) > 0 AND list_sum(v.e) > 0)
SELECT query_id, id, round(d, 6) + 0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS n FROM d) WHERE n <= 10""")
def text_search(t):
    chunks = embedded(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), Vowels(), text=F.coalesce("content", F.lit("")))
    asked = t.documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.search_texts(chunks, Vowels(), asked, 10).select("query_id", "id", (F.round("distance", 6) + 0).alias("distance"))


@query("""SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS name, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS start_line, length(text) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def chunk_upsert(t):
    rows = lambda name, line: t.documents.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), name.alias("name"), F.col("text").alias("content"), F.lit(line).alias("start_line"), F.lit(line).alias("end_line"), "doc_id")
    new = rows(F.lit("old"), 1).unionByName(rows(F.lit("new"), 2)).where("doc_id % 3 = 0")
    stored = C.upsert(rows(F.col("lang"), 0).where("doc_id % 2 = 0").drop("doc_id"), new.drop("doc_id"))
    return stored.select("id", "name", "start_line", F.length("content").cast("bigint").alias("n"))


@query("SELECT doc_id, lang, source, length(text) AS n FROM documents WHERE doc_id = 7")
def chunk_lookup(t):
    return t.documents.where("doc_id = 7").limit(1).select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def chunk_delete_by_file(t):
    gone = t.documents.select("source").where(F.col("source").isin("src1", "src2"))
    return merge.delete_by(t.documents.select("doc_id", "source"), gone, ["source"])


def _stored(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("chunk_type"), F.col("lang").alias("language"), F.col("text").alias("content")).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


@query("""SELECT count(*) AS total_chunks, count(embedding) AS embedded_chunks, round(avg(length(text)), 4) AS average_content_length
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def store_stats(t):
    return stats.store_totals(_stored(t)).withColumn("average_content_length", F.round("average_content_length", 4))


@query("SELECT source AS chunk_type, count(*) AS n FROM documents GROUP BY 1")
def stats_by_type(t):
    return stats.by_type(_stored(t))


@query("SELECT lang AS language, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def stats_by_language(t):
    return stats.by_language(_stored(t))


@query("SELECT source, round(avg(length(text)), 4) AS avg_length FROM documents GROUP BY 1")
def stats_avg_len(t):
    return t.documents.groupBy("source").agg(F.round(F.avg(F.length("text")), 4).alias("avg_length"))


@query("""SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 6))), 4) AS total FROM embeddings""")
def vector_text_roundtrip(t):
    back = parse_vector(vector_text(F.col("embedding")))
    return t.embeddings.select("vec_id", F.size(back).cast("bigint").alias("dims"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + F.round(x, 6)), 4).alias("total"))


@query("""SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def metadata_json(t):
    bag = F.to_json(F.struct(F.col("event_type").alias("type"), F.from_json("props", "k bigint").alias("props")))
    rows = t.events.select("event_id", bag.alias("metadata"))
    read = F.from_json("metadata", "type string, props struct<k:bigint>")
    return rows.select("event_id", read["type"].alias("event_type"), read["props"]["k"].alias("k"))


@query("""SELECT 'func_' || source || '_' || doc_id AS function_id, 'imports_' || source AS imports_id, 'file_' || source AS file_id, doc_id FROM documents""")
def chunk_ids(t):
    path = F.col("source")
    return t.documents.select(chunk_id("func", path, F.col("doc_id").cast("string")).alias("function_id"), chunk_id("imports", path).alias("imports_id"), chunk_id("file", path).alias("file_id"), "doc_id")


@query("""SELECT doc_id, md5('Type: function' || chr(10) || 'Name: d' || doc_id || chr(10) || 'File: ' || source || chr(10) || 'Language: ' || lang || chr(10)
 || CASE WHEN doc_id % 3 = 0 THEN 'Signature: (x: ' || lang || ')' || chr(10) ELSE '' END || chr(10) || '--- Content ---' || chr(10) || chr(10) || text) AS digest FROM documents""")
def embedding_text(t):
    rows = t.documents.select(
        "doc_id", F.lit("function").alias("chunk_type"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("file_path"), F.col("lang").alias("language"), F.col("text").alias("content"),
        F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("(x: "), F.col("lang"), F.lit(")"))).otherwise("").alias("signature"))).alias("metadata"),
    )
    return rows.select("doc_id", F.md5(C.embedding_text().cast("binary")).alias("digest"))


@query("""SELECT * FROM (SELECT 'function' AS chunk_type, p_name AS name, 'func_' || p_brand || '_' || p_name AS id FROM part WHERE p_size <= 10
UNION ALL SELECT 'class', p_name, 'class_' || p_brand || '_' || p_name FROM part WHERE p_size > 10 AND p_size <= 20
UNION ALL SELECT 'interface', p_name, 'interface_' || p_brand || '_' || p_name FROM part WHERE p_size > 20 AND p_size <= 30)""")
def chunk_union(t):
    def kind(name: str, prefix: str, condition: str) -> DataFrame:
        return t.part.where(condition).select(F.lit(name).alias("chunk_type"), F.col("p_name").alias("name"), chunk_id(prefix, F.col("p_brand"), F.col("p_name")).alias("id"))

    return kind("function", "func", "p_size <= 10").unionByName(kind("class", "class", "p_size > 10 and p_size <= 20")).unionByName(kind("interface", "interface", "p_size > 20 and p_size <= 30"))


@query("""SELECT 'file_' || doc_id AS id, true AS is_fallback FROM documents d WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)""")
def chunk_fallback(t):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"))
    found = C.fallback_chunks(files, t.embeddings.select(F.col("vec_id").cast("string").alias("file_path")))
    return found.select("id", F.get_json_object("metadata", "$.is_fallback").cast("boolean").alias("is_fallback"))
