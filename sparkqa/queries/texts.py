"""Corpus, retrieval and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkqa.functions import scalar as S
from sparkqa.operators import corpus, grounding, questions, retrieval
from sparkqa.queries.plans import table
from sparkqa.queries.tables import shared

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("b5_row_text", "SELECT p_partkey, concat_ws(chr(10), 'p_name: ' || p_name, 'p_brand: ' || nullif(p_brand, 'Brand#12'), 'p_size: ' || p_size) AS text FROM part")
def b5_row_text(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#12")))
    return corpus.row_text(rows, ["p_name", "p_brand", "p_size"]).select("p_partkey", "text")


@query("b6_described_rows", "SELECT trim(p_name) AS text, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, p_partkey AS row FROM part WHERE trim(p_name) <> ''")
def b6_described_rows(spark, sf_dir):
    out = corpus.described_rows(table(spark, sf_dir, "part"), "p_name", "p_partkey")
    return out.select("text", F.col("metadata")["p_brand"].alias("brand"), F.col("metadata")["p_size"].alias("size"), "row")


CELLS = "list_filter([trim(c) FOR c IN string_split(line, '|')], lambda c: c <> '' AND NOT regexp_matches(c, '^[-: ]+$'))"


@query("b7_flatten_tables", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
c AS (SELECT *, {CELLS} AS raw FROM l),
d AS (SELECT *, list_filter(raw, lambda x, k: k = 1 OR raw[k - 1] <> x) AS cells FROM c),
f AS (SELECT doc_id, i, CASE WHEN NOT contains(line, '|') THEN line WHEN len(cells) = 0 THEN NULL
      WHEN len(cells) >= 2 AND regexp_matches(replace(cells[-1], ',', ''), '^[+-]?\\$?(\\d+\\.?\\d*|\\.\\d+)$') THEN cells[-2] || ': ' || cells[-1] ELSE array_to_string(cells, ' | ') END AS line FROM d)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM f GROUP BY 1""")
def b7_flatten_tables(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.flatten_tables(F.col("text")).alias("text"))


@query("b8_amounts", """
SELECT p_partkey, p_partkey % 4 <> 3 AS amount FROM part""")
def b8_amounts(spark, sf_dir):
    x = F.col("p_retailprice").cast("string")
    forms = F.element_at(F.array(F.concat(F.lit("$"), x), F.concat(F.lit("-1,"), x), x, F.concat(x, F.lit(" kg"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.is_amount(forms).alias("amount"))


@query("b10_document_names", "SELECT coalesce(nullif(p_brand, 'Brand#12'), p_type) AS name, min(p_partkey) AS first FROM part GROUP BY 1")
def b10_document_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_brand") == "Brand#12", "  ").otherwise(F.col("p_brand")))
    return corpus.document_names(rows, ["p_brand", "p_type"], "p_partkey")


@query("a12_string_leaves", "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, line FROM (SELECT doc_id, unnest([source, text, lang]) AS line, unnest([1, 2, 3]) AS i FROM documents)")
def a12_string_leaves(spark, sf_dir):
    inner = F.struct(F.col("text").alias("b"), F.array(F.struct(F.col("n_chars").alias("n"), F.col("lang").alias("l"))).alias("c"))
    return corpus.string_leaves(table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("a"), inner.alias("d"))).alias("json")), "doc_id", "json")


def document_lines(spark, sf_dir):
    """Lines of documents, with some that are layout and some that are headings."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.when(F.col("pos") % 5 == 3, F.lit("texts/12")).when((F.col("pos") % 4 == 2) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("Deposits "), F.col("pos").cast("string"))).otherwise(F.col("line")))


LINES = """
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l1 AS (SELECT doc_id, pos, trim(CASE WHEN pos % 5 = 3 THEN 'texts/12' WHEN pos % 4 = 2 AND doc_id % 2 = 0 THEN 'Deposits ' || pos ELSE line END) AS line FROM l0),
l2 AS (SELECT doc_id, line, min(pos) AS pos FROM l1 WHERE length(line) >= 2 AND line <> 'texts/12' GROUP BY ALL)"""


@query("h4_first_seen_lines", f"WITH {LINES} SELECT doc_id, count(*) AS n, sum(pos) AS total FROM l2 GROUP BY 1")
def h4_first_seen_lines(spark, sf_dir):
    return corpus.first_seen(corpus.kept_lines(document_lines(spark, sf_dir)), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query("h5_section_chunks", f"""WITH {LINES},
s AS (SELECT *, count(CASE WHEN contains(lower(line), 'deposits') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM l2)
SELECT doc_id, 'chunk_' || row_number() OVER (PARTITION BY doc_id ORDER BY no) AS id, CASE WHEN no = 0 THEN 'general' ELSE 'deposits' END AS section, string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY doc_id, no""")
def h5_section_chunks(spark, sf_dir):
    lines = corpus.first_seen(corpus.kept_lines(document_lines(spark, sf_dir)), "doc_id")
    return corpus.section_chunks(lines, "doc_id").select("doc_id", "id", "section", "text")


@query("a13_write_chunks", f"""WITH {LINES},
s AS (SELECT *, count(CASE WHEN contains(lower(line), 'deposits') THEN 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM l2)
SELECT CASE WHEN no = 0 THEN 'general' ELSE 'deposits' END AS section, 'statement' AS document_type, count(DISTINCT (doc_id, no)) AS n FROM s GROUP BY 1""")
def a13_write_chunks(spark, sf_dir):
    path = shared(spark, "chunks")
    corpus.section_chunks(corpus.first_seen(corpus.kept_lines(document_lines(spark, sf_dir)), "doc_id"), "doc_id", "statement").select("id", "section", "document_type", "text").write.json(path)
    return spark.read.schema("id string, section string, document_type string, text string").json(path).groupBy("section", "document_type").agg(F.count("*").alias("n"))


@query("h1_split_documents")
def h1_split_documents(spark, sf_dir):
    """Chunks of all documents (properties are tested against plain Python)."""
    return corpus.split_documents(table(spark, sf_dir, "documents"), "doc_id", keep=["source"])


@query("h2_corpus_chunks", """SELECT 'row' AS kind, count(*) AS documents, true AS whole FROM part
UNION ALL SELECT 'document', count(*), bool_and(true) FROM documents WHERE trim(text) <> ''""")
def h2_corpus_chunks(spark, sf_dir):
    """Documents of either kind that have chunks, and whether these are numbered from 0 without gaps; rows have one each."""
    each = h2_corpus_chunks_all(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk_no").alias("last"), F.count_distinct("chunk_no").alias("distinct"))
    kind = F.when(F.col("doc_id") % 2 == 0, "row").otherwise("document")
    whole = (F.col("n") == F.col("distinct")) & (F.col("last") == F.col("n") - 1) & ((kind == "document") | (F.col("n") == 1))
    return each.groupBy(kind.alias("kind")).agg(F.count("*").alias("documents"), F.bool_and(whole).alias("whole"))


@query("h2_corpus_chunks_all")
def h2_corpus_chunks_all(spark, sf_dir):
    """All chunks of both kinds, rows under even ids and documents under odd ones (checked against plain Python in tests)."""
    rows = corpus.row_text(table(spark, sf_dir, "part")).select((F.col("p_partkey") * 2).alias("doc_id"), "text")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2 + 1).alias("doc_id"), "text")
    return corpus.corpus_chunks(rows, docs)


@query("h6_normalise", "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * 3 FOR x IN embedding]) / sqrt(list_sum([CAST(x AS DOUBLE) * x * 9 FOR x IN embedding])), 5) AS total FROM embeddings")
def h6_normalise(spark, sf_dir):
    vector = retrieval.normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("h7_similarity", "SELECT p_partkey, round(greatest(0, least(1, 1 - pow(p_size / 20.0, 2) / 2)), 6) AS l2, round(greatest(0, least(1, 1 - pow(p_size / 20.0, 4) / 2)), 6) AS squared FROM part")
def h7_similarity(spark, sf_dir):
    d = F.col("p_size") / 20.0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(retrieval.similarity_of(d), 6).alias("l2"), F.round(retrieval.similarity_of(d, "squared_l2"), 6).alias("squared"))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(spark, sf_dir):
    """Queries: every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("id % 50 = 0").withColumnRenamed("id", "query_id")


SCORES = "SELECT q.vec_id AS query_id, e.vec_id AS id, list_dot_product([CAST(x AS DOUBLE) FOR x IN q.embedding], [CAST(x AS DOUBLE) FOR x IN e.embedding]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"
TOP = f"top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({SCORES}) QUALIFY rank <= 8)"
CONTENT = "'label ' || label || ' size ' || (e.vec_id % 3)"
HITS = f"hits AS (SELECT t.query_id, t.id, t.s, t.rank, {CONTENT} AS content FROM top t JOIN embeddings e ON e.vec_id = t.id)"


def hits_of(spark, sf_dir):
    """Nearest chunks with a short content, which repeats."""
    found = retrieval.nearest(vectors(spark, sf_dir), asked(spark, sf_dir))
    content = F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" size "), (F.col("vec_id") % 3).cast("string"))
    return found.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), content.alias("content"), "label"), "id")


@query("h8_nearest", f"WITH {TOP} SELECT query_id, id, round(s, 6) AS similarity, rank FROM top")
def h8_nearest(spark, sf_dir):
    return retrieval.nearest(vectors(spark, sf_dir), asked(spark, sf_dir)).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("h8_nearest_blocks", f"""SELECT query_id, id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({SCORES.removesuffix(" WHERE q.vec_id % 50 = 0")}) QUALIFY rank <= 8""")
def h8_nearest_blocks(spark, sf_dir):
    """Every vector as a query against all, in blocks."""
    every = vectors(spark, sf_dir)
    return retrieval.nearest_blocks(every, every.withColumnRenamed("id", "query_id")).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


KEPT = "kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM (SELECT *, min(rank) OVER (PARTITION BY query_id, content) AS f FROM hits) WHERE f = rank AND s >= 0.2 QUALIFY n <= 5)"


@query("h9_refined", f"WITH {TOP}, {HITS}, {KEPT} SELECT query_id, id, rank FROM kept")
def h9_refined(spark, sf_dir):
    return retrieval.refined(hits_of(spark, sf_dir), threshold=0.2).select("query_id", "id", "rank")


@query("h11_confidence", f"""WITH {TOP}, {HITS}, {KEPT}, b AS (SELECT query_id, avg(s) FILTER (k <= 3) AS c, max(s) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS k FROM kept) GROUP BY 1)
SELECT q.vec_id AS query_id, round(greatest(0, least(1, coalesce(c, 0))), 4) AS confidence, round(coalesce(m, 0), 6) AS max_similarity, coalesce(m >= 0.62, false) AS answerable FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN b ON q.vec_id = b.query_id""")
def h11_confidence(spark, sf_dir):
    out = retrieval.confidences(asked(spark, sf_dir), retrieval.refined(hits_of(spark, sf_dir), threshold=0.2))
    return out.withColumn("max_similarity", F.round("max_similarity", 6))


@query("h12_rerank", f"""WITH {TOP}, {HITS}, sc AS (SELECT *, 0.55 * s + 0.25 * (CASE WHEN contains(content, 'label 3') THEN 1.0 ELSE 0.5 END) + 0.2 * (CASE WHEN ends_with(content, 'size 1') THEN 1.0 ELSE 0.0 END) AS score FROM hits)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS new_rank FROM sc""")
def h12_rerank(spark, sf_dir):
    hits = hits_of(spark, sf_dir).withColumns({"query": F.lit("Label 3?"), "extra": F.array(F.when(F.col("content").endswith("size 1"), "1").otherwise("none"))})
    return retrieval.reranked(hits.withColumn("query", F.lit("label 3"))).select("query_id", "id", F.round("score", 6).alias("score"), "new_rank")


BLOCK = "chr(10) || repeat('=', 30) || chr(10) || 'DOCUMENT ' || rank || chr(10) || repeat('=', 30) || chr(10) || 'Source: s' || (id % 2) || ' | Row: ' || id || chr(10) || 'Similarity: ' || printf('%.4f', s) || chr(10) || chr(10) || 'kind: chunk' || chr(10) || chr(10) || 'Content:' || chr(10) || content || chr(10)"


@query("h13_contexts", f"WITH {TOP}, {HITS} SELECT query_id, string_agg({BLOCK}, chr(10) ORDER BY rank) AS context, count(DISTINCT id % 2) AS sources FROM hits GROUP BY 1")
def h13_contexts(spark, sf_dir):
    of = F.create_map(F.lit("document_name"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")), F.lit("row_number"), F.col("id").cast("string"), F.lit("kind"), F.lit("chunk"))
    return retrieval.contexts(hits_of(spark, sf_dir).withColumn("metadata", of)).select("query_id", "context", F.size("sources").cast("long").alias("sources"))


# Grounding: texts with figures, made of orders


def figures(spark, sf_dir):
    """One text per customer: a line with year, metric and price (too large to be a year) per order."""
    line = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" revenue = "), (F.round("o_totalprice").cast("long") + 10000).cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), line.alias("text"), F.col("o_orderkey").alias("pos"))


FIGURES = "figures AS (SELECT o_custkey AS query_id, strftime(o_orderdate, '%Y') AS year, CAST(round(o_totalprice) AS BIGINT) + 10000 AS value, o_orderkey AS pos FROM orders)"


@query("h14_metric_values", f"WITH {FIGURES} SELECT query_id, 'revenue' AS metric, year, CAST(value AS DOUBLE) AS value FROM figures WHERE value <> CAST(year AS BIGINT)")
def h14_metric_values(spark, sf_dir):
    return grounding.metric_values(figures(spark, sf_dir).withColumn("metric", F.lit("revenue"))).select("query_id", "metric", "year", "value")


@query("h15_facts", f"WITH {FIGURES} SELECT query_id, year, CAST(arg_min(value, pos) AS DOUBLE) AS value, max(value) - min(value) > 1e-6 AS conflict FROM figures WHERE value <> CAST(year AS BIGINT) GROUP BY ALL")
def h15_facts(spark, sf_dir):
    values = grounding.metric_values(joined_figures(spark, sf_dir))
    return grounding.facts(values).select("query_id", "year", "value", "conflict")


def joined_figures(spark, sf_dir):
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return figures(spark, sf_dir).groupBy("query_id").agg(lines.alias("text")).withColumn("metric", F.lit("revenue"))


WANTED = ["1995", "1996"]


def wanted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("revenue").alias("metric"), F.array(*[F.lit(y) for y in WANTED]).alias("years"), (F.col("c_custkey") % 4 > 0).alias("calculation"))


@query("h16_evidence", f"""WITH {FIGURES}, f AS (SELECT query_id, year, max(value) - min(value) > 1e-6 AS conflict FROM figures WHERE value <> CAST(year AS BIGINT) GROUP BY ALL),
p AS (SELECT query_id, bool_or(conflict) AS conflict, count(*) FILTER (year IN ('1995', '1996')) AS found FROM f GROUP BY 1), e AS (SELECT query_id FROM figures GROUP BY 1)
SELECT c_custkey AS query_id, CASE WHEN e.query_id IS NULL THEN 'irrelevant' WHEN c_custkey % 4 = 0 THEN 'relevant' WHEN conflict THEN 'conflicting' WHEN coalesce(found, 0) < 2 THEN 'insufficient' ELSE 'relevant' END AS status,
       CAST(CASE WHEN e.query_id IS NULL THEN 0 WHEN c_custkey % 4 = 0 THEN 1 WHEN conflict THEN 0.4 ELSE coalesce(found, 0) / 2.0 END AS DOUBLE) AS completeness
FROM customer LEFT JOIN e ON e.query_id = c_custkey LEFT JOIN p ON p.query_id = c_custkey""")
def h16_evidence(spark, sf_dir):
    return grounding.evidence_status(wanted(spark, sf_dir), figures(spark, sf_dir)).select("query_id", "status", "completeness")


@query("h17_growth", f"""WITH {FIGURES}, f AS (SELECT query_id, year, CAST(arg_min(value, pos) AS DOUBLE) AS value FROM figures WHERE value <> CAST(year AS BIGINT) GROUP BY ALL HAVING max(value) - min(value) <= 1e-6)
SELECT c_custkey AS query_id, a.value AS old, b.value AS new, round((b.value - a.value) / nullif(a.value, 0) * 100, 6) AS growth FROM customer LEFT JOIN f a ON a.query_id = c_custkey AND a.year = '1995' LEFT JOIN f b ON b.query_id = c_custkey AND b.year = '1996'""")
def h17_growth(spark, sf_dir):
    found = grounding.facts(grounding.metric_values(joined_figures(spark, sf_dir)))
    return grounding.growth(found, wanted(spark, sf_dir)).select("query_id", "old", "new", "growth")


@query("h18_verify_answers", """
SELECT o_orderkey, o_orderkey % 3 <> 1 AS verified FROM orders""")
def h18_verify_answers(spark, sf_dir):
    whole = F.round("o_totalprice").cast("long") + 10000  # too large to be a year
    evidence = F.concat(F.lit("2024 Revenue = "), whole.cast("string"))
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Revenue was "), whole.cast("string"), F.lit(" in 2024."))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Revenue was "), (whole + 3).cast("string"), F.lit(" in 2024."))).otherwise("I couldn't find it, 77 times.")
    return table(spark, sf_dir, "orders").select("o_orderkey", grounding.verified(answer, evidence).alias("verified"))


@query("e5_token_overlap", """
WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS c, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS q FROM part)
SELECT p_partkey, len(list_intersect(c, ['red', 'small', 'economy'])) / CAST(len(c) AS DOUBLE) AS share FROM t""")
def e5_token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.token_overlap(F.lit("Red & small economy"), F.col("p_name")).alias("share"))


@query("e9_years_and_numbers", f"WITH {FIGURES}, y AS (SELECT query_id, list(year ORDER BY pos) AS all_years, list(CAST(value AS DOUBLE) ORDER BY pos) AS v FROM figures GROUP BY 1) SELECT query_id, len(list_distinct(all_years)) AS years, len(all_years) * 2 AS numbers, list_sum(v) AS total FROM y")
def e9_years_and_numbers(spark, sf_dir):
    rows = joined_figures(spark, sf_dir)
    numbers = S.numbers_of(F.col("text"))
    every_other = F.filter(numbers, lambda x, i: i % 2 == 1)
    return rows.select("query_id", F.size(S.years_of(F.col("text"))).cast("long").alias("years"), F.size(numbers).cast("long").alias("numbers"), F.aggregate(every_other, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("e10_period_options", f"""WITH {FIGURES}, y AS (SELECT query_id, list_sort(list_distinct(list(year))) AS y FROM figures GROUP BY 1)
SELECT query_id, array_to_string([y[i] || '-' || y[i + 1] FOR i IN range(1, len(y))], ',') AS options FROM y""")
def e10_period_options(spark, sf_dir):
    return joined_figures(spark, sf_dir).select("query_id", F.array_join(S.period_options(S.years_of(F.col("text"))), ",").alias("options"))


@query("e22_confidence", "SELECT p_partkey, round(least(1.0, 0.35 * (p_size / 50.0) + 0.35 * (p_size / 25.0) + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END + 0.15), 6) AS confidence FROM part")
def e22_confidence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.confidence_blend(F.col("p_size") / 50.0, F.col("p_size") / 25.0, F.col("p_size") % 2 == 0), 6).alias("confidence"))



@query("h3_kept_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) SELECT doc_id, count(*) FILTER (pos % 5 <> 3 AND length(trim(line)) >= 2) AS kept FROM l GROUP BY 1 HAVING kept > 0")
def h3_kept_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = lines.withColumn("line", F.when(F.col("pos") % 5 == 3, "#/texts/4").otherwise(F.col("line")))
    return corpus.kept_lines(marked).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("h10_threshold", f"WITH {TOP}, {HITS}, {KEPT.replace('s >= 0.2', 's >= 0.58')} SELECT query_id, count(*) AS n FROM kept GROUP BY 1")
def h10_threshold(spark, sf_dir):
    return retrieval.refined(hits_of(spark, sf_dir)).groupBy("query_id").agg(F.count("*").alias("n"))


__all__ = ["QUERIES", "SQL", "questions"]
