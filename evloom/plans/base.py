"""Stand-ins for the domain tables on the driver's tables, in Spark and as SQL, and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from evloom.operators.ranking import ordinal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: documents as raw hits of several sources. The expressions are both Spark's and DuckDB's.
HITS = [
    "doc_id as pos", "doc_id as id", "source", "text as title", "case when doc_id % 4 = 0 then '' else text end as abstract",
    "case when doc_id % 3 = 0 then concat('d', doc_id % 200) when doc_id % 3 = 1 then '' end as doi", "case when doc_id % 5 < 2 then concat('a', doc_id % 150) end as arxiv_id",
    "case when doc_id % 7 = 0 then concat('s', doc_id % 100) end as s2_id", "case when doc_id % 11 = 0 then concat('o', doc_id % 50) end as openalex_id",
    "n_chars % 500 as citation_count", "case when doc_id % 6 = 0 then null else 2000 + doc_id % 25 end as year", "case when doc_id % 5 = 0 then '' else upper(concat('venue', doc_id % 9)) end as venue",
]
HITS_SQL = f"hits as (select {', '.join(HITS)} from documents)"
#: lineitem as links of questions (suppliers) to evidence from papers (parts).
LINKS = [
    "l_suppkey as question_id", "l_partkey as paper_id", "l_orderkey as evidence_id", "case l_returnflag when 'A' then 'supports' when 'R' then 'contradicts' else 'partially_answers' end as relation_type",
    "round(abs(l_discount) * 10, 1) as relevance", "l_linenumber as round", "case l_linenumber % 4 when 0 then 'limitation' when 1 then 'negative_result' when 2 then 'method' else 'result' end as evidence_type",
    "l_linestatus = 'F' as fulltext", "round(abs(l_tax) * 10, 1) as confidence", "l_quantity as quantity",
]
LINKS_SQL = f"links as (select {', '.join(LINKS)} from lineitem)"
RANK_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
RANKED_SQL = f"ranked as (select l_orderkey as query_id, l_partkey as item, l_returnflag as source, o_orderpriority as family, o_custkey as candidate, row_number() over (partition by l_orderkey order by {', '.join(RANK_ORDER)}) - 1 as rank from lineitem join orders on l_orderkey = o_orderkey)"
#: part as scored items.
SCORES = [
    "p_partkey as paper_id", "p_size % 7 as batch", "(p_partkey % 101) / 100.0D as relevance", "(p_partkey % 89) / 88.0D as authority", "(p_partkey % 73) / 72.0D as recency", "(p_partkey % 61) / 60.0D as novelty", "(p_partkey % 53) / 52.0D as idea_potential",
    "cast(p_partkey % 150 as bigint) as citation_count", "case when p_size % 5 = 0 then null else 2000 + p_size % 26 end as year", "p_brand = 'Brand#11' as top_venue",
]
SCORES_SQL = f"scores as (select {', '.join(SCORES).replace('.0D', '.0::double')} from part)"


def hits(spark, d):
    return table(spark, d, "documents").selectExpr(*HITS)


def links(spark, d):
    return table(spark, d, "lineitem").selectExpr(*LINKS)


def ranked(spark, d):
    """lineitem as ranked results: a query is an order, its family the order's priority, its candidate the customer."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    items = items.withColumn("rank", ordinal(["l_orderkey"], *RANK_ORDER))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("source"), F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("candidate"), "rank"
    )


def scores(spark, d):
    return table(spark, d, "part").selectExpr(*SCORES)
