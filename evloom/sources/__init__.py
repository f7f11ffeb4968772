"""Adapters of literature sources: raw payload columns to the common hit columns, and replace-by-key sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.functions import blank_to_null, strip_prefix

HIT = ("title", "abstract", "year", "venue", "doi", "external_id", "citation_count", "pdf_url")


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.withColumn("j", F.from_json("payload", schema))


def semantic_scholar(raw: DataFrame) -> DataFrame:
    j = _json(raw, "paperId string, title string, abstract string, year int, venue string, citationCount int, externalIds struct<DOI:string,ArXiv:string>, openAccessPdf struct<url:string>, references array<struct<paperId:string,title:string>>")
    return j.select("id", "j.title", "j.abstract", "j.year", "j.venue", F.col("j.externalIds.DOI").alias("doi"), F.col("j.paperId").alias("external_id"), F.col("j.citationCount").alias("citation_count"), F.col("j.openAccessPdf.url").alias("pdf_url"), F.slice("j.references", 1, 50).alias("references"))


def arxiv(raw: DataFrame) -> DataFrame:
    """Atom entries; the id is the last part of the address, the year the first four characters of the date, line feeds become spaces."""
    x = raw.withColumn("j", F.from_xml("payload", F.lit("id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_title:string,_type:string>>")))
    line = lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    key = F.substring_index(F.coalesce("j.id", F.lit("")), "/", -1)
    href = lambda test: F.get(F.transform(F.filter("j.link", test), lambda l: l["_href"]), F.lit(0))
    page = href(lambda l: (l["_type"] == "text/html") & ~F.coalesce(l["_title"] == "pdf", F.lit(False)))
    return x.select(
        "id", line(F.col("j.title")).alias("title"), line(F.col("j.summary")).alias("abstract"), F.expr("try_cast(substring(j.published, 1, 4) as int)").alias("year"), F.lit("arXiv").alias("venue"), key.alias("external_id"), F.lit(0).alias("citation_count"),
        F.coalesce(href(lambda l: l["_title"] == "pdf"), F.lit("")).alias("pdf_url"), F.coalesce(blank_to_null(page), F.concat(F.lit("https://arxiv.org/abs/"), key)).alias("url"), F.filter(F.transform("j.author", lambda a: F.trim(a["name"])), lambda a: a != "").alias("authors"),
    )


def openalex(raw: DataFrame) -> DataFrame:
    """The abstract is an index from words to places: places are laid out and joined by spaces."""
    j = _json(raw, "id string, title string, publication_year int, doi string, cited_by_count int, abstract_inverted_index map<string,array<int>>")
    words = F.flatten(F.transform(F.map_entries("j.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return j.select(F.col("id").alias("id"), "j.title", F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " ").alias("abstract"), F.col("j.publication_year").alias("year"), strip_prefix("j.doi", "https://doi\\.org/").alias("doi"), strip_prefix("j.id", "https://openalex\\.org/").alias("external_id"), F.col("j.cited_by_count").alias("citation_count"))


def crossref(raw: DataFrame) -> DataFrame:
    """The first title and venue; tags are taken out of the abstract; the year is the first part of the first date."""
    j = _json(raw, "DOI string, URL string, title array<string>, `container-title` array<string>, abstract string, author array<struct<given:string,family:string>>, published struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` int")
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    names = F.filter(F.transform("j.author", lambda a: F.concat_ws(" ", blank_to_null(a["given"]), blank_to_null(a["family"]))), lambda a: a != "")
    return j.select(
        "id", first("j.title").alias("title"), F.trim(F.regexp_replace(F.coalesce("j.abstract", F.lit("")), "<[^>]+>", "")).alias("abstract"), F.get(F.get("j.published.date-parts", F.lit(0)), F.lit(0)).alias("year"), first("j.container-title").alias("venue"),
        F.coalesce("j.DOI", F.lit("")).alias("doi"), F.coalesce("j.URL", F.lit("")).alias("url"), F.coalesce("j.is-referenced-by-count", F.lit(0)).alias("citation_count"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
    )


def core(raw: DataFrame) -> DataFrame:
    """The DOI is the first identifier that names one, whether a string or an object; a year that is no number is null."""
    j = _json(raw, "id string, title string, abstract string, publisher string, year_published string, download_url string, source_fulltext_urls array<string>, identifiers array<string>")
    told = F.transform("j.identifiers", lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(blank_to_null(F.get_json_object(x, "$.identifier")), F.get_json_object(x, "$.id"), F.lit(""))).otherwise(x))
    doi = F.get(F.filter(told, lambda x: F.contains(F.lower(x), F.lit("doi"))), F.lit(0))
    pdf = F.coalesce(blank_to_null("j.download_url"), F.get("j.source_fulltext_urls", F.lit(0)), F.lit(""))
    return j.select(
        "id", F.coalesce("j.title", F.lit("")).alias("title"), F.coalesce("j.abstract", F.lit("")).alias("abstract"), F.expr("nullif(try_cast(j.year_published as int), 0)").alias("year"), F.coalesce("j.publisher", F.lit("")).alias("venue"),
        F.coalesce(F.trim(F.regexp_replace(doi, "doi:|DOI:", "")), F.lit("")).alias("doi"), F.col("j.id").alias("external_id"), F.lit(0).alias("citation_count"), pdf.alias("pdf_url"), F.coalesce(blank_to_null(pdf), "j.id").alias("url"),
    )


def ieee(raw: DataFrame) -> DataFrame:
    j = _json(raw, "article_number string, title string, abstract string, publication_year int, doi string, citing_paper_count int")
    return j.select("id", "j.title", "j.abstract", F.col("j.publication_year").alias("year"), "j.doi", F.col("j.article_number").alias("external_id"), F.col("j.citing_paper_count").alias("citation_count"))


#: Sources that answer only with a key.
KEYED = ("ieee", "core")


def available(sources: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """The sources that need no key or have one; the others are not even read."""
    return {name: df for name, df in sources.items() if name not in KEYED or keys.get(name)}


def search(queries: DataFrame, sources: dict[str, DataFrame], limit: int = 15) -> DataFrame:
    """Hits of all queries(query_id) from all sources (each query_id, rank and hit columns), the first `limit` a query and source, with the source's name."""
    parts = []
    for name, hits in sources.items():
        found = hits.join(queries.select("query_id").distinct(), "query_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        parts.append(found.where(F.col("_n") <= limit).drop("_n").withColumn("source", F.lit(name)))
    return fan_out(parts)


def fan_out(parts: list[DataFrame]) -> DataFrame:
    """Hits of all sources in one table; a source that lacks a column has nulls there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fill_pdf(items: DataFrame, locations: DataFrame) -> DataFrame:
    """pdf_url stays where it is; else the best location by DOI, else the first."""
    return items.join(locations.select("doi", "best", "first"), "doi", "left").select(*items.columns, F.coalesce(blank_to_null("pdf_url"), "best", "first").alias("pdf"))


def enrich(items: DataFrame, *sources: DataFrame) -> DataFrame:
    """Rows that lack citations, venue or year are filled from the sources in turn; citations only upwards."""
    out = items
    for k, s in enumerate(sources):
        out = out.join(s.select("id", *[F.col(c).alias(f"_{c}{k}") for c in ("citation_count", "venue", "year")]), "id", "left")
    lacks = (F.coalesce("citation_count", F.lit(0)) == 0) | blank_to_null("venue").isNull() | F.col("year").isNull()
    cols = {"citation_count": F.greatest("citation_count", *[f"_citation_count{k}" for k in range(len(sources))], F.lit(0)), "venue": F.coalesce(blank_to_null("venue"), *[blank_to_null(f"_venue{k}") for k in range(len(sources))]), "year": F.coalesce("year", *[f"_year{k}" for k in range(len(sources))])}
    return out.withColumns({k: F.when(lacks, v).otherwise(F.col(k)) for k, v in cols.items()}).select(*items.columns)


def reconcile(items: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Counts of ids in both stores, in one and in the other."""
    a, b = items.select(key).distinct().withColumn("a", F.lit(True)), vectors.select(key).distinct().withColumn("b", F.lit(True))
    status = F.when(F.col("a") & F.col("b"), "full").when(F.col("a"), "vector_missing").otherwise("item_missing")
    return a.join(b, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: all rows of the keys that come anew are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def pdf_cascade(items: DataFrame, cache: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """id, via, url: the first place that offers a text, in a fixed order.

    cache(id, path); lookups named s2, openalex, unpaywall and crossref are tables (key, url), one row a key. Fetching is outside.
    """
    keys = {"s2": "s2_id", "openalex": "openalex_id", "unpaywall": "doi", "crossref": "doi"}
    out = items.join(cache.select("id", F.col("path").alias("_cache")), "id", "left")
    for name, key in keys.items():
        found = lookups[name].select(F.col("key").alias(f"_k{name}"), F.col("url").alias(f"_{name}"))
        out = out.join(found, blank_to_null(key) == F.col(f"_k{name}"), "left")
    arxiv_url = lambda c: F.concat(F.lit("https://arxiv.org/pdf/"), blank_to_null(c))
    from_doi = F.regexp_extract("doi", r"^10\.48550/(?i:arxiv)\.([\d.]+)", 1)
    acl = F.concat(F.lit("https://aclanthology.org/"), blank_to_null(F.regexp_extract("doi", r"^10\.18653/v1/(.+)$", 1)), F.lit(".pdf"))
    ways = {"cache": F.col("_cache"), "pdf_url": blank_to_null("pdf_url"), "arxiv": arxiv_url("arxiv_id"), "arxiv_doi": arxiv_url(from_doi), **{n: F.col(f"_{n}") for n in keys}, "acl": acl}
    first = F.coalesce(*[F.when(u.isNotNull(), F.struct(F.lit(n).alias("via"), u.alias("url"))) for n, u in ways.items()])
    return out.select("id", first.alias("x")).select("id", "x.via", "x.url")


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a marked Markdown table; null with fewer than two rows. Null cells are empty."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---"))
    lines = F.concat(F.array(line(F.get(rows, F.lit(0))), line(rule)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(F.size(rows) >= 2, F.concat(F.lit("\n[TABLE]\n"), F.array_join(lines, "\n"), F.lit("\n[/TABLE]\n")))


def overlaps_image(box: Column, images: Column) -> Column:
    """Whether more than half of a box (x0, y0, x1, y1) lies in one of the images; a box without area lies in none."""
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    side = lambda i, a, b: F.greatest(F.least(box[b], i[b]) - F.greatest(box[a], i[a]), F.lit(0))
    return (area > 0) & F.exists(images, lambda i: side(i, "x0", "x1") * side(i, "y0", "y1") > 0.5 * area)


def drop_drifted(vectors: DataFrame, collections: DataFrame, current: str) -> DataFrame:
    """vectors(collection, ...) without those of collections(collection, signature) made by another embedding; no signature counts as current."""
    stale = collections.where(F.col("signature") != current).select("collection")
    return vectors.join(stale, "collection", "left_anti")


TRACE = "step string, type string, round int, input string, output string, tokens long, ms long"


def append_traces(traces: DataFrame, path: str) -> None:
    """Appends to the trace table; input and output become JSON."""
    traces.select("step", "type", F.col("round").cast("int"), F.to_json("input").alias("input"), F.to_json("output").alias("output"), F.col("tokens").cast("long"), F.col("ms").cast("long")).write.mode("append").parquet(path)


def read_traces(spark, path: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(path)
