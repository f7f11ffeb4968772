"""DED, FLT, JON and SET queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evloom import functions as fn
from evloom.operators import identity, ranking, text
from evloom.plans.base import HITS_SQL, LINKS_SQL, hits, links, query, ranked, table, RANKED_SQL

NORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
KEYED = f"keyed as (select *, coalesce('doi:' || nullif(doi, ''), 'arxiv:' || nullif(arxiv_id, ''), 's2:' || nullif(s2_id, ''), 'openalex:' || nullif(openalex_id, ''), 'title:' || sha256({NORM.format('title')})) as key from hits)"


@query(f"select doc_id, {NORM.format('text')} as title_norm, sha256({NORM.format('text')}) as title_hash from documents")
def DED01_02_title_hash(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    return t.select("doc_id", fn.normalise_title("t").alias("title_norm"), fn.title_hash("t").alias("title_hash"))


@query(f"with {HITS_SQL} select id, nullif(doi, '') as doi, nullif(arxiv_id, '') as arxiv_id, nullif(s2_id, '') as s2_id, nullif(openalex_id, '') as openalex_id, source as sources from hits")
def DED03_normalised_projection(spark, d):
    return identity.normalise_hits(hits(spark, d)).select("id", "doi", "arxiv_id", "s2_id", "openalex_id", F.array_join("sources", ",").alias("sources"))


def _first(c, blank=True):
    v = f"nullif({c}, '')" if blank else c
    return f"arg_min({v}, pos) filter ({v} is not null) as {c}"


@query(f"with {HITS_SQL}, {KEYED} select key, min(pos) as pos, arg_min(title, pos) as title, {_first('abstract')}, {_first('venue')}, {_first('doi')}, {_first('arxiv_id')}, {_first('s2_id')}, {_first('openalex_id')}, {_first('year', False)}, max(citation_count) as citation_count, array_to_string(list_sort(list(distinct source)), ',') as sources from keyed group by key")
def DED04_batch_dedup(spark, d):
    return identity.dedup_batch(hits(spark, d)).withColumn("sources", F.array_join("sources", ","))


_LOOK = f"""with {HITS_SQL}, store as (select * from hits where id % 2 = 0), rows_in as (select * from hits where id % 2 = 1),
matched as (select r.*, coalesce((select min(s.id) from store s where s.doi = nullif(r.doi, '')), (select min(s.id) from store s where s.arxiv_id = nullif(r.arxiv_id, '')), (select min(s.id) from store s where s.s2_id = nullif(r.s2_id, '')), (select min(s.id) from store s where s.openalex_id = nullif(r.openalex_id, '')), (select min(s.id) from store s where {NORM.format('s.title')} = {NORM.format('r.title')})) as match from rows_in r)"""


@query(_LOOK + " select id, match from matched")
def DED05_lookup_any_id(spark, d):
    h = hits(spark, d)
    return identity.lookup(h.where("id % 2 = 1"), h.where("id % 2 = 0"), "id", "id")


@query(_LOOK + """, both_sides as (select coalesce(match, id) as item, match is null as new, 1 as late, pos, source, citation_count, abstract, doi, title from matched union all select id, false, 0, pos, source, citation_count, abstract, doi, title from store)
select item, arg_min(title, late * 1000000000 + pos) as title, arg_min(nullif(abstract, ''), late * 1000000000 + pos) filter (nullif(abstract, '') is not null) as abstract, arg_min(nullif(doi, ''), late * 1000000000 + pos) filter (nullif(doi, '') is not null) as doi, max(citation_count) as citation_count, array_to_string(list_sort(list(distinct source)), ',') as sources, bool_and(new) as is_new from both_sides group by item""")
def DED06_upsert(spark, d):
    h = hits(spark, d)
    out = identity.upsert(h.where("id % 2 = 1"), h.where("id % 2 = 0"))
    return out.select("item", "title", "abstract", "doi", "citation_count", F.array_join("sources", ",").alias("sources"), "is_new")


@query(f"with {LINKS_SQL} select question_id, paper_id, min(round) as discovered_round from links group by all")
def DED07_link_upsert(spark, d):
    return links(spark, d).groupBy("question_id", "paper_id").agg(F.min("round").alias("discovered_round"))


@query(f"with {RANKED_SQL}, known as (select distinct query_id, item, source from ranked where family = '1-URGENT') select query_id, item, source, min(rank) as rank from ranked r where not exists (select 1 from known k where k.query_id = r.query_id and k.item = r.item and k.source = r.source) group by all")
def DED08_triple_dedup(spark, d):
    r = ranked(spark, d)
    new = r.join(r.where("family = '1-URGENT'").select("query_id", "item", "source").distinct(), ["query_id", "item", "source"], "left_anti")
    return new.groupBy("query_id", "item", "source").agg(F.min("rank").alias("rank"))


@query("select l_suppkey as a, l_partkey as b, l_returnflag as relation, arg_max(l_quantity, l_orderkey::double * 1e6 + l_linenumber * 1000 + l_quantity) as weight from lineitem group by all")
def DED09_edge_upsert(spark, d):
    t = table(spark, d, "lineitem")
    seq = F.col("l_orderkey").cast("double") * 1e6 + F.col("l_linenumber") * 1000 + F.col("l_quantity")
    return t.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_returnflag").alias("relation")).agg(F.max_by("l_quantity", seq).alias("weight"))


@query("select trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) as q, source, count(*) as n, min(doc_id) as first_id from documents group by all")
def DED10_query_save(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", fn.normalise_query("text").alias("q"))
    return t.groupBy("q", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("with w as (select doc_id, unnest(string_split(text, ' ')) as x, generate_subscripts(string_split(text, ' '), 1) as i from documents), f as (select doc_id, lower(x) as k, min(i) as i, arg_min(x, i) as x from w group by doc_id, lower(x)) select doc_id, array_to_string(list(x order by i), '|') as kept from f group by doc_id")
def DED11_12_ordered_distinct(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", identity.first_spellings(F.transform(F.split("text", " "), lambda x, i: F.struct(i.alias("i"), x.alias("x")))).alias("l"))
    # A text's words stay in its row; rows of the same id meet with what is left of theirs.
    return t.groupBy("doc_id").agg(F.flatten(F.collect_list("l")).alias("l")).select("doc_id", F.array_join(F.transform(identity.first_spellings(F.col("l")), lambda m: m["x"]), "|").alias("kept"))


@query("with h as (select d.doc_id, source, sha256(text) as hash, l.doc_id is not null as stored from documents d left join labels l on d.doc_id = l.doc_id), f as (select source, hash, min(doc_id) as doc_id from h where not stored group by all) select f.* from f where not exists (select 1 from h where stored and h.source = f.source and h.hash = f.hash)")
def DED13_chunk_hash(spark, d):
    """Labelled documents stand for the stored chunks, the others for the new ones."""
    h = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    stored = table(spark, d, "labels").select("doc_id")
    new = h.join(stored, "doc_id", "left_anti").groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"))
    return new.join(h.join(stored, "doc_id", "left_semi").select("source", "hash"), ["source", "hash"], "left_anti").select("source", "hash", "doc_id")


@query(None)
def DED14_semantic_greedy(spark, d):
    """The vectors of one label stand for the accepted ones, all others for the batch."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return identity.greedy_semantic(e.where("label is distinct from 1"), e.where("label = 1"), 0.5)


@query("select doc_id, text as t, text || case when row_number() over (partition by text order by doc_id) > 1 then ' (' || source || ')' else '' end as title from documents")
def DED15_title_suffix(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("t"))
    n = F.row_number().over(Window.partitionBy("t").orderBy("doc_id"))
    return t.select("doc_id", "t", F.concat("t", F.when(n > 1, F.concat(F.lit(" ("), "source", F.lit(")"))).otherwise("")).alias("title"))


@query(f"with {HITS_SQL} select id, coalesce(nullif(s2_id, ''), nullif(openalex_id, ''), nullif(arxiv_id, ''), nullif(doi, '')) as external_id from hits")
def DED16_external_id(spark, d):
    return hits(spark, d).select("id", fn.external_id().alias("external_id"))


# Filters -------------------------------------------------------------------------------------


@query("select p_partkey, p_size, nullif(p_size % 7, 0) as status from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#23') and p_size <= 30 and nullif(p_size % 7, 0) not in (1, 2)")
def FLT01_basic_filters(spark, d):
    t = table(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & (F.col("p_size") <= 30)).withColumn("status", F.expr("nullif(p_size % 7, 0)"))
    return t.where(~F.col("status").isin(1, 2)).select("p_partkey", "p_size", "status")


@query("select p_partkey, p_brand from part where p_brand = 'Brand#11' order by p_partkey limit 20 offset 20")
def FLT02_optional_paging(spark, d):
    t = table(spark, d, "part")
    for col, value in {"p_brand": "Brand#11", "p_type": None}.items():
        t = t if value is None else t.where(F.col(col) == value)
    return t.select("p_partkey", "p_brand").orderBy("p_partkey").offset(20).limit(20)


_COS = "list_cosine_similarity({0}::double[], {1}::double[])"


@query(f"with t as (select embedding as q from embeddings where vec_id = 0) select vec_id, round({_COS.format('embedding', 'q')}, 6) as sim from embeddings, t where {_COS.format('embedding', 'q')} >= case when label % 2 = 0 then 0.05 else greatest(0.05, 0.15) end")
def FLT03_similarity_prefilter(spark, d):
    e = table(spark, d, "embeddings")
    topic = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    limit = F.when(F.col("label") % 2 == 0, 0.05).otherwise(0.15)
    return e.crossJoin(F.broadcast(topic)).withColumn("s", fn.cosine("embedding", "q")).where(F.col("s") >= limit).select("vec_id", F.round("s", 6).alias("sim"))


@query(f"with {LINKS_SQL} select question_id, coalesce(nullif(relevance, 0.3), 0) < 0.5 as weak, relation_type in ('supports', 'partially_answers') as supporting, relation_type = 'contradicts' as contradicting, count(*) as n from links group by all")
def FLT04_05_relations(spark, d):
    l = links(spark, d)
    return l.groupBy("question_id", fn.is_weak(F.nullif("relevance", F.lit(0.3))).alias("weak"), F.col("relation_type").isin(*fn.SUPPORTING).alias("supporting"), F.col("relation_type").isin(*fn.CONTRADICTING).alias("contradicting")).agg(F.count("*").alias("n"))


@query("select doc_id, quality = 1 and nullif(text, '') is not null and n_chars > 0 and coalesce(toxic, 0) = 0 as locatable from documents join labels using (doc_id)")
def FLT06_locatable(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return t.select("doc_id", ((F.col("quality") == 1) & fn.blank_to_null("text").isNotNull() & (F.col("n_chars") > 0) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("locatable"))


@query("select doc_id, length(text) as n from documents where length(text) > 50 and n_chars >= greatest(50, 200)")
def FLT08_min_length(spark, d):
    return table(spark, d, "documents").where((F.length("text") > 50) & (F.col("n_chars") >= 200)).select("doc_id", F.length("text").alias("n"))


@query("with c as (select distinct l_orderkey as k, l_partkey as p from lineitem) select k, coalesce(array_to_string(list_sort(list(p) filter (p in (select p_partkey from part where p_size > 25))), ','), '') as kept, count(*) as n from c group by k")
def FLT09_offered_ids(spark, d):
    cited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    offered = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("p"), F.lit(True).alias("ok"))
    both = cited.join(offered, "p", "left")
    return both.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("p")))).cast("array<string>"), ",").alias("kept"), F.count("*").alias("n"))


@query("select doc_id, regexp_matches(text, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)') as short_name, contains(text, 'tion') as long_name from documents")
def FLT10_known_names(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    return t.select("doc_id", F.col("t").rlike("(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)").alias("short_name"), F.col("t").contains("tion").alias("long_name"))


@query("select event_id, case when event_type in ('click', 'view') then event_type else 'method' end as kind from events")
def FLT12_enum_coercion(spark, d):
    return table(spark, d, "events").select("event_id", fn.coerce("event_type", ("click", "view"), "method").alias("kind"))


# Joins ---------------------------------------------------------------------------------------


@query("select p_partkey, p_name, l_orderkey, l_linenumber, l_quantity from part join lineitem on p_partkey = l_partkey where p_size > 40")
def JON01_inner(spark, d):
    p = table(spark, d, "part").where("p_size > 40").select("p_partkey", "p_name")
    return p.join(table(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "l_orderkey", "l_linenumber", "l_quantity")


@query(f"with {LINKS_SQL} select question_id, m as round, count(*) as n, sum(case when relation_type = 'contradicts' then 1 else 0 end)::bigint as contra from links join (select question_id as q, max(round) as m from links group by 1) on question_id = q and round = m group by all")
def JON02_latest_per_question(spark, d):
    by = links(spark, d).groupBy("question_id", "round").agg(F.count("*").alias("n"), F.count_if(F.col("relation_type") == "contradicts").alias("contra"))
    return by.groupBy("question_id").agg(F.max("round").alias("round"), F.max_by("n", "round").alias("n"), F.max_by("contra", "round").alias("contra"))


@query("select d.doc_id, coalesce(quality, 0) as quality from documents d left join labels l on d.doc_id = l.doc_id")
def JON03_left_default(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"))


@query("select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def JON04_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def JON05_anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query(f"with {HITS_SQL}, refs as (select id as src, unnest(range(1, 4)) as k from hits), keyed as (select src, concat('s', (src + k * 7) % 100) as s2, {NORM.format('(select h.title from hits h where h.id = (src + k) % 100)')} as t from refs) select src, coalesce((select min(id) from hits where s2_id = s2), (select min(id) from hits where {NORM.format('title')} = t)) as target from keyed where coalesce((select min(id) from hits where s2_id = s2), (select min(id) from hits where {NORM.format('title')} = t)) <> src")
def JON06_fallback_join(spark, d):
    h = hits(spark, d).withColumn("t", fn.normalise_title("title"))
    refs = h.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    refs = refs.withColumn("s2", F.expr("concat('s', (src + k * 7) % 100)")).withColumn("other", F.expr("(src + k) % 100"))
    refs = refs.join(h.select(F.col("id").alias("other"), "t"), "other", "left")
    by_s2 = h.where("s2_id is not null").groupBy(F.col("s2_id").alias("s2")).agg(F.min("id").alias("a"))
    by_t = h.groupBy("t").agg(F.min("id").alias("b"))
    out = refs.join(by_s2, "s2", "left").join(by_t, "t", "left").select("src", F.coalesce("a", "b").alias("target"))
    return out.where("target <> src")


@query("with k as (select doc_id, sha256(doc_id::varchar) as id from documents), p as (select left(sha256((doc_id * 2)::varchar), 8) as prefix from documents) select distinct k.doc_id from k join p on left(k.id, 8) = p.prefix")
def JON07_prefix_join(spark, d):
    t = table(spark, d, "documents")
    k = t.select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("id"))
    p = t.select(F.substring(F.sha2((F.col("doc_id") * 2).cast("string"), 256), 1, 8).alias("prefix"))
    return k.join(p, F.substring("id", 1, 8) == F.col("prefix")).select("doc_id").distinct()


@query("select item_id, doc_id, position(b.text in d.text) - 1 as span_start from benchmark b join documents d on contains(d.text, b.text)")
def JON08_09_span_location(spark, d):
    return text.locate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query("with s as (select doc_id, text, substr(text, 2) || case when doc_id % 2 = 0 then 'zz' else '' end as span from documents), l as (select doc_id, position(span in text) as e, position(left(span, 30) in text) as f, length(span) as n from s) select doc_id, case when e > 0 then e - 1 when f > 0 then f - 1 end as span_start, case when e > 0 or f > 0 then (case when e > 0 then e else f end) - 1 + n end as span_end, case when e > 0 then 'exact' when f > 0 then 'anchored' end as quality from l")
def JON09_10_anchored_span(spark, d):
    s = table(spark, d, "documents").selectExpr("doc_id", "text", "concat(substr(text, 2), case when doc_id % 2 = 0 then 'zz' else '' end) as span")
    s = s.selectExpr("doc_id", "nullif(locate(span, text), 0) as e", "nullif(locate(left(span, 30), text), 0) as f", "length(span) as n")
    at = F.coalesce("e", "f") - 1
    return s.select("doc_id", at.alias("span_start"), (at + F.col("n")).alias("span_end"), F.when(F.col("e").isNotNull(), "exact").when(F.col("f").isNotNull(), "anchored").alias("quality"))


@query("select a.query_id as a, b.query_id as b, a.family from (select distinct l_orderkey as query_id, o_orderpriority as family, o_custkey as c from lineitem join orders on l_orderkey = o_orderkey) a join (select distinct l_orderkey as query_id, o_orderpriority as family, o_custkey as c from lineitem join orders on l_orderkey = o_orderkey) b on a.family = b.family and a.c = b.c and a.query_id < b.query_id")
def JON12_family_pairs(spark, d):
    q = ranked(spark, d).select("query_id", "family", "candidate").distinct()
    return q.alias("x").join(q.alias("y"), ["family", "candidate"]).where("x.query_id < y.query_id").select(F.col("x.query_id").alias("a"), F.col("y.query_id").alias("b"), "family")


@query("select l_suppkey as node, count(distinct l_partkey) as cites, count(*) as edges, round(sum(l_quantity), 2) as weight from lineitem group by 1")
def JON14_neighbourhood(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.countDistinct("l_partkey").alias("cites"), F.count("*").alias("edges"), F.round(F.sum("l_quantity"), 2).alias("weight"))


@query("select conv_id, array_to_string(list(role || ':' || length(text) order by turn), '|') as turns from conversations group by conv_id")
def JON16_parent_children(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return t.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string"))), "|").alias("turns"))


# Sets ----------------------------------------------------------------------------------------

_A, _B = "select distinct l_suppkey as k, l_partkey as item from lineitem where l_returnflag = 'A'", "select distinct l_suppkey as k, l_partkey as item from lineitem where l_returnflag = 'R'"


def _ab(spark, d):
    t = table(spark, d, "lineitem")
    return [t.where(F.col("l_returnflag") == x).select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item")).distinct() for x in "AR"]


@query(f"({_A}) union ({_B})")
def SET01_union(spark, d):
    t = table(spark, d, "lineitem")
    a, b = (t.where(F.col("l_returnflag") == x).select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("item")) for x in "AR")
    return a.union(b).distinct()


@query(f"({_A}) except ({_B})")
def SET02_difference(spark, d):
    a, b = _ab(spark, d)
    return a.subtract(b)


@query(f"({_A}) intersect ({_B})")
def SET03_intersection(spark, d):
    a, b = _ab(spark, d)
    return a.intersect(b)


_SETS = "select l_orderkey as k, list_sort(list(distinct l_partkey) filter (l_returnflag = 'A')) as a, list_sort(list(distinct l_partkey) filter (l_returnflag = 'R')) as b from lineitem group by 1"


@query(f"select k, coalesce(a, []) = coalesce(b, []) as same, len(list_filter(coalesce(a, []), lambda x: not list_contains(coalesce(b, []), x))) = 0 as subset, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') as merged from ({_SETS})")
def SET04_05_07_compare(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(*[F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == x, F.col("l_partkey")))).alias(n) for x, n in (("A", "a"), ("R", "b"))])
    return s.select("k", (F.col("a") == F.col("b")).alias("same"), (F.size(F.array_except("a", "b")) == 0).alias("subset"), F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("merged"))


@query("select doc_id as id, source, 'd' as kind from documents union all select page_id, url, 'p' from pages")
def SET06_union_all(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lit("d").alias("kind"))
    return a.unionByName(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("source"), F.lit("p").alias("kind")))
