"""WIK, RPT, GRF and SRC queries over whole tables: pages, reports, communities and document sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evloom import sources
from evloom.functions import identity_key
from evloom.operators import graph, pages, ranking
from evloom.operators.shared import shared_folder
from evloom.plans.base import HITS_SQL, hits, query, table
from evloom.plans.q_identity import KEYED

# Pages ----------------------------------------------------------------------------------------

#: documents as pages: the language stands for the page type. The expressions are both Spark's and DuckDB's.
_TYPE = "case lang when 'en' then 'concept' when 'fr' then 'synthesis' when 'de' then 'method' when 'es' then 'dataset' else 'model' end"
_TITLE = "concat(lpad(cast(n_chars as varchar(20)), 6, '0'), '-', lpad(cast(doc_id as varchar(20)), 12, '0'))"


def _pages(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "source", f"{_TYPE} as type", f"{_TITLE} as title", "text as content")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_MERGE = f"""with old as (select doc_id::varchar as title, '# Text' || chr(10) || text as content, source, lang from documents),
acts as (select turn as seq, conv_id::varchar as title, '# Text' || chr(10) || text || chr(10) || '## ' || role || chr(10) || text as content, role from conversations),
texts as (select title, -1 as seq, content as t from old where title in (select title from acts) union all select title, seq, {_STRIP.format("content")} from acts),
l as (select title, seq, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from texts),
k as (select *, regexp_matches(line, '^#+\\s') as h, sum(regexp_matches(line, '^#+\\s')::int) over (partition by title, seq order by pos) as block from l),
n as (select *, coalesce(max(case when h then {_STRIP.format("line")} end) over (partition by title, seq, block), '') as heading from k),
m as (select *, min(block) over (partition by title, seq, heading) as first, max(block) over (partition by title, seq, heading) as last from n where not h),
e as (select *, min(case when {_STRIP.format("line")} <> '' then pos end) over w as lo, max(case when {_STRIP.format("line")} <> '' then pos end) over w as hi, min(pos) over w as p0 from m where block = last window w as (partition by title, seq, block)),
s as (select title, seq, heading, first as block, pos, case when lo is null then '' else line end as line from e where pos between lo and hi or (lo is null and pos = p0)),
b as (select *, {_STRIP.format("line")} as bare, min(seq) over (partition by title, heading) as born from s),
r as (select *, row_number() over (partition by title, heading, bare order by seq, pos) as again from b),
parts as (select title, heading, seq, min(block) as block, {_STRIP.format("string_agg(line, chr(10) order by pos)")} as t from r where seq = born or bare = '' or again = 1 group by all),
bodies as (select title, heading, min((seq, block)) as ord, string_agg(nullif(t, ''), chr(10) || chr(10) order by seq) as t from parts group by all),
merged as (select title, string_agg(nullif(concat_ws(chr(10), nullif(heading, ''), nullif(t, '')), ''), chr(10) || chr(10) order by heading <> '', ord) as content from bodies group by 1),
sets as (select title, list_sort(list_distinct(list(role))) as roles, list_sort(list_distinct(list(seq::varchar))) as turns from acts group by 1)
select coalesce(o.title, a.title) as title, coalesce(m.content, o.content) as content,
  array_to_string(list_sort(list_distinct(list_concat(case when o.title is null then [] else [o.source] end, coalesce(a.roles, [])))), ',') as paper_ids, coalesce(o.lang, '') as links, coalesce(array_to_string(a.turns, ','), '') as contradictions, a.title is not null as changed
from old o full join sets a on o.title = a.title left join merged m on m.title = coalesce(o.title, a.title)"""


@query(_MERGE)
def WIK02_TXT10_12_merge(spark, d):
    """Each document is a page; a turn of a conversation is an action on the page of its conversation's number."""
    empty = F.array().cast("array<string>")
    old = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.concat(F.lit("# Text\n"), "text").alias("content"), F.array("source").alias("paper_ids"), F.array("lang").alias("links"), empty.alias("contradictions"))
    new = table(spark, d, "conversations").select(F.col("turn").alias("seq"), F.col("conv_id").cast("string").alias("title"), F.concat(F.lit("# Text\n"), "text", F.lit("\n## "), "role", F.lit("\n"), "text").alias("content"), F.array("role").alias("paper_ids"), empty.alias("links"), F.array(F.col("turn").cast("string")).alias("contradictions"))
    out = pages.merge_pages(old, new)
    return out.select("title", "content", *[F.array_join(c, ",").alias(c) for c in ("paper_ids", "links", "contradictions")], "changed")


@query("with n as (select n_nationkey as id, n_name as title, case when n_nationkey % 3 > 0 then 'concept' else 'method' end as type from nation), p as (select r_name as title, 'concept' as type from region union select s_name, 'method' from supplier union select n_name, 'concept' from nation where n_regionkey = 0), c as (select title, list_distinct(string_split(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]', '', 'g'), '')) as b from p where type = 'concept'), l as (select n.id, c.title, len(list_intersect(list_distinct(string_split(regexp_replace(lower(n.title), '[^\\p{L}\\p{N}_]', '', 'g'), '')), c.b)) / len(list_distinct(list_concat(string_split(regexp_replace(lower(n.title), '[^\\p{L}\\p{N}_]', '', 'g'), ''), c.b))) as j from n, c where n.type = 'concept'), r as (select *, row_number() over (partition by id order by j desc, title) as k from l where j >= 0.5) select n.id, case when n.title in (select title from p) then n.title else r.title end as target from n left join r on n.id = r.id and r.k = 1")
def WIK01_dispatch_fuzzy(spark, d):
    n = table(spark, d, "nation")
    acts = n.selectExpr("n_nationkey as id", "n_name as title", "case when n_nationkey % 3 > 0 then 'concept' else 'method' end as type")
    old = table(spark, d, "region").selectExpr("r_name as title", "'concept' as type").union(table(spark, d, "supplier").selectExpr("s_name", "'method'")).union(n.where("n_regionkey = 0").selectExpr("n_name", "'concept'")).distinct()
    return pages.dispatch(old, acts)


@query(f"with p as (select source, {_TYPE} as type, {_TITLE} as title, text as content from documents), o as (select *, case type when 'concept' then 0 when 'synthesis' then 1 when 'method' then 2 when 'dataset' then 3 when 'model' then 4 else 9 end as k, chr(10) || '---' || chr(10) || chr(10) || '## [' || type || '] ' || title || chr(10) || chr(10) || coalesce(content, '') as t from p), u as (select *, length('{pages.CONTEXT_HEAD.strip()}') + 1 + sum(length(t)) over (partition by source order by k, title) as u, row_number() over (partition by source order by k, title) as place from o), f as (select source, place, case when u <= 15000 then t when u - length(t) <= 15000 and 14900 - (u - length(t)) > 200 then substr(t, 1, (14900 - (u - length(t)))::bigint) || chr(10) || '...(截断)' end as piece from u) select * from f where piece is not null")
def WIK04_context(spark, d):
    return pages.pack_context(_pages(spark, d), "source")


_CITES = "c as (select doc_id, unnest(range(1, 8)) as k from documents), ids as (select doc_id, k, case when k = 2 then sha256((doc_id * k)::varchar) else left(sha256((doc_id * k)::varchar), 8) end as pid from c), papers as (select sha256(doc_id::varchar) as id, lang || ' ' || (n_chars % 50) as t from documents), hit as (select i.doc_id, i.k, p.t from ids i join papers p on p.id = i.pid where length(i.pid) >= 32 union all select i.doc_id, i.k, p.t from ids i join papers p on left(p.id, 8) = i.pid where length(i.pid) < 32), first as (select doc_id, t, min(k) as k from hit group by all), named as (select doc_id, array_to_string(list(t order by k, t)[1:5], '|') as titles from first group by 1)"
_CLEAN = "substr(regexp_replace({}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g'), 1, 500)"
_BODY = _CLEAN.format("split_part(text, chr(10) || '#', 1)")


@query(f"with {_CITES}, b as (select doc_id, text, nullif({_BODY}, '') as body from documents) select b.doc_id::varchar as title, case when b.doc_id % 3 < 2 then coalesce(body, '(see wiki page)') else '(see wiki page)' end as core_method, case when b.doc_id % 3 = 0 and body is not null then body when b.doc_id % 3 = 0 then substr('## Technical details' || chr(10) || text, 1, 500) when b.doc_id % 3 = 1 then substr('## summary' || chr(10) || text, 1, 500) else substr('## Limitations: known' || chr(10) || text, 1, 500) end as technique_details, case when b.doc_id % 3 = 2 then coalesce(body, '(see wiki page)') else '(see wiki page)' end as limitations, coalesce(titles, '') as titles from b left join named on b.doc_id = named.doc_id")
def WIK05_JON07_TXT13_clusters(spark, d):
    """Each document is a concept page under one of three headings that cites papers by whole id or first eight letters."""
    t = table(spark, d, "documents")
    sha = lambda k: F.sha2((F.col("doc_id") * k).cast("string"), 256)
    cited = F.array(*[sha(k) if k == 2 else F.substring(sha(k), 1, 8) for k in range(1, 8)])
    head = F.element_at(F.array(F.lit("## Technical details\n"), F.lit("## summary\n"), F.lit("## Limitations: known\n")), (F.col("doc_id") % 3 + 1).cast("int"))
    p = t.select(F.col("doc_id").cast("string").alias("title"), F.concat(head, "text").alias("content"), cited.alias("paper_ids"))
    papers = t.select(sha(1).alias("id"), F.concat("lang", F.lit(" "), (F.col("n_chars") % 50).cast("string")).alias("title"))
    return pages.clusters(p, papers).select("title", "core_method", "technique_details", "limitations", F.array_join("titles", "|").alias("titles"))


@query(f"with p as (select doc_id, {_TYPE} as type, {_TITLE} as title, text from documents) select title, '[' || title || '] ' || substr(coalesce(text, ''), 1, 200) as gap from p where type = 'synthesis' union all select title, '⚠️ 矛盾 [' || title || ']: toxic' from p join labels using (doc_id) where toxic = 1")
def WIK05_cross_gaps(spark, d):
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.array(F.lit("toxic")).alias("contradictions"))
    return pages.cross_gaps(_pages(spark, d).join(bad, "doc_id", "left"))


@query("with p as (select d.conv_id, d.turn, count(*) over (partition by conv_id) as n, d.role from conversations d) select conv_id, turn, case when n >= 3 and role = 'user' then 'user,asks' when n >= 3 then role || ',answers' else role end as contradictions from p")
def WIK06_lint(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", F.col("turn").alias("title"), F.array("role").alias("contradictions"))
    issues = c.select("conv_id", F.col("turn").alias("title"), F.explode(F.array("role", F.when(F.col("role") == "user", "asks").otherwise("answers"))).alias("description"))
    return pages.lint(p, issues, "conv_id").select("conv_id", F.col("title").alias("turn"), F.array_join("contradictions", ",").alias("contradictions"))


# Reports --------------------------------------------------------------------------------------


@query("with t as (select source, doc_id, case when toxic = 1 then 'C' when quality = 1 then 'A' when quality = 0 then 'B' else 'C' end as tier, case when toxic is null then 'draft' else 'active' end as status, lang || ' ' || doc_id as title from documents left join labels using (doc_id)), r as (select *, row_number() over (partition by source order by tier, doc_id) as place from t) select source, place, '- [' || case tier when 'A' then 'A(可信)' when 'B' then 'B(待确认)' else 'C(推测)' end || '][' || status || '] ' || title as line from r where place <= 12")
def RPT02_graded_directions(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    items = t.selectExpr("source", "doc_id", "case when toxic = 1 then 'C' when quality = 1 then 'A' when quality = 0 then 'B' end as tier", "case when toxic is null then 'draft' else 'active' end as status", "concat(lang, chr(10), doc_id) as title")
    return pages.graded_list(items, "source", "doc_id")


@query("with p as (select p_brand, row_number() over (partition by p_brand order by p_partkey) as idx, p_partkey from part), s as (select distinct p_brand, 'all' as section, 0 as a from part union all select distinct p_brand, 'odd', unnest([1, 3, 5, 9999]) from part union all select distinct p_brand, 'two', 2 from part) select p.p_brand, section, idx, p_partkey from p join s on p.p_brand = s.p_brand and (a = 0 or a = idx)")
def RPT04_section_papers(spark, d):
    t = table(spark, d, "part")
    papers = t.select("p_brand", (ranking.ordinal(["p_brand"], "p_partkey") + 1).alias("idx"), "p_partkey")
    wanted = F.array(*[F.struct(F.lit(n).alias("section"), F.array(*[F.lit(i) for i in ix]).cast("array<int>").alias("indices")) for n, ix in (("all", []), ("odd", [1, 3, 5, 9999, 3]), ("two", [2]))])
    sections = t.select("p_brand").distinct().select("p_brand", F.explode(wanted).alias("x")).select("p_brand", "x.section", "x.indices")
    return pages.select_by_index(sections, papers, "p_brand").select("p_brand", "section", "idx", "p_partkey")


# Graph ----------------------------------------------------------------------------------------

_NEAR = "s as (select a.vec_id as q, b.vec_id as id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a, embeddings b where a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by q order by sim desc, id) as n from s), edges as (select distinct least(q, id) as a, greatest(q, id) as b, sim from r where n <= 5 and sim > 0.25)"


def _edges(spark, d):
    """The invented vectors are hardly alike, so the threshold is lower than the operator's."""
    return graph.semantic_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 0.25, 5)


@query(f"with {_NEAR} select a, b, sim from edges")
def GRF05_semantic_edges(spark, d):
    return _edges(spark, d)


_E = "e as (select distinct l_suppkey as a, l_partkey as b from lineitem), g as (select b, count(*) as d from e group by 1), pc as (select x.a, y.a as b, count(*) as common, round(sum(1 / ln(g.d)), 6) as aa from e x join e y on x.b = y.b and x.a < y.a join g on g.b = x.b group by all), n as (select a, count(*) as n from e group by 1), cite as (select pc.a, pc.b, 0.5::double * aa + 0.5::double * round(common / sqrt(na.n * nb.n), 6) as c from pc join n na on na.a = pc.a join n nb on nb.a = pc.b)"


@query(f"with {_NEAR}, {_E} select a, b, round(case when c is null then sim else 0.6::double * c + 0.4::double * coalesce(sim, 0) end, 9) as sim from cite full join edges using (a, b)")
def GRF04_fused_similarity(spark, d):
    """Suppliers share parts; vectors of the same numbers give the semantic side."""
    return graph.fused_edges(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", _edges(spark, d)).select("a", "b", F.round("sim", 9).alias("sim"))


def _rounds(n: int) -> str:
    step = ", v{1} as (select w.a as node, l.label, w.w from ways w join l{0} l on w.b = l.node union all select l{0}.node, label, coalesce(own.w, 1) from l{0} left join own on own.node = l{0}.node), t{1} as (select node, label, sum(w) as w, row_number() over (partition by node order by sum(w) desc, label) as k from v{1} group by node, label), l{1} as (select node, label from t{1} where k = 1)"
    return "".join(step.format(i, i + 1) for i in range(n)) + f" select node, label from l{n}"


@query(f"with {_NEAR}, ways as (select a, b, round(sim * 1000000)::bigint as w from edges union all select b, a, round(sim * 1000000)::bigint from edges), own as (select a as node, max(w) as w from ways group by 1), l0 as (select vec_id as node, vec_id as label from embeddings)" + _rounds(4))
def GRF06_communities(spark, d):
    return graph.communities(table(spark, d, "embeddings").select("vec_id"), _edges(spark, d))


@query(None)
def GRF06_kmeans(spark, d):
    return graph.kmeans(table(spark, d, "embeddings"), "vec_id", "embedding")


# Sources --------------------------------------------------------------------------------------

_LOOKUP = {"s2": "s2_id", "openalex": "openalex_id", "unpaywall": "doi", "crossref": "doi"}
_ITEM = "case when id % 9 = 0 then concat('10.48550/arXiv.', 1000 + id % 9000, '.', 10000 + id) when id % 9 = 1 then concat('10.18653/v1/P', id) else doi end"


@query(f"with {HITS_SQL}, i as (select id, {_ITEM} as doi, arxiv_id, s2_id, openalex_id, case when id % 10 = 3 then 'http://own/' || id else '' end as pdf_url from hits), k as (select distinct doi as u from hits where citation_count < 250), x as (select id, case when citation_count > 450 then 'cache/' || id end as cache from hits), o as (select i.*, cache, case when length(arxiv_id) = 3 and arxiv_id <> '' then arxiv_id else '' end as ax, u from i left join x on i.id = x.id left join k on k.u = nullif(i.doi, '')), w as (select id, case when cache is not null then ['cache', cache] when pdf_url <> '' then ['pdf_url', pdf_url] when ax <> '' then ['arxiv', 'https://arxiv.org/pdf/' || ax] when regexp_extract(doi, '^10\\.48550/(?i:arxiv)\\.([\\d.]+)', 1) <> '' then ['arxiv_doi', 'https://arxiv.org/pdf/' || regexp_extract(doi, '^10\\.48550/(?i:arxiv)\\.([\\d.]+)', 1)] when length(s2_id) = 2 then ['s2', 's2/' || s2_id] when length(openalex_id) = 2 then ['openalex', 'openalex/' || openalex_id] when u is not null and u <> '' then ['unpaywall', 'unpaywall/' || doi] when length(doi) = 3 then ['crossref', 'crossref/' || doi] when regexp_extract(doi, '^10\\.18653/v1/(.+)$', 1) <> '' then ['acl', 'https://aclanthology.org/' || regexp_extract(doi, '^10\\.18653/v1/(.+)$', 1) || '.pdf'] end as p from o) select id, p[1] as via, p[2] as url from w")
def SRC12_pdf_cascade(spark, d):
    h = hits(spark, d)
    items = h.selectExpr("id", f"{_ITEM} as doi", "case when length(arxiv_id) = 3 then arxiv_id else '' end as arxiv_id", "s2_id", "openalex_id", "case when id % 10 = 3 then concat('http://own/', id) else '' end as pdf_url")
    offered = {"s2": h.where("length(s2_id) = 2"), "openalex": h.where("length(openalex_id) = 2"), "unpaywall": h.where("citation_count < 250 and doi <> ''"), "crossref": h.where("length(doi) = 3")}
    lookups = {n: t.select(F.col(_LOOKUP[n]).alias("key")).where("key is not null").distinct().select("key", F.concat(F.lit(f"{n}/"), "key").alias("url")) for n, t in offered.items()}
    return sources.pdf_cascade(items, h.where("citation_count > 450").select("id", F.concat(F.lit("cache/"), F.col("id").cast("string")).alias("path")), lookups)


@query("with l as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || case when l_returnflag = 'N' then '' else l_returnflag end || ' |' as line from lineitem) select l_orderkey, chr(10) || '[TABLE]' || chr(10) || '| line | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list(line order by l_linenumber, l_partkey, l_returnflag), chr(10)) || chr(10) || '[/TABLE]' || chr(10) as md from l group by 1 union all select o_orderkey, null from orders where o_orderkey not in (select l_orderkey from lineitem)")
def SRC14_table_markdown(spark, d):
    """An order's lines are a table; one without lines has no second row."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("l"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).join(l, "l_orderkey", "full_outer")
    cells = F.transform("l", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), F.nullif(x["l_returnflag"], F.lit("N"))))
    rows = F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flag"))), F.coalesce(cells, F.array().cast("array<array<string>>")))
    return o.select("l_orderkey", sources.table_markdown(rows).alias("md"))


_BOX = {"x0": "p_size % 7", "y0": "p_size % 5", "x1": "p_size % 7 + p_partkey % 6", "y1": "p_size % 5 + p_partkey % 4"}
_HALF = "greatest(least({x1}, {a}) - greatest({x0}, {b}), 0) * greatest(least({y1}, {a}) - greatest({y0}, {b}), 0)"
_AREA = "(({x1}) - ({x0})) * (({y1}) - ({y0}))".format(**_BOX)


@query(f"select p_partkey, {_AREA} > 0 and ({_HALF.format(a=4, b=0, **_BOX)} > 0.5::double * ({_AREA}) or {_HALF.format(a=9, b=5, **_BOX)} > 0.5::double * ({_AREA})) as inside from part")
def SRC15_box_overlap(spark, d):
    box = F.struct(*[F.expr(e).alias(n) for n, e in _BOX.items()])
    images = F.expr("array(named_struct('x0', 0, 'y0', 0, 'x1', 4, 'y1', 4), named_struct('x0', 5, 'y0', 5, 'x1', 9, 'y1', 9))")
    t = table(spark, d, "part").select("p_partkey", box.alias("box"), images.alias("images"))
    return t.select("p_partkey", sources.overlaps_image(F.col("box"), F.col("images")).alias("inside"))


@query("select vec_id, label as collection from embeddings where label % 3 <> 1")
def SRC20_signature_drift(spark, d):
    """One in three collections was made by another model, one in three has no signature."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("collection"))
    kinds = e.select("collection").distinct().select("collection", F.expr("case collection % 3 when 0 then 'm2:64' when 1 then 'm1:32' end").alias("signature"))
    return sources.drop_drifted(e, kinds, "m2:64").select("vec_id", "collection")


@query("select event_type as step, case when event_id % 2 = 0 then 'tool' else 'model' end as type, (event_id % 5)::int as round, json_object('user', user_id, 'n', event_id)::varchar as input, json_object('kind', event_type)::varchar as output, event_id % 900 as tokens, event_id % 77 as ms from events")
def SRC23_trace_sink(spark, d):
    """Two appends, one for each type, read back."""
    e = table(spark, d, "events").selectExpr("event_type as step", "case when event_id % 2 = 0 then 'tool' else 'model' end as type", "event_id % 5 as round", "named_struct('user', user_id, 'n', event_id) as input", "named_struct('kind', event_type) as output", "event_id % 900 as tokens", "event_id % 77 as ms")
    path = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    for kind in ("tool", "model"):
        sources.append_traces(e.where(F.col("type") == kind), path)
    return sources.read_traces(spark, path)


@query(f"with {HITS_SQL}, {KEYED} select id, min(pos) over (partition by key) as canonical from keyed")
def JON15_backfill(spark, d):
    """Raw rows find their survivor by key, not by an ordinal."""
    k = hits(spark, d).select("id", "pos", identity_key().alias("key"))
    return k.join(k.groupBy("key").agg(F.min("pos").alias("canonical")), "key").select("id", "canonical")


@query("select doc_id, 'chunk' as kind, quality::varchar as body from labels union all select doc_id, 'abstract', text from documents where text <> '' and doc_id not in (select doc_id from labels)")
def TXT05_abstract_fallback(spark, d):
    """Labels stand for chunks: a document without any falls back to its own text."""
    chunks = table(spark, d, "labels").select("doc_id", F.lit("chunk").alias("kind"), F.col("quality").cast("string").alias("body"))
    bare = table(spark, d, "documents").where("text <> ''").join(chunks, "doc_id", "left_anti")
    return chunks.unionByName(bare.select("doc_id", F.lit("abstract").alias("kind"), F.col("text").alias("body")))
