"""Knowledge pages and reports: merging, packing into a budget, clusters, lint, selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of page types in a context, and the place of any other type.
TYPE_ORDER, OTHER_TYPE = {"concept": 0, "synthesis": 1, "method": 2, "dataset": 3, "model": 4}, 9
#: Head of a packed context, note after a cut page, room kept for it, and the least worth cutting.
CONTEXT_HEAD, CUT_NOTE, CUT_ROOM, CUT_LEAST = "# 知识库 Wiki（预编译的论文知识合成）\n", "\n...(截断)", 100, 200
#: Headings tried in turn for each part of a cluster, and the text where none is found.
CLUSTER_PARTS = {
    "core_method": ("Technical Details", "Summary", "总结"),
    "technique_details": ("Technical Details", "技术细节"),
    "problem_addressed": ("Problem", "问题"),
    "key_findings": ("Key Findings", "关键发现", "Findings"),
    "limitations": ("Limitations", "局限"),
}
NO_PART = "(see wiki page)"
#: Labels of the confidence tiers.
TIER_LABELS = {"A": "A(可信)", "B": "B(待确认)", "C": "C(推测)"}
#: A line that starts a section.
HEADING = r"^#+\s"


def _stripped(c) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def section_lines(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, block, heading ('' before the first), pos, line of texts(keys, text): the lines below each heading, blank ones at a body's ends left out.

    Of a heading that a text repeats the last body counts, at the place of the first; a heading with no line below it is left out.
    """
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("is", F.col("line").rlike(HEADING))
    within = Window.partitionBy(*keys)
    lines = lines.withColumn("block", F.sum(F.col("is").cast("int")).over(within.orderBy("pos")))
    lines = lines.withColumn("heading", F.coalesce(F.max(F.when(F.col("is"), _stripped("line"))).over(Window.partitionBy(*keys, "block")), F.lit(""))).where("not is")
    of = Window.partitionBy(*keys, "heading")
    lines = lines.withColumns({"first": F.min("block").over(of), "last": F.max("block").over(of)}).where("block = last")
    body = Window.partitionBy(*keys, "block")
    seen = _stripped("line") != ""
    lines = lines.withColumns({"from": F.min(F.when(seen, F.col("pos"))).over(body), "to": F.max(F.when(seen, F.col("pos"))).over(body)})
    # A body of blank lines only still names its section, by one empty line.
    kept = lines.withColumn("low", F.min("pos").over(body)).where("pos between from and to or (from is null and pos = low)")
    return kept.select(*keys, F.col("first").alias("block"), "heading", "pos", F.when(F.col("from").isNull(), F.lit("")).otherwise(F.col("line")).alias("line"))


def merge_texts(texts: DataFrame, key: str) -> DataFrame:
    """key, content: texts(key, seq, text) of each key merged section by section in order of seq.

    A section comes where it first appears, whole as it first appears. From later texts only lines are added whose stripped form
    the section lacks so far, with the blank lines between them; what a text adds follows a blank line.
    """
    lines = section_lines(texts, key, "seq").withColumn("bare", _stripped("line"))
    lines = lines.withColumn("born", F.min("seq").over(Window.partitionBy(key, "heading")))
    again = F.row_number().over(Window.partitionBy(key, "heading", "bare").orderBy("seq", "pos"))
    added = lines.withColumn("again", again).where("seq = born or bare = '' or again = 1")
    parts = added.groupBy(key, "heading", "seq").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    parts = parts.select(key, "heading", "seq", "block", _stripped(F.array_join(F.col("l.line"), "\n")).alias("t"))
    bodies = parts.groupBy(key, "heading").agg(F.min(F.struct("seq", "block")).alias("at"), F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("seq", "t")))).alias("l"))
    bodies = bodies.select(key, F.struct((F.col("heading") != "").alias("low"), "at").alias("at"), F.concat_ws("\n", F.nullif("heading", F.lit("")), F.nullif(F.array_join(F.col("l.t"), "\n\n"), F.lit(""))).alias("t"))
    return bodies.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("at", "t")))).alias("l")).select(key, F.array_join(F.col("l.t"), "\n\n").alias("content"))


def merge_pages(pages: DataFrame, actions: DataFrame, sets: tuple[str, ...] = ("paper_ids", "links", "contradictions")) -> DataFrame:
    """title, content and the set columns, changed: actions(seq, title, content, sets) are merged in order of seq, all in the JVM.

    A title without a page is created from its actions. Actions without text leave a page's text as it is. Set columns are united.
    """
    empty = F.array().cast("array<string>")
    by = actions.groupBy("title").agg(F.count_if(_stripped("content") != "").alias("texts"), *[F.flatten(F.collect_list(F.coalesce(c, empty))).alias(f"_{c}") for c in sets])
    both = pages.select("title", "content", *sets, F.lit(True).alias("old")).join(by.withColumn("hit", F.lit(True)), "title", "full_outer")
    new = actions.where(_stripped("content") != "").select("title", "seq", _stripped("content").alias("text"))
    old = pages.join(new.select("title").distinct(), "title", "left_semi").where("content <> ''").select("title", F.lit(None).cast(dict(actions.dtypes)["seq"]).alias("seq"), F.col("content").alias("text"))
    texts = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new.withColumn("seq", F.col("seq").cast("long")))
    merged = merge_texts(texts, "title").withColumnRenamed("content", "merged")
    out = both.join(merged, "title", "left")
    union = [F.when(F.col("hit"), F.array_sort(F.array_union(F.coalesce(c, empty), F.coalesce(f"_{c}", empty)))).otherwise(F.col(c)).alias(c) for c in sets]
    return out.select("title", F.coalesce("merged", "content").alias("content"), *union, F.coalesce("hit", F.lit(False)).alias("changed"))


def dispatch(pages: DataFrame, actions: DataFrame, least: float = 0.5) -> DataFrame:
    """id, target: the page (title, type) each of actions(id, title, type) merges into, null where it is inserted.

    An equal title wins. Concept actions without one take the concept page most alike by character sets, by title where equal.
    Pages are few: they are broadcast if their count is small.
    """
    bare = lambda c: F.array_distinct(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", ""), ""))
    exact = actions.join(pages.select("title").distinct().withColumn("found", F.lit(True)), "title", "left")
    left = exact.where("found is null and type = 'concept'").select("id", bare("title").alias("a"))
    concept = pages.where("type = 'concept'").select(F.col("title").alias("page"), bare("title").alias("b"))
    concept = F.broadcast(concept) if concept.count() <= 10_000 else concept
    n = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    like = left.join(concept, F.arrays_overlap("a", "b")).select("id", "page", n.alias("n")).where(F.col("n") >= least)
    best = like.groupBy("id").agg(F.min_by("page", F.struct(-F.col("n"), "page")).alias("page"))
    return exact.join(best, "id", "left").select("id", F.when(F.col("found"), F.col("title")).otherwise(F.col("page")).alias("target"))


def type_rank(kind) -> Column:
    order = F.create_map(*[F.lit(x) for pair in TYPE_ORDER.items() for x in pair])
    return F.coalesce(F.try_element_at(order, kind), F.lit(OTHER_TYPE))


def pack_context(pages: DataFrame, by: str, most: int = 15_000) -> DataFrame:
    """by, place, piece: pages(by, type, title, content) in order of type and title until `most` characters are used.

    The page that no longer fits is cut to what is left, if that is worth it. Every page takes some characters for its
    head, so no more than most / 14 pages of a group are looked at, whatever its size.
    """
    order = Window.partitionBy(by).orderBy(type_rank(F.col("type")), "title")
    text = F.concat(F.lit("\n---\n\n## ["), "type", F.lit("] "), "title", F.lit("\n\n"), F.coalesce("content", F.lit("")))
    first = pages.where("type <> 'index'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most // 14 + 1)
    first = first.select(by, "place", text.alias("t"))
    upto = F.sum(F.length("t")).over(Window.partitionBy(by).orderBy("place")) + len(CONTEXT_HEAD)
    room = most - (F.col("u") - F.length("t")) - CUT_ROOM
    fits = F.when(F.col("u") <= most, F.col("t")).when((F.col("u") - F.length("t") <= most) & (room > CUT_LEAST), F.concat(F.substring("t", F.lit(1), room.cast("int")), F.lit(CUT_NOTE)))
    return first.withColumn("u", upto).select(by, "place", fits.alias("piece")).where("piece is not null")


def section(content, *headings: str, most: int = 500) -> Column:
    """Stripped text under the first of the headings that has any, up to `most` characters; else null."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = [F.nullif(F.substring(strip(F.regexp_extract(content, rf"(?is)(?:^|\n)#+\s*{re.escape(h)}[^\n]*\n(.*?)(?=\n#|\z)", 1)), 1, most), F.lit("")) for h in headings]
    return F.coalesce(*found)


def clusters(pages: DataFrame, papers: DataFrame, most_titles: int = 5) -> DataFrame:
    """title, the parts of CLUSTER_PARTS and titles, for concept pages(title, content, paper_ids).

    Ids of 32 characters or more are whole, others are resolved by their first eight: both are equal joins. Where a page
    has fewer titles than ids, ids of eight hexadecimal digits in its content are resolved too.
    """
    ids = pages.select("title", F.posexplode("paper_ids").alias("pos", "pid"), F.lit(0).alias("way"))
    told = pages.select("title", F.posexplode(F.regexp_extract_all("content", F.lit(r"\b([0-9a-f]{8})\b"), F.lit(1))).alias("pos", "pid"), F.lit(1).alias("way"))
    whole = papers.select(F.col("id").alias("pid"), F.col("title").alias("t"), F.substring("id", 1, 8).alias("pre"))
    a = ids.where("length(pid) >= 32").join(whole.drop("pre"), "pid").select("title", "way", "pos", "t")
    b = ids.where("length(pid) < 32").unionAll(told).join(whole.drop("pid"), F.col("pid") == F.col("pre")).select("title", "way", "pos", "t")
    first = a.unionAll(b).groupBy("title", "t").agg(F.min(F.struct("way", "pos")).alias("at"))
    named = first.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("l"), F.count_if(F.col("at.way") == 0).cast("int").alias("cited"))
    parts = []
    for name, headings in CLUSTER_PARTS.items():
        default = F.substring(F.coalesce("content", F.lit("")), 1, 500) if name == "technique_details" else F.lit(NO_PART)
        parts.append(F.coalesce(section("content", *headings), default).alias(name))
    out = pages.select("title", F.size("paper_ids").alias("ids"), *parts).join(named, "title", "left")
    n = F.least(F.when(F.col("cited") < F.col("ids"), F.size("l")).otherwise(F.col("cited")), F.lit(most_titles))
    return out.select("title", *CLUSTER_PARTS, F.coalesce(F.slice(F.col("l.t"), F.lit(1), n), F.array().cast("array<string>")).alias("titles"))


def cross_gaps(pages: DataFrame) -> DataFrame:
    """title, gap: excerpts of synthesis pages and contradictions of all pages but the index."""
    a = pages.where("type = 'synthesis'").select("title", F.concat(F.lit("["), "title", F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, 200)).alias("gap"))
    b = pages.where("type <> 'index'").select("title", F.explode("contradictions").alias("c")).select("title", F.concat(F.lit("⚠️ 矛盾 ["), "title", F.lit("]: "), "c").alias("gap"))
    return a.unionAll(b)


def lint(pages: DataFrame, issues: DataFrame, by: str, least: int = 3) -> DataFrame:
    """pages(by, title, contradictions) with the descriptions of issues(by, title, description) that they lack, where a group has `least` pages."""
    size = pages.groupBy(by).agg(F.count("*").alias("_n"))
    found = issues.groupBy(by, "title").agg(F.array_sort(F.collect_set("description")).alias("_d"))
    out = pages.join(size, by).join(found, [by, "title"], "left")
    return out.select(*pages.columns[: pages.columns.index("contradictions")], F.when((F.col("_n") >= least) & F.col("_d").isNotNull(), F.array_union("contradictions", "_d")).otherwise(F.col("contradictions")).alias("contradictions"))


def graded_list(items: DataFrame, by: str, order: str, most: int = 12) -> DataFrame:
    """by, place, line: the first `most` of items(by, tier, status, title) by tier; an unknown tier is C."""
    tier = F.when(F.col("tier").isin(*TIER_LABELS), F.col("tier")).otherwise("C")
    label = F.try_element_at(F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair]), tier)
    n = F.row_number().over(Window.partitionBy(by).orderBy(tier, order))
    line = F.concat(F.lit("- ["), label, F.lit("]["), "status", F.lit("] "), F.replace("title", F.lit("\n"), F.lit(" ")))
    return items.withColumn("place", n).where(F.col("place") <= most).select(by, "place", line.alias("line"))


def select_by_index(sections: DataFrame, papers: DataFrame, by: str) -> DataFrame:
    """Papers(by, idx, ...) of each of sections(by, section, indices): those named, or all where none is; unknown indices give nothing."""
    some = sections.where("size(indices) > 0").select(by, "section", F.explode(F.array_distinct("indices")).alias("idx")).join(papers, [by, "idx"])
    every = sections.where("coalesce(size(indices), 0) <= 0").select(by, "section").join(papers, by)
    return some.unionByName(every)
