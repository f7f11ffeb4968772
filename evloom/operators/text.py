"""Chunking, sections and document text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Section names and the words that announce them, in the order they are tried.
SECTIONS = {
    "method": ("method", "methodology", "approach", "model", "architecture", "framework", "design"),
    "experiment": ("experiment", "evaluation", "results", "setup", "implementation", "ablation"),
    "introduction": ("introduction", "background", "related work", "preliminar", "overview"),
    "conclusion": ("conclusion", "discussion", "future work", "limitation", "summary"),
}
#: The same for headings that must start with the word or a number before it.
STRICT_SECTIONS = {
    "abstract": ("abstract",),
    "introduction": ("introduction", "background", "overview", "preliminar"),
    "method": ("method", "methodology", "approach", "framework", "design", "model architecture", "proposed"),
    "experiment": ("experiment", "evaluation", "results", "setup", "implementation", "ablation", "rq"),
    "conclusion": ("conclusion", "discussion", "future work", "limitation", "summary", "threats to validity"),
}
#: Figure and table marks.
MARKS = r"\[FIGURE:.*?\]|\[TABLE\]|\[/TABLE\]"
#: Notes that stand in place of text.
PLACEHOLDERS = (
    r"（.*?保持不变.*?）", r"（.*?保持原.*?）", r"（.*?新增内容.*?）", r"（.*?此部分.*?）", r"（.*?其余.*?不变.*?）", r"（.*?省略.*?）", r"（.*?详见.*?）", r"（.*?同上.*?）", r"（.*?参见.*?）", r"（.*?不?变.*?）", r"（.*?未变.*?）",
    r"\(.*?remain.*?unchanged.*?\)", r"\(.*?see above.*?\)", r"\(.*?omitted.*?\)", r"^（.*?补充.*?）$", r"^（.*?完善.*?）$",
)
#: Roles of a paper and the words in its title or abstract that give them; more citations than this make it seminal.
ROLES = {"survey": ("survey", "review", "tutorial", "comprehensive"), "benchmark": ("benchmark", "dataset", "evaluation"), "negative_result": ("negative", "failure", "limitation", "cannot")}
SEMINAL = 100


def _any(x, words) -> Column:
    return F.lower(x).rlike("|".join(re.escape(w) for w in words))


def classify_heading(x) -> Column:
    """First section any of whose words is in a line of up to 80 characters, # in front left out; else null."""
    head = F.trim(F.regexp_replace(F.lower(F.trim(x)), "^#+", ""))
    out = F.lit(None).cast("string")
    for name, words in reversed(SECTIONS.items()):
        out = F.when(_any(head, words), name).otherwise(out)
    return F.when(F.length(head) <= 80, out)


def strict_heading(x) -> Column:
    """First section with a word that a line of under 60 characters starts with, a number before it or not; else null."""
    head = F.lower(F.trim(x))
    out = F.lit(None).cast("string")
    for name, words in reversed(STRICT_SECTIONS.items()):
        out = F.when(head.rlike(r"^(\d+\.?\s*)?(" + "|".join(map(re.escape, words)) + ")"), name).otherwise(out)
    return F.when(F.length(head) < 60, out)


def strict_sections(df: DataFrame, key: str) -> DataFrame:
    """key, section, lines, chars: the lines of each text by the last heading above them (introduction before the first), headings left out."""
    lines = df.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("heading", strict_heading("line"))
    above = F.last("heading", ignorenulls=True).over(Window.partitionBy(key).orderBy("pos"))
    named = lines.withColumn("section", F.coalesce(above, F.lit("introduction"))).where("heading is null")
    return named.groupBy(key, "section").agg(F.count("*").alias("lines"), F.sum(F.length(F.trim("line"))).alias("chars"))


def word_count(x) -> Column:
    """Words outside of marks."""
    return F.size(F.filter(F.split(F.regexp_replace(x, MARKS, ""), r"\s+"), lambda w: w != ""))


def check_citations(text, n_papers: int) -> tuple[Column, Column]:
    """The text with marks [Pn] beyond the papers replaced, and the share of papers that are cited."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[P(\d+)\]"), F.lit(1)))
    good = F.filter(cited, lambda x: F.coalesce(F.try_to_number(x, F.lit("9999999999")), F.lit(0)).between(1, n_papers))
    clean = F.aggregate(F.array_except(cited, good), text, lambda t, x: F.replace(t, F.concat(F.lit("[P"), x, F.lit("]")), F.lit("[unsupported]")))
    return clean, F.size(F.array_distinct(F.transform(good, lambda x: x.cast("bigint")))) / F.lit(max(n_papers, 1))


def is_placeholder(x) -> Column:
    return x.rlike("|".join(PLACEHOLDERS))


def roles(title, abstract, citations) -> Column:
    """The roles of a paper, method where there is none."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    tags = [F.when(_any(both, ROLES["survey"]), "survey"), F.when(F.coalesce(citations, F.lit(0)) > SEMINAL, "seminal"), *(F.when(_any(both, ROLES[k]), k) for k in ("benchmark", "negative_result"))]
    found = F.filter(F.array(*tags), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("method")))


def cover_terms(terms, variants, scope) -> Column:
    """variants, and for each term that none of them holds the term with the scope."""
    bare = F.filter(F.transform(terms, lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    missing = F.filter(bare, lambda t: ~F.exists(variants, lambda v: F.contains(F.lower(v), F.lower(t))))
    return F.concat(variants, F.transform(missing, lambda t: F.trim(F.concat_ws(" ", t, F.trim(F.coalesce(scope, F.lit("")))))))


def slices(df: DataFrame, size: int) -> DataFrame:
    """Parts of `size` characters without overlap; an empty text has one empty part, a null text none."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1))
    return df.where("text is not null").select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i")).withColumn("part", F.expr(f"substring(text, cast(i * {size} + 1 as int), {size})")).drop("text")


def accumulate_chunks(df: DataFrame, key: str, least: int = 250) -> DataFrame:
    """key, chunk, section, n_words, first_line: lines gather until they hold `least` words, then a chunk ends; the rest is the last.

    A heading ends a chunk too and names the section of those that follow (unknown before the first); it is in no chunk.
    The boundary depends on the one before, so the lines of a text are folded in its row; the text stays in the JVM.
    """
    # A line of blanks only does not begin a chunk's text.
    line = lambda x: F.struct(word_count(x).alias("w"), classify_heading(x).alias("h"), (F.trim(x) != "").alias("b"))
    lines = df.where("text is not null").select(key, F.transform(F.split("text", "\n"), line).alias("w"))
    start = "named_struct('done', cast(array() as array<struct<sec:string,n:int,at:int>>), 'sec', 'unknown', 'n', 0, 'live', false, 'at', cast(null as int), 'i', 0)"
    flush = "concat(a.done, array(named_struct('sec', a.sec, 'n', {n}, 'at', {at})))"
    on_heading = f"named_struct('done', if(a.live, {flush.format(n='a.n', at='a.at')}, a.done), 'sec', x.h, 'n', 0, 'live', false, 'at', cast(null as int), 'i', a.i + 1)"
    full = f"named_struct('done', {flush.format(n='a.n + x.w', at='coalesce(a.at, a.i)')}, 'sec', a.sec, 'n', 0, 'live', false, 'at', cast(null as int), 'i', a.i + 1)"
    more = "named_struct('done', a.done, 'sec', a.sec, 'n', a.n + x.w, 'live', a.live or x.b, 'at', coalesce(a.at, a.i), 'i', a.i + 1)"
    step = f"(a, x) -> if(x.h is not null, {on_heading}, if(a.n + x.w >= {least}, {full}, {more}))"
    end = f"a -> if(a.live, {flush.format(n='a.n', at='a.at')}, a.done)"
    out = lines.select(key, F.expr(f"aggregate(w, {start}, {step}, {end})").alias("c"))
    return out.select(key, F.posexplode("c").alias("chunk", "x")).select(key, "chunk", F.col("x.sec").alias("section"), F.col("x.n").alias("n_words"), F.col("x.at").alias("first_line"))


#: Words of an anchor, and short passages up to which they are broadcast.
ANCHOR, FEW = 8, 10_000


def locate(docs: DataFrame, passages: DataFrame, doc: str, passage: str) -> DataFrame:
    """passage, doc, span_start: every text of docs(doc, text) that holds the text of passages(passage, text), and where it first does.

    A passage's words but the first and last, which may be parts of words, stand in such a text as they are. One run of up
    to ANCHOR of them, the one that fewest passages share, is the passage's anchor: runs of the texts are joined to anchors by hash, and matches
    are verified. Only passages of one or two words are held against all texts. Nulls match nothing.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = passages.where("text is not null").select(passage, F.col("text").alias("span"), words("text").alias("w")).withColumn("m", F.least(F.size("w") - 2, F.lit(ANCHOR)))
    run = lambda m: f"transform(sequence(1, greatest(size(w) - {m} + 1, 1)), i -> xxhash64({m}, slice(w, i, {m})))"
    inner = p.where("m >= 1").withColumn("w", F.expr("slice(w, 2, size(w) - 2)")).select(passage, "span", "m", F.explode(F.array_distinct(F.expr(run("m")))).alias("h"))
    shared = F.count("*").over(Window.partitionBy("h"))
    anchors = inner.withColumn("c", shared).groupBy(passage).agg(F.min_by(F.struct("span", "m", "h"), F.struct("c", "h")).alias("a")).select(passage, "a.*")
    sizes = sorted(r["m"] for r in anchors.select("m").distinct().collect())  # ANCHOR rows at most
    few = lambda df: F.broadcast(df) if df.count() <= FEW else df
    place = (F.expr("locate(span, text)") - 1).alias("span_start")
    short = p.where("m < 1").select(passage, "span")
    out = docs.join(few(short), F.col("text").contains(F.col("span"))).select(passage, doc, place)
    if sizes:
        runs = F.concat(*[F.expr(f"if(size(w) >= {m}, {run(m)}, cast(array() as array<bigint>))") for m in sizes])
        found = docs.select(doc, "text", words("text").alias("w")).select(doc, "text", F.explode(F.array_distinct(runs)).alias("h"))
        out = out.unionAll(found.join(few(anchors), "h").where(F.col("text").contains(F.col("span"))).select(passage, doc, place))
    return out


def inverted_index(words):
    """A map from each word of an array to its places, from 0."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    starts = lambda l: F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: (i == 0) | (F.get(l, i - 1)["w"] != F.get(l, i)["w"]))
    run = lambda l, s, to: F.struct(F.get(l, s)["w"].alias("w"), F.transform(F.slice(l, s + 1, to - s), lambda x: x["p"]).alias("ps"))
    # Lists of one, so that words are sorted and runs are found once.
    entries = F.transform(F.array(placed), lambda l: F.transform(F.array(starts(l)), lambda at: F.transform(at, lambda s, j: run(l, s, F.coalesce(F.get(at, j + 1), F.size(l)))))[0])[0]
    return F.map_from_entries(entries)
