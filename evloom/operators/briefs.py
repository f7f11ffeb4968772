"""Documents put together from many relations: each gives lines with a section and a place, one union holds them all, one ordered fold a document writes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evloom.operators.ranking import heads

#: Wording of the brief.
TITLE, TOPIC, NO_TOPIC = "# 研究态势简报 (Research Landscape Brief)\n", "> 研究方向：{}\n", "(未指定)"
HEADINGS = ("## 本次运行结果\n", "## 研究问题与覆盖度\n", "## 论文概览\n", "## 已知局限与研究空白线索\n", "## 候选研究空白 (Gap) 与审计状态\n", "## 建议的下一步\n")
TABLE_HEAD = ("| 研究问题 | 重要性 | 状态 | 覆盖度 | 证据质量 | 检索饱和 |", "|---|---|---|---|---|---|")
NONE = "—"
NO_QUESTIONS, NO_GAPS = "(尚未分解出研究问题)\n", "(本次运行未挖掘出可入库的候选 Gap。)\n"
NO_LIMITS = '(尚未从文献中抽取到明确的局限/负面结果信号 — 这通常意味着需要下载更多论文全文，或针对性检索 "limitations of ..." / "failure cases of ..."。)\n'
SATURATION = {"INSUFFICIENT_OBSERVATION": "观察不足", "STILL_GAINING": "仍在增长", "SATURATED": "已饱和"}
UNAVAILABLE = "不可得({})"
PAPERS = "入库论文 %d 篇，其中完成评分 %d 篇（高优先级 %d 篇），已抽取证据覆盖 %d 篇。\n"
UNSCORED = "另有 %d 篇为定向补检索召回、尚未评分，未进入证据抽取池（不计入有效分析范围）。\n"
ROLES = ("论文角色分布：", "，", "。\n")
GAPS = "候选 Gap 共 %d 个：存活 %d，被驳回 %d，未确认 %d（检索预算耗尽后仍缺少足够证据），待定/审计中 %d。\n"
TIERS = ("A(全文支撑)", "B(摘要级)")
STATUS = {"surviving": "存活", "rejected": "驳回", "inconclusive": "未确认", "auditing": "审计中", "audited": "已审计", "candidate": "候选", "superseded": "已取代"}
CONFIDENCE = {"INSUFFICIENT_OBSERVATION": "观察不足", "high": "高", "medium": "中", "low": "低"}
UNKNOWN = "未知"
PRIOR, RESIDUAL, SEARCHED, STABLE, FAMILIES = "  - 最近已知 prior art: ", "  - 剩余缺口: ", "  - 检索置信度: ", "，近邻稳定性 %.2f", "，query family 覆盖 %.0f%%"
PLAN = (("phenomenon", "待验证现象", True), ("mechanism", "被测机制", False), ("supports_claim", "支持的 Gap claim", False), ("experiment", "证伪实验", True), ("kill_criterion", "放弃判据", False), ("kill_basis", "阈值依据", False))
#: Kinds of evidence that are limitations, states that don't count, and how many are taken and shown; gaps shown; widths of texts.
LIMITING, DISMISSED, TAKEN, SHOWN, GAPS_SHOWN = ("limitation", "negative_result", "future_work"), ("rejected", "conflicted"), 30, 15, 12
INDEX_TYPES = {"concept": "研究概念 (Concepts)", "method": "方法/技术 (Methods)", "dataset": "数据集 (Datasets)", "model": "模型 (Models)", "synthesis": "综合分析 (Synthesis)"}


def assemble(lines: DataFrame, key: str, name: str) -> DataFrame:
    """key, name: the lines (key, section, place, line) of each document in order, one below the other."""
    by = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("l"))
    return by.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias(name))


def _word(column, words: dict, other):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), column), other)


def _flat(column, n: int):
    return F.replace(F.left(F.coalesce(column, F.lit("")), F.lit(n)), F.lit("\n"), F.lit(" "))


def _number(column, pattern: str = "%.2f"):
    """Two digits, halves to even."""
    return F.coalesce(F.when(column.isNotNull(), F.format_string(pattern, F.bround(column.cast("double"), 2))), F.lit(NONE))


#: When a line is shown: always; as one of its section's own; only beside such, or only where there are none; as own, but only for a task that has a row.
ALWAYS, OWN, BESIDE, INSTEAD, COUNTED = range(5)


def _line(section: int, place, line, shown: int = ALWAYS):
    """Places are (major, minor, minor) numbers; a line that is null is none."""
    parts = [F.lit(x) if isinstance(x, int) else x for x in (*place, 0, 0)[:3]]
    line = F.lit(line) if isinstance(line, str) else line
    return F.struct(F.lit(section).alias("section"), F.array(*(p.cast("long") for p in parts)).alias("place"), line.alias("line"), F.lit(shown).alias("shown"))


def _lines(df: DataFrame, *lines, more=None) -> DataFrame:
    """All lines that rows give, from one pass over them; more is an array of further ones."""
    every = F.array(*lines)
    return df.select("task", F.inline(every if more is None else F.concat(every, more))).where("line is not null")


def _papers(papers: DataFrame, roles: DataFrame | None, evidence: DataFrame | None) -> DataFrame:
    """task, all, scored, high, covered, roles (role, n): sums by role and distinct papers of evidence from one pass over each relation."""
    listed = [F.lit(1).alias("all"), F.col("priority").isNotNull().cast("int").alias("scored"), F.coalesce((F.col("priority") == "high").cast("int"), F.lit(0)).alias("high")]
    none = [F.lit(0).alias(c) for c in ("all", "scored", "high")]
    unlisted, unread = F.lit(0).alias("held"), F.lit(None).cast("string").alias("role")
    if roles is None and evidence is None:
        paper = F.col("paper_id").alias("paper")
        no_paper = F.when(F.lit(False), F.col("paper_id")).alias("paper")
        parts = [papers.select("task", F.inline(F.array(F.struct(F.col("role").cast("string").alias("role"), no_paper, *listed, F.lit(1).alias("held")), F.struct(unread, paper, *none, unlisted))))]
    else:
        parts = [papers.select("task", unread, *listed, unlisted), roles.select("task", F.col("role").cast("string").alias("role"), *none, F.lit(1).alias("held")), evidence.select("task", unread, F.col("paper_id").alias("paper"), *none, unlisted)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    sums = [F.sum(c).alias(c) for c in ("all", "scored", "high")]
    by = rows.groupBy("task", "role", "paper").agg(*sums, F.sum("held").alias("held"))
    return by.groupBy("task").agg(*sums, F.count("paper").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("held") > 0, F.struct("role", F.col("held").alias("n"))))).alias("roles"))


def brief(tasks: DataFrame, questions: DataFrame, coverage: DataFrame, papers: DataFrame, roles: DataFrame | None, evidence: DataFrame | None, gaps: DataFrame, plans: DataFrame, steps: DataFrame) -> DataFrame:
    """task, brief: the six sections of a landscape brief for each task.

    tasks: task, topic, explanation (of how it ended; null: no such section).  questions: task, question_id, question, importance, status.  coverage: question_id, round, score, unavailable,
    quality, saturation; the last round counts.  papers: task, paper_id, priority (null: not scored).  roles: task, role.  evidence: task, evidence_id, paper_id, type, claim, status; where rows of
    papers are also a role and evidence each, papers holds these columns and both are None.
    gaps: task, gap_id, canonical, version, created, status, complete, description, nearest, residual, confidence, stability, families; the last version of a canonical one counts.
    plans: gap_id and the columns of PLAN.  steps: task, place, step.  Of equal ranks the lower id comes first.  Each relation is read once, papers that hold evidence twice.
    """
    topic = F.format_string(TOPIC.replace("{}", "%s"), F.coalesce(F.nullif("topic", F.lit("")), F.lit(NO_TOPIC)))
    fixed = _lines(
        tasks, _line(0, (0,), TITLE), _line(0, (1,), topic), _line(1, (0,), F.when(F.col("explanation").isNotNull(), HEADINGS[0])), _line(1, (1,), F.concat("explanation", F.lit("\n"))), *(_line(s, (0,), HEADINGS[s - 1]) for s in range(2, 7)),
        _line(2, (1,), NO_QUESTIONS, INSTEAD), *(_line(2, (1, k), x, BESIDE) for k, x in enumerate(TABLE_HEAD)), _line(2, (3,), "", BESIDE), _line(3, (1,), PAPERS % (0, 0, 0, 0), INSTEAD),
        _line(4, (1,), NO_LIMITS, INSTEAD), _line(5, (1,), NO_GAPS, INSTEAD), _line(6, (2,), ""),
    )

    last = coverage.groupBy("question_id").agg(F.max_by(F.struct("score", "unavailable", "quality", "saturation"), "round").alias("c"))
    q = questions.join(last, "question_id", "left").withColumn("n", F.expr("row_number() over (partition by task order by importance desc nulls last, question_id)"))
    score = F.when((F.coalesce("c.score", F.lit(0.0)) == 0) & (F.coalesce("c.unavailable", F.lit("")) != ""), F.format_string(UNAVAILABLE.replace("{}", "%s"), F.left("c.unavailable", F.lit(20)))).otherwise(_number(F.col("c.score")))
    cells = [F.replace(F.left(F.coalesce("question", F.lit("")), F.lit(60)), F.lit("|"), F.lit("/")), _number(F.col("importance")), F.coalesce(F.nullif("status", F.lit("")), F.lit(NONE)), score, _number(F.col("c.quality")), F.when(F.col("c").isNull(), NONE).otherwise(_word(F.col("c.saturation"), SATURATION, F.lit(NONE)))]
    asked = _lines(q, _line(2, (2, F.col("n")), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), OWN))

    by_role = F.array_join(F.transform("roles", lambda x: F.concat(x["role"], F.lit(": "), x["n"].cast("string"))), ROLES[1])
    counts = _lines(
        _papers(papers, roles, evidence), _line(3, (1,), F.format_string(PAPERS, "all", "scored", "high", "covered"), COUNTED), _line(3, (2,), F.when(F.col("all") > F.col("scored"), F.format_string(UNSCORED, F.col("all") - F.col("scored"))), COUNTED),
        _line(3, (3,), F.when(F.size("roles") > 0, F.concat(F.lit(ROLES[0]), by_role, F.lit(ROLES[2])))),
    )

    evidence = papers if evidence is None else evidence
    limits = evidence.where(F.col("type").isin(*LIMITING) & ~F.coalesce(F.col("status"), F.lit("")).isin(*DISMISSED)).withColumn("n", F.expr("row_number() over (partition by task order by evidence_id)")).where(F.col("n") <= min(TAKEN, SHOWN))
    limiting = _lines(limits, _line(4, (1, F.col("n")), F.concat(F.lit("- ["), "type", F.lit("] "), _flat(F.col("claim"), 150)), OWN), _line(4, (2,), F.when(F.col("n") == 1, "")))

    g = heads(gaps.where("status != 'superseded'"), "canonical", "version", "created").withColumn("n", F.expr("row_number() over (partition by task order by created, gap_id)"))
    of = {"all": "count(*)"} | {k: f"count_if(status = '{v}')" for k, v in (("s", "surviving"), ("r", "rejected"), ("i", "inconclusive"))}
    g = g.withColumns({k: F.expr(f"{v} over (partition by task)") for k, v in of.items()}).where(F.col("n") <= GAPS_SHOWN)
    # A gap's plans come as a list, so that its own lines are made once.
    shown = g.join(plans.groupBy("gap_id").agg(F.collect_list(F.struct(*(c for c, _, _ in PLAN))).alias("plans")), "gap_id", "left")
    first, survives, n = F.col("n") == 1, F.col("status") == "surviving", F.col("n")
    known = survives & (F.coalesce("nearest", F.lit("")) != "")
    head = F.concat(F.lit("- ["), _word(F.col("status"), STATUS, F.col("status")), F.lit("]["), F.when(F.col("complete"), TIERS[0]).otherwise(TIERS[1]), F.lit("]"), F.when(F.col("version") > 1, F.concat(F.lit(" v"), F.col("version").cast("string"))).otherwise(""), F.lit(" "), _flat(F.col("description"), 120))
    confidence = F.concat(F.lit(SEARCHED), _word(F.col("confidence"), CONFIDENCE, F.lit(UNKNOWN)), F.when(F.col("stability").isNotNull(), F.format_string(STABLE, F.bround("stability", 2))).otherwise(""), F.when(F.col("families").isNotNull(), F.format_string(FAMILIES, F.bround(F.col("families") * 100, 0))).otherwise(""))
    planned = F.flatten(F.transform(F.when(survives & F.col("plans").isNotNull(), F.col("plans")).otherwise(F.slice("plans", 1, 0)), lambda x: F.array(*(_line(5, (2, n, 4 + k), F.when(F.lit(always) | (F.coalesce(x[c], F.lit("")) != ""), F.concat(F.lit(f"  - {label}: "), _flat(x[c], 140)))) for k, (c, label, always) in enumerate(PLAN)))))
    candidates = _lines(
        shown, _line(5, (1,), F.when(first, F.format_string(GAPS, "all", "s", "r", "i", F.col("all") - F.col("s") - F.col("r") - F.col("i")))), _line(5, (2, n, 0), head, OWN),
        _line(5, (2, n, 1), F.when(known, F.concat(F.lit(PRIOR), "nearest"))), _line(5, (2, n, 2), F.when(known & (F.coalesce("residual", F.lit("")) != ""), F.concat(F.lit(RESIDUAL), _flat(F.col("residual"), 200)))), _line(5, (2, n, 3), F.when(known, confidence)),
        _line(5, (3,), F.when(first, "")), more=F.coalesce(planned, F.array().cast("array<struct<section int, place array<bigint>, line string, shown int>>")),
    )

    every = fixed
    for x in (asked, counts, limiting, candidates, _lines(steps, _line(6, (1, F.col("place")), F.concat(F.lit("- "), "step")))):
        every = every.unionByName(x)
    by = every.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("section", "place", "line", "shown"))).alias("l"))
    by = by.select("task", "l", F.array_distinct(F.transform(F.filter("l", lambda x: x["shown"].isin(OWN, COUNTED)), lambda x: x["section"])).alias("own"), F.exists("l", lambda x: x["section"] == 0).alias("named"))
    fits = lambda x: F.when(x["shown"] == BESIDE, F.array_contains("own", x["section"])).when(x["shown"] == INSTEAD, ~F.array_contains("own", x["section"])).when(x["shown"] == COUNTED, F.col("named")).otherwise(True)
    return by.select("task", F.array_join(F.transform(F.filter("l", fits), lambda x: x["line"]), "\n").alias("brief"))


def index_page(pages: DataFrame) -> DataFrame:
    """task, index: a wiki's index page by type in a fixed order, titles sorted, with the number of papers; tasks with no page but an index have none.

    pages: task, type, title, papers (array or null).
    """
    p = pages.where("type != 'index'")
    kinds = {t: k for k, t in enumerate(INDEX_TYPES)}
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), "type")
    line = F.concat(F.lit("- **"), "title", F.lit("** ("), F.greatest(F.size(F.coalesce("papers", F.array())), F.lit(0)).cast("string"), F.lit(" papers)"))
    listed = p.where(place.isNotNull()).select("task", place.alias("section"), F.concat(F.lit("1"), "title").alias("place"), line.alias("line"))
    tops = listed.select("task", "section").distinct().select("task", "section", F.lit("0").alias("place"), F.format_string("\n## %s\n", F.element_at(F.array(*map(F.lit, INDEX_TYPES.values())), F.col("section") + 1)).alias("line"))
    title = p.select("task").distinct().select("task", F.lit(-1).alias("section"), F.lit("0").alias("place"), F.lit("# Wiki Index\n").alias("line"))
    return assemble(title.unionByName(tops).unionByName(listed), "task", "index")


#: The head of a reference list, and the lines of an evidence block.
REFERENCES, NO_DOI = "## 参考文献\n", "N/A"
BLOCK = (("- Evidence ID: ", "evidence_id", ""), ("  Paper ID: ", "paper_id", ""), ("  Type: ", "type", ""), ("  Claim: ", "claim", ""), ("  Section: ", "section", "(unknown)"), ("  Conditions: ", "conditions", "(none)"), ("  Verification: ", "status", "unverified"))


def references(papers: DataFrame) -> DataFrame:
    """task, list: papers (task, place, title, year, doi) numbered from 1 in order of place."""
    numbered = papers.withColumn("n", F.expr("row_number() over (partition by task order by place)"))
    text = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    line = F.concat(F.lit("[P"), F.col("n").cast("string"), F.lit("] "), text("title", "None"), F.lit(" ("), text("year", "None"), F.lit("). DOI: "), F.coalesce(F.nullif(text("doi", ""), F.lit("")), F.lit(NO_DOI)))
    head = papers.select("task").distinct().select("task", F.lit(0).alias("section"), F.lit(0).alias("place"), F.lit(REFERENCES).alias("line"))
    return assemble(head.unionByName(numbered.select("task", F.lit(1).alias("section"), F.col("n").alias("place"), line.alias("line"))), "task", "list")


def evidence_block(evidence: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """task, block: what a judge is shown of evidence (task, place, evidence_id, paper_id, type, claim, section, conditions as JSON, status), with the questions that links (evidence_id, question_id) name, in order.

    Evidence may hold asked, an array of questions that its own row names; they count for all rows of that evidence_id.
    """
    fields = ["task", "place", *(c for _, c, _ in BLOCK)]
    named = F.filter(F.col("asked").cast("array<string>"), lambda q: q.isNotNull()) if "asked" in evidence.columns else F.array().cast("array<string>")
    rows = evidence.select("evidence_id", F.struct(*fields).alias("e"), named.alias("asked"))
    if links is not None:
        rows = rows.unionByName(links.where("question_id is not null").select("evidence_id", F.array(F.col("question_id").cast("string")).alias("asked")), allowMissingColumns=True)
    # Dealt before they are grouped: lists of single rows are wider than these.
    by = rows.repartition("evidence_id").groupBy("evidence_id").agg(F.collect_list("e").alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("asked")))).alias("q"))
    questions = F.when(F.col("evidence_id").isNotNull() & (F.size("q") > 0), F.array_join("q", ", ")).alias("questions")
    # The text is made where it ends, from the fields.
    shown = by.select(F.explode("e").alias("e"), questions).select("e.*", "questions").repartition("task").groupBy("task").agg(F.collect_list(F.struct(*fields[1:], "questions")).alias("l"))

    def entry(x):
        value = lambda c, other: F.coalesce(F.nullif(F.nullif(F.coalesce(x[c].cast("string"), F.lit("")), F.lit("")), F.lit("{}")), F.lit(other)) if other else F.coalesce(x[c].cast("string"), F.lit("None"))
        return F.concat_ws("\n", *(F.concat(F.lit(head), value(c, other)) for head, c, other in BLOCK), F.concat(F.lit("  Linked questions: "), x["questions"]))

    lines = F.array_sort(F.transform("l", lambda x: F.struct(x["place"].alias("place"), entry(x).alias("line"))))
    return shown.select("task", F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))
