"""The reads that a user of the evidence store calls: functions over its tables that return DataFrames.

Lists come in pages by key: `after` is the ordering values of the last row seen, so a page costs a filter and a bounded sort however far it is, and
rows that are added meanwhile neither repeat nor hide others.  Versioned rows are read at their latest version.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evloom.operators.ranking import heads

MOST = 200


def keyset(df: DataFrame, order: Sequence[tuple[str, bool]], after: Sequence | None = None, limit: int = 50) -> DataFrame:
    """The next rows in order behind the row with the values `after`. order: columns and whether they fall; nulls come last; together they must be unique."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    if after is not None:
        if len(after) != len(order):
            raise ValueError("after must have a value for each ordering column")
        beyond: Column = F.lit(False)
        for (c, falls), v in reversed(list(zip(order, after, strict=True))):
            col = F.col(c)
            # Behind a null there are only equal nulls; a null is behind every value.
            if v is None:
                beyond = col.isNull() & beyond
            else:
                beyond = (col < F.lit(v) if falls else col > F.lit(v)) | col.isNull() | ((col == F.lit(v)) & beyond)
        df = df.where(beyond)
    return df.orderBy(*(F.col(c).desc_nulls_last() if falls else F.col(c).asc_nulls_last() for c, falls in order)).limit(limit)


@dataclass(frozen=True)
class Reads:
    """Reads of one task over a function from a table's name to the table. A table has the columns that its read names; others are passed on."""

    table: Callable[[str], DataFrame]
    task: object

    def _of(self, name: str, **equal) -> DataFrame:
        df = self.table(name).where(F.col("task_id") == F.lit(self.task))
        for c, v in equal.items():
            if v is not None:
                df = df.where(F.col(c) == F.lit(v))
        return df

    def _paged(self, df: DataFrame, order: str, after, limit) -> DataFrame:
        return keyset(df, [(c.rstrip("-"), c.endswith("-")) for c in order.split()], after, limit)

    # Papers and pages
    def papers(self, priority=None, after=None, limit=50) -> DataFrame:
        """Best first; papers without a score last."""
        mine = self._of("task_papers", priority=priority)
        return self._paged(mine.join(self.table("papers"), "paper_id"), "final_score- paper_id", after, limit)

    def rounds(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("rounds"), "round_number round_id", after, limit)

    def wiki(self, page_type=None, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("wiki_pages", page_type=page_type), "page_type title page_id", after, limit)

    def wiki_stats(self) -> DataFrame:
        return self._of("wiki_pages").groupBy("page_type").agg(F.count("*").alias("pages"))

    # The contract and what belongs to it
    def contract(self) -> DataFrame:
        """The latest version."""
        return heads(self._of("contracts"), "task_id", "version", "contract_id")

    def questions(self, after=None, limit=50) -> DataFrame:
        """Those of the latest contract, most important first."""
        return self._paged(self._of("questions").join(self.contract().select("contract_id"), "contract_id", "left_semi"), "importance- question_id", after, limit)

    def evidence(self, paper_id=None, evidence_type=None, status=None, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("evidence", paper_id=paper_id, evidence_type=evidence_type, verification_status=status), "evidence_id", after, limit)

    def evidence_item(self, evidence_id) -> DataFrame:
        return self._of("evidence", evidence_id=evidence_id)

    def coverage(self) -> DataFrame:
        """The last round of each question."""
        return heads(self._of("coverage"), "question_id", "round_number", "coverage_id")

    def paper_roles(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("paper_roles"), "paper_id role", after, limit)

    def phases(self) -> DataFrame:
        return self._paged(self._of("phases"), "started_at phase_id", None, MOST)

    # Gaps
    def gaps(self, status=None, after=None, limit=50) -> DataFrame:
        """The latest version of each canonical gap that isn't superseded."""
        latest = heads(self._of("gaps").where("status != 'superseded'"), "canonical_gap_id", "version", "created_at")
        return self._paged(latest if status is None else latest.where(F.col("status") == status), "created_at gap_id", after, limit)

    def gap(self, gap_id) -> DataFrame:
        return self._of("gaps", gap_id=gap_id)

    def _by_gap(self, name: str, gap_id) -> DataFrame:
        return self.table(name).join(self.gap(gap_id).select("gap_id"), "gap_id", "left_semi")

    def gap_evidence(self, gap_id, after=None, limit=50) -> DataFrame:
        return self._paged(self._by_gap("gap_evidence", gap_id).join(self._of("evidence").drop("task_id"), "evidence_id"), "evidence_id", after, limit)

    def gap_audits(self, gap_id, after=None, limit=50) -> DataFrame:
        """Last first."""
        return self._paged(self._by_gap("gap_audits", gap_id), "created_at- audit_id", after, limit)

    def gap_neighbors(self, gap_id, after=None, limit=50) -> DataFrame:
        return self._paged(self._by_gap("gap_neighbors", gap_id), "relevance- paper_id", after, limit)

    # Results
    def interventions(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("interventions"), "created_at intervention_id", after, limit)

    def ideas(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("ideas"), "score- idea_id", after, limit)

    def experiments(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("experiments"), "created_at experiment_id", after, limit)

    def export(self) -> DataFrame:
        """Every experiment as a line of JSON, in order."""
        e = self._of("experiments")
        return e.orderBy("created_at", "experiment_id").select("experiment_id", F.to_json(F.struct(*sorted(e.columns))).alias("json"))

    def report(self, kind=None) -> DataFrame:
        """The last report, of a kind if one is named."""
        return self._paged(self._of("reports", report_type=kind), "created_at- report_id", None, 1)

    def traces(self, step=None, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("traces", step=step), "created_at trace_id", after, limit)

    def events(self, after=None, limit=50) -> DataFrame:
        return self._paged(self._of("events"), "seq", after, limit)
