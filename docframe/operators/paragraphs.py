"""From document parts to enriched, filtered and partly classified paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import markup, text
from docframe.operators.context import CONTEXT_CHARS, PREVIEW_CHARS, TEXT_CHARS, neighbours
from docframe.session import cut


@dataclass
class Analysis:
    """``enriched``: kept rows with role and context; ``filter_report``: what was removed or stripped."""

    enriched: DataFrame
    filter_report: DataFrame

    @property
    def deterministic(self) -> DataFrame:
        return self.enriched.where("csi_role is not null").select("file_key", "paragraph_index", "csi_role")

    @property
    def unresolved(self) -> DataFrame:
        """Rows for the classifier: outside tables and without a rule role."""
        return self.enriched.where("csi_role is null and not in_table")


def analyse(documents: DataFrame, available_roles: list[str] | None = None, hints: bool = True) -> Analysis:
    """Analyse ``documents(file_key, xml)``, one document part per file.

    Paragraph blocks are numbered in document order. Blocks with a section break and blocks without
    text are dropped; text is cleaned; what cleaning empties is reported if a rule hit. End-of-section
    lines are dropped and reported unless their role is available. Context and the title rule see
    the kept rows, table rows included, and run over blocks of a file. Without ``hints`` the columns
    ``ppr_hints``, ``rpr_hints`` and ``num_pr`` are left out.
    """
    roles = available_roles or text.ROLES
    allowed = F.array(*map(F.lit, roles))
    rows = markup.paragraph_rows(documents, hints)
    if hints:
        xml = F.col("xml")
        rows = rows.select("*", markup.layout_hints(xml).alias("ppr_hints"), markup.run_hints(xml).alias("rpr_hints"), markup.numbering(xml).alias("num_pr")).drop("xml")
    # Written once: what follows filters on texts that Python and the rules made, which would run again for each reference.
    rows = cut(rows.withColumn("clean", text.strip_boilerplate(F.col("raw_text")))).where("raw_text <> ''")
    clean = rows.select("*", F.col("clean.text").alias("clean_text"), "clean.tags").drop("clean")
    ends = F.col("clean_text").rlike(text.END_OF_SECTION) & F.lit("END_OF_SECTION" not in (available_roles or []))
    action = F.when(F.col("clean_text") == "", "removed").when(ends, "removed").when(F.size("tags") > 0, "stripped")
    judged = clean.withColumn("action", action).withColumn("gone", (F.col("clean_text") == "") | ends)
    report = judged.where("action is not null and (size(tags) > 0 or clean_text <> '')").select(
        "file_key",
        "paragraph_index",
        "action",
        F.when((F.col("clean_text") != "") & F.col("gone"), F.array(F.lit("end_of_section_no_role"))).otherwise(F.col("tags")).alias("tags"),
        F.when(F.col("action") == "removed", F.substring("raw_text", 1, PREVIEW_CHARS)).alias("preview"),
    )
    kept = judged.where(~F.col("gone")).select(
        "file_key",
        "paragraph_index",
        F.substring("clean_text", 1, TEXT_CHARS).alias("text"),
        "p_style",
        *(("ppr_hints", "rpr_hints") if hints else ()),
        "in_table",
        text.marker_type(F.col("clean_text"), F.col("num_id")).alias("marker_type"),
        *(("num_pr",) if hints else ()),
    )
    seen = neighbours(kept, ["file_key"], "paragraph_index", F.col("text"))
    head = lambda c: F.coalesce(F.substring(c, 1, CONTEXT_CHARS), F.lit(""))
    role = text.rule_role(F.col("text"), F.col("marker_type"), F.col("before"), F.col("in_table"))
    placed = seen.withColumn("rule_role", role).withColumn("prev_text", head("before")).withColumn("next_text", head("after")).drop("before", "after")
    return Analysis(placed.withColumn("csi_role", text.available_role(F.col("rule_role"), allowed)), report)
