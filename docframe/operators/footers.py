"""Visible text of parts replaced across text nodes, and the section tokens of footers, as relations.

Paragraphs and their text nodes are exploded; the text before a node is a running sum over the nodes of
its paragraph, so a match that spans nodes is cut at their offsets. Groups are the nodes of one paragraph
and the edits of one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import markup, text
from docframe.operators.context import running_sum, splice


def text_nodes(parts: DataFrame) -> DataFrame:
    """``file_key, part_name, paragraph, node, start, stop, seen``: content offsets in the part and visible text of each node."""
    paragraphs = parts.select("file_key", "part_name", F.posexplode(markup.block_spans(F.col("xml"), "w:p")).alias("paragraph", "p"))
    nodes = paragraphs.select("file_key", "part_name", "paragraph", F.col("p.start").alias("base"), F.posexplode(markup.block_spans(F.col("p.xml"), "w:t")).alias("node", "n"))
    opened = F.length(F.regexp_extract("n.xml", r"^(<w:t\b[^>]*>)", 1))
    content = F.regexp_extract("n.xml", r"^<w:t\b[^>]*>([\s\S]*)</w:t>$", 1)
    start = F.col("base") + F.col("n.start") + opened
    return nodes.select("file_key", "part_name", "paragraph", "node", start.alias("start"), (F.col("base") + F.col("n.stop") - len("</w:t>")).alias("stop"), markup.unescape(content).alias("seen"))


def replace_visible(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``parts(file_key, part_name, xml)`` with the first hit of each paragraph replaced.

    ``wanted(file_key, priority, old, new)``: of the texts that a paragraph contains, the one of least
    priority counts, at its first place. The new text goes into the node where the match begins,
    the others lose their share of it. Empty texts match nothing.
    """
    keys = ["file_key", "part_name", "paragraph"]
    nodes = text_nodes(parts)
    placed = running_sum(nodes, keys, "node", F.length("seen"), "offset")
    visible = splice(nodes, keys, "node", "seen")
    hits = visible.join(wanted.where("old <> ''").select("file_key", "priority", "old", "new"), "file_key").where(F.contains("seen", F.col("old")))
    at = (F.call_function("locate", F.col("old"), F.col("seen")) - 1).alias("at")
    hits = hits.groupBy(*keys).agg(F.min_by(F.struct(at, F.length("old").alias("size"), "new"), F.struct("priority", "old")).alias("hit"))
    first, last = F.col("hit.at"), F.col("hit.at") + F.col("hit.size")
    length = F.length("seen")
    touched = placed.join(hits, keys).where((F.col("offset") < last) & (F.col("offset") + length > first))
    a = F.greatest(first - F.col("offset"), F.lit(0)).cast("int")
    b = F.least(last - F.col("offset"), length).cast("int")
    new = F.when(F.col("offset") <= first, F.col("hit.new")).otherwise("")
    edited = F.concat(F.substring("seen", F.lit(1), a), new, F.substring(F.col("seen"), b + 1, length))
    edits = touched.select("file_key", "part_name", "start", "stop", markup.escape_attribute(edited).alias("text"))
    edits = edits.groupBy("file_key", "part_name").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "text"))).alias("edits"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state, edit):
        gap = F.substring(F.col("xml"), state["at"] + 1, edit["start"] - state["at"])
        return F.struct(F.concat(state["out"], gap, edit["text"]).alias("out"), edit["stop"].alias("at"))

    def finish(state):
        return F.concat(state["out"], F.substring(F.col("xml"), state["at"] + 1, F.length("xml")))

    patched = F.when(F.col("edits").isNotNull(), F.aggregate(F.coalesce("edits", F.array().cast("array<struct<start:int,stop:int,text:string>>")), begin, step, finish)).otherwise(F.col("xml"))
    return parts.join(edits, ["file_key", "part_name"], "left").select("file_key", "part_name", patched.alias("xml"))


def title_forms(tokens: DataFrame) -> DataFrame:
    """``file_key, priority, old, new``: the template's title in title case, in capitals and as it is, each with the document's title in that case."""
    forms = F.array(text.title_case(F.col("title")), F.upper("title"), F.col("title"))
    rows = tokens.where("title <> '' and new_title <> ''").select("file_key", "new_title", F.posexplode(forms).alias("priority", "old"))
    return rows.select("file_key", "priority", "old", text.apply_case(F.col("new_title"), text.case_pattern(F.col("old"))).alias("new"))


def number_forms(tokens: DataFrame) -> DataFrame:
    """``file_key, priority, old, new``: the section number with and without blanks."""
    pairs = F.array(F.struct(F.col("number").alias("old"), F.col("new_number").alias("new")), F.struct(F.replace("number", F.lit(" "), F.lit("")).alias("old"), F.replace("new_number", F.lit(" "), F.lit("")).alias("new")))
    return tokens.where("number <> '' and new_number <> ''").select("file_key", F.posexplode(pairs).alias("priority", "p")).select("file_key", "priority", "p.old", "p.new")


def patch_tokens(parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Footers with the title and number of the template replaced by those of the document.

    ``tokens(file_key, title, new_title, number, new_number)``, one row per file; a null or empty
    token replaces nothing.
    """
    return replace_visible(replace_visible(parts, title_forms(tokens)), number_forms(tokens))


def document_tokens(final: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``file_key, new_title, new_number``: title and number of each document, from the first paragraph of each role.

    ``final(file_key, paragraph_index, csi_role)``, ``paragraphs(file_key, paragraph_index, text)``.
    """
    rows = final.where(F.col("csi_role").isin("SectionID", "SectionTitle")).join(paragraphs, ["file_key", "paragraph_index"])
    first = lambda role: F.min_by(F.when(F.col("csi_role") == role, F.col("text")), F.when(F.col("csi_role") == role, F.col("paragraph_index")))
    found = rows.groupBy("file_key").agg(first("SectionTitle").alias("new_title"), first("SectionID").alias("section_id"))
    return found.select("file_key", "new_title", text.section_number(F.col("section_id")).alias("new_number"))
