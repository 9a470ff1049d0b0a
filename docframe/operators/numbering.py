"""Numbering of templates imported into packages, as relations over any number of packages and templates.

A plan is made of four relations: the abstract definitions and the numbers that each package gets,
the numbers of its styles, and what is wrong. Packages with a violation get nothing. All groups are the
definitions of one package; everything else is joins, ranks and column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.functions import ids, markup

# Fixed value: an empty numbering part.
EMPTY = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">\n</w:numbering>'


@dataclass
class Plan:
    """``abstracts`` and ``nums`` (file_key, old_id, new_id, xml; nums also abstract_id), ``styles`` (file_key, style_id, old_id, new_id), ``violations`` (file_key, rule, item, styles)."""

    abstracts: DataFrame
    nums: DataFrame
    styles: DataFrame
    violations: DataFrame


def style_numbers(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, style_id, num_id`` of style blocks ``(keys, pos, style_id, xml)``; the last block of an id counts."""
    last = blocks.groupBy(*keys, "style_id").agg(F.max_by("xml", "pos").alias("xml"))
    number = markup.attribute(F.col("xml"), "w:numId")
    return last.where(number.rlike("^[0-9]+$")).select(*keys, "style_id", number.cast("int").alias("num_id"))


def _ids(xml: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def taken(targets: DataFrame) -> DataFrame:
    """Per package the greatest ids of its numbering part (-1 and 0 if there is none) and the hashes in use."""
    values = lambda pattern: F.regexp_extract_all("xml", F.lit(pattern), F.lit(1))
    return targets.select(
        "file_key",
        F.coalesce(F.array_max(_ids(F.col("xml"), r'w:abstractNumId="([0-9]+)"')), F.lit(-1)).alias("top_abstract"),
        F.coalesce(F.array_max(_ids(F.col("xml"), r'<w:num\s[^>]*w:numId="([0-9]+)"')), F.lit(0)).alias("top_num"),
        values(r'<w:nsid\s+w:val="([^"]+)"').alias("nsids"),
        values(r'w16cid:durableId="([^"]+)"').alias("durable_ids"),
    )


def _with_attribute(xml: Column, name: str, old: Column, new: Column) -> Column:
    quoted = lambda v: F.concat(F.lit(f'{name}="'), v.cast("string"), F.lit('"'))
    return F.replace(xml, quoted(old), quoted(new))


def plan(usage: DataFrame, nums: DataFrame, abstracts: DataFrame, targets: DataFrame) -> Plan:
    """New ids for what the styles use: consecutive behind the package's own, in the order of the old ids.

    ``usage(file_key, template_key, style_id, num_id)``, ``nums(template_key, num_id, abstract_id, xml)``,
    ``abstracts(template_key, abstract_id, xml)``, ``targets(file_key, xml)``: the numbering parts.
    Rules of violations: ``no_numbering_part``, ``unknown_num``, ``unknown_abstract``, each with the
    styles that ask for it.
    """
    usage = usage.select("file_key", "template_key", "style_id", "num_id").distinct()
    by_num = usage.join(nums.select("template_key", "num_id", "abstract_id", F.col("xml").alias("num_xml")), ["template_key", "num_id"], "left")
    linked = by_num.join(abstracts.select("template_key", "abstract_id", F.col("xml").alias("abstract_xml")), ["template_key", "abstract_id"], "left")
    linked = linked.join(taken(targets), "file_key", "left")
    rule = (
        F.when(F.col("top_num").isNull(), "no_numbering_part").when(F.col("num_xml").isNull(), "unknown_num").when(F.col("abstract_xml").isNull(), "unknown_abstract")
    )
    item = F.when(rule == "unknown_abstract", F.col("abstract_id")).otherwise(F.col("num_id"))
    wrong = linked.where(rule.isNotNull()).groupBy("file_key", rule.alias("rule"), item.alias("item")).agg(F.array_sort(F.collect_set("style_id")).alias("styles"))
    sound = linked.join(wrong.select("file_key").distinct(), "file_key", "left_anti")

    in_order = lambda c: F.row_number().over(Window.partitionBy("file_key").orderBy(c))
    made = sound.select("file_key", "abstract_id", "abstract_xml", "top_abstract", "nsids").distinct().withColumn("new_id", F.col("top_abstract") + in_order("abstract_id"))
    fresh = F.concat(F.lit('<w:nsid w:val="'), ids.free_hash(F.col("abstract_xml"), F.col("nsids")), F.lit('"/>'))
    xml = F.regexp_replace(_with_attribute(F.col("abstract_xml"), "w:abstractNumId", F.col("abstract_id"), F.col("new_id")), F.lit(r'<w:nsid\s+w:val="[^"]*"/>'), fresh)
    made_abstracts = made.select("file_key", F.col("abstract_id").alias("old_id"), "new_id", xml.alias("xml"))

    numbers = sound.select("file_key", "num_id", "abstract_id", "num_xml", "top_num", "durable_ids").distinct().withColumn("new_id", F.col("top_num") + in_order("num_id"))
    numbers = numbers.join(made_abstracts.select("file_key", F.col("old_id").alias("abstract_id"), F.col("new_id").alias("new_abstract")), ["file_key", "abstract_id"])
    refers = F.concat(F.lit(r'(<w:abstractNumId\s+w:val=")'), F.col("abstract_id").cast("string"), F.lit('"'))
    durable = ids.free_hash(F.col("num_xml"), F.col("durable_ids"), make=lambda x: ids.durable_id(x).cast("string"))
    xml = F.regexp_replace(_with_attribute(F.col("num_xml"), "w:numId", F.col("num_id"), F.col("new_id")), refers, F.concat(F.lit("$1"), F.col("new_abstract").cast("string"), F.lit('"')))
    xml = F.regexp_replace(xml, F.lit(r'w16cid:durableId="[^"]*"'), F.concat(F.lit('w16cid:durableId="'), durable, F.lit('"')))
    made_nums = numbers.select("file_key", F.col("num_id").alias("old_id"), "new_id", F.col("new_abstract").alias("abstract_id"), xml.alias("xml"))
    renumbered = sound.select("file_key", "style_id", F.col("num_id").alias("old_id")).join(made_nums.select("file_key", "old_id", "new_id"), ["file_key", "old_id"])
    return Plan(made_abstracts, made_nums, renumbered.select("file_key", "style_id", "old_id", "new_id"), wrong)


def before_last(xml: Column, mark: str, text: Column) -> Column:
    """``text`` put before the last ``mark``; null if there is none."""
    behind = F.substring_index(xml, mark, -1)
    kept = F.length(xml) - F.length(behind) - len(mark)
    return F.when(F.contains(xml, F.lit(mark)), F.concat(F.substring(xml, F.lit(1), kept), text, F.lit(mark), behind))


def inject(targets: DataFrame, made: Plan) -> DataFrame:
    """``file_key, xml, error``: the numbering parts of the planned packages with their new definitions.

    Abstract definitions stand before the first number, numbers at the end. ``error`` names a part
    that is not closed or a number whose abstract definition is missing; its xml is null.
    """

    def joined(rows: DataFrame, name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct("new_id", "xml")))
        return rows.groupBy("file_key").agg(F.concat(F.array_join(F.transform(held, lambda x: x["xml"]), "\n"), F.lit("\n")).alias(name), F.array_sort(F.collect_set("new_id")).alias(f"{name}_ids"))

    refers = made.nums.groupBy("file_key").agg(F.collect_set("abstract_id").alias("referred"))
    rows = targets.select("file_key", "xml").join(joined(made.abstracts, "abstracts"), "file_key").join(joined(made.nums, "nums"), "file_key").join(refers, "file_key")
    first = F.regexp_instr("xml", F.lit(r"<w:num\s"))
    opened = F.when(first > 0, F.concat(F.left("xml", first - 1), "abstracts", F.substring(F.col("xml"), first, F.length("xml")))).otherwise(before_last(F.col("xml"), "</w:numbering>", F.col("abstracts")))
    rows = rows.withColumn("xml", opened)
    rows = rows.withColumn("xml", before_last(F.col("xml"), "</w:numbering>", F.col("nums")))
    have = _ids(F.col("xml"), r'<w:abstractNum\b[^>]*w:abstractNumId="([0-9]+)"')
    lost = F.array_except("referred", have)
    error = F.when(F.col("xml").isNull(), "the numbering part is not closed").when(F.size(lost) > 0, F.concat(F.lit("numbers refer to missing abstract definitions "), F.array_join(F.array_sort(lost), ", ")))
    return rows.select("file_key", F.when(error.isNull(), F.col("xml")).alias("xml"), error.alias("error"))
