"""From packages and final classifications to patched packages, one task group per package.

A group is the parts of one package and its classifications: bounded by the package, as the archive
itself is. Everything that relates packages or catalogues to each other stays relational.
"""

from __future__ import annotations

import difflib
import json
import re
import time
import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions import edit, markup, text
from docframe.operators import batches, environment, footers, numbering
from docframe.operators.classify import Classifier, classify_chunks, merge_chunks
from docframe.operators.paragraphs import Analysis, analyse
from docframe.operators.relational import compare_maps, missing_from_bag, raise_if_any
from docframe.operators.styles import Sheet, has_layout, import_styles, style_blocks
from docframe.session import cut, cut_counted, each_group
from docframe.sources import docx, registry

Parts = dict[str, bytes]
DOCUMENT, STYLES, NUMBERING = "word/document.xml", "word/styles.xml", "word/numbering.xml"


@dataclass(frozen=True)
class Config:
    """The template side of a run; small contracts, read once and sent to every task."""

    roles: dict[str, str]
    available: list[str] | None
    template: dict
    sheet: str
    tokens: dict[str, str] = field(default_factory=dict)
    raw_settings: str | None = None


def load_config(spark, folder: str, raw_styles: str | None = None, raw_settings: str | None = None) -> Config:
    """Read and check both contracts; any violation stops here, before anything is changed.

    Raw style and settings parts beside the contracts count unless others are given.
    """
    root = registry.contract_root(folder)
    roles, template = registry.role_styles(spark, root), registry.template(spark, root)
    registry.check(template, roles)
    return Config(
        {r.role: r.style_id for r in roles.collect()},  # a row per role
        registry.available_roles(spark, root),
        template.first().asDict(recursive=True),
        registry.template_sheet(template, raw_styles or registry.raw_part(spark, root, registry.RAW_STYLES)),
        registry.source_tokens(spark, root),
        raw_settings or registry.raw_part(spark, root, registry.RAW_SETTINGS),
    )


@dataclass
class Report:
    requested: int = 0
    modified: int = 0
    skipped_sections: int = 0
    stripped_layout: int = 0
    kept_layout: int = 0


def block_spans(xml: str) -> list[tuple[int, int]]:
    """Paragraph blocks as the analysis numbers them: from an opening to the next closing tag."""
    out, at = [], 0
    for opened in iter(lambda: markup_open(xml, at), None):
        close = xml.find("</w:p>", opened)
        if close < 0:
            break
        at = close + len("</w:p>")
        out.append((opened, at))
    return out


def markup_open(xml: str, at: int) -> int | None:
    """Start of the next paragraph tag, self-closing ones included."""
    while (found := xml.find("<w:p", at)) >= 0:
        if found + 4 < len(xml) and not (xml[found + 4].isalnum() or xml[found + 4] == "_"):
            return found
        at = found + 4
    return None


def plan_numbers(targets: DataFrame, final: DataFrame, config: Config) -> numbering.Plan:
    """The numbering that the styles of each package's classifications use, from the template; ``targets(file_key, xml)`` are the numbering parts."""
    spark = targets.sparkSession
    roles = spark.createDataFrame(list(config.roles.items()), "csi_role string, style_id string")
    sheet = spark.createDataFrame([("", config.sheet)], "template_key string, xml string")
    used = numbering.style_numbers(style_blocks(sheet, ["template_key"]), ["template_key"])
    usage = final.join(roles, "csi_role").select("file_key", "style_id").distinct().join(used, "style_id")
    contract = spark.createDataFrame([("", json.dumps({"numbering": config.template.get("numbering")}))], "template_key string, json string")
    template = contract.select("template_key", registry.parsed(F.col("json"), registry.TEMPLATE_SCHEMA).alias("j")).select("template_key", "j.*")
    return numbering.plan(usage, *registry.numbering_rows(template, ["template_key"]), targets)


def apply_roles(xml: str, styles: Sheet, roles: dict[str, str], classes: list[tuple[int, str]]) -> tuple[str, Report]:
    """Every classified paragraph under its style; fails on bad indices, unmapped roles and missing styles, all named."""
    spans, report, edits, bad = block_spans(xml), Report(requested=len(classes)), {}, []
    for index, role in classes:
        if index is None or not 0 <= index < len(spans):
            bad.append(f"index {index}")
        elif role not in roles:
            bad.append(f"role {role} of paragraph {index}")
        elif roles[role] not in styles.last:
            bad.append(f"style {roles[role]}")
        else:
            block = xml[slice(*spans[index])]
            if "<w:sectPr" in block:
                report.skipped_sections += 1
                continue
            layout = has_layout(styles.last[roles[role]])
            edits[index] = edit.restyle(block, roles[role], layout)
            report.modified += 1
            report.stripped_layout += layout
            report.kept_layout += not layout
    if bad:
        raise ValueError(f"cannot apply: {list(dict.fromkeys(bad))[:20]}")
    if report.modified != report.requested - report.skipped_sections:
        raise ValueError(f"applied {report.modified} of {report.requested - report.skipped_sections}")
    out, at = [], 0
    for i, (a, b) in enumerate(spans):
        out += xml[at:a], edits.get(i, xml[a:b])
        at = b
    return "".join(out) + xml[at:], report


def snapshot(parts: Parts) -> dict[str, bytes]:
    """What applying roles must not touch: headers, footers, section properties, document relationships."""
    held = {n: c for n, c in parts.items() if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")}
    xml = environment.read(parts, DOCUMENT)
    held["(sections)"] = "\n".join(edit.outer(xml, s) for s in environment.paired_sections(xml)).encode()
    held["(relationships)"] = parts.get(environment.RELS_PART, b"")
    return held


@lru_cache(maxsize=4)
def _template_sheet(xml: str) -> Sheet:
    """The template's sheet, read once per worker."""
    return Sheet(xml)


def process_package(parts: Parts, classes: list[tuple[int, str]], config: Config, numbers: dict[str, tuple[int, int]]) -> tuple[Parts, Report, list[str]]:
    """The package in the template's styles and environment, its report and its log."""
    parts, sheet = dict(parts), _template_sheet(config.sheet)
    log = environment.apply_environment(parts, config.template, config.raw_settings)
    needed = sorted({config.roles[r] for _, r in classes if r in config.roles})
    styles, done = import_styles(environment.read(parts, STYLES), sheet, needed, numbers)
    environment.write(parts, STYLES, styles)
    log.append(f"styles: {sum(a in ('insert', 'replace') for a in done.values())} of {len(done)} written, {len(numbers)} numbered")
    before = snapshot(parts)
    document, report = apply_roles(environment.read(parts, DOCUMENT), Sheet(styles), config.roles, classes)
    environment.write(parts, DOCUMENT, document)
    if changed := [n for n, c in snapshot(parts).items() if before.get(n) != c]:
        raise ValueError(f"applying roles changed {changed}")
    log.append(f"applied: {report.modified} of {report.requested - report.skipped_sections} paragraphs")
    return parts, report, log


_BLOCK = re.compile(r"<w:p\b[\s\S]*?</w:p>", re.ASCII)
RESULT = "file_key string, kind string, part_name string, content binary, success boolean, error string, log array<string>, modified int, requested int, duration_seconds double"


def apply(parts: DataFrame, final: DataFrame, config: Config) -> DataFrame:
    """``RESULT`` rows of every package: its changed and new parts (kind part), the parts to leave out (kind gone), paragraphs that changed by more than an edit may (kind breach), one row of kind result.

    A package that fails keeps no parts and says why; others are not affected.
    """
    numbered = cut(docx.part_text(parts, NUMBERING))  # the plan looks at these parts again and again
    planned = plan_numbers(numbered, final, config)
    injected = numbering.inject(numbered, planned)
    columns = {"paragraph_index": "int", "csi_role": "string", "style_id": "string", "old_id": "int", "new_id": "int", "xml": "string", "problem": "string"}

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select("file_key", *((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))

    # One line per fact about a package: its classifications, the numbers of its styles, its numbering part, what is wrong.
    wrong = planned.violations.select("file_key", F.format_string("numbering: %s %s for styles %s", "rule", F.col("item").cast("string"), F.array_join("styles", ", ")).alias("problem"))
    facts = shaped(final).unionByName(shaped(planned.styles)).unionByName(shaped(injected.withColumnRenamed("error", "problem"))).unionByName(shaped(wrong))

    def run(rows: list[dict]) -> list[tuple]:
        package, told = [r for r in rows if r["is_part"]], [r for r in rows if not r["is_part"]]
        if not package:
            return []
        key, began = rows[0]["file_key"], time.perf_counter()
        old = {r["part_name"]: r["content"] for r in package if r["part_name"] and r["part_name"] != docx.COMMENT}
        classes = sorted((r["paragraph_index"], r["csi_role"]) for r in told if r["csi_role"] is not None)
        out: list[tuple] = []
        try:
            if broken := [r["error"] for r in package if r["error"] is not None]:
                raise ValueError(broken[0])
            if problems := sorted(r["problem"] for r in told if r["problem"] is not None):
                raise ValueError("; ".join(problems))
            held = dict(old)
            for xml in (r["xml"] for r in told if r["xml"] is not None):
                held[NUMBERING] = xml.encode("utf-8")
            numbers = {r["style_id"]: (r["old_id"], r["new_id"]) for r in told if r["style_id"] is not None}
            new, report, log = process_package(held, classes, config, numbers)
            out += ((key, "part", name, content, None, None, None, None, None, None) for name, content in new.items() if old.get(name) != content)
            out += ((key, "gone", name, None, None, None, None, None, None, None) for name in old if name not in new)
            out += ((key, "breach", DOCUMENT, None, None, breach, None, None, None, None) for breach in breaches(old.get(DOCUMENT, b""), new.get(DOCUMENT, b"")))
            out.append((key, "result", None, None, True, None, log, report.modified, report.requested, time.perf_counter() - began))
        except Exception as error:
            out = [(key, "result", None, None, False, str(error) or type(error).__name__, [traceback.format_exc(limit=-1)], 0, len(classes), time.perf_counter() - began)]
        return out

    held = parts.select("file_key", F.lit(True).alias("is_part"), "ordinal", "part_name", "content", "error")
    rows = held.unionByName(facts.withColumn("is_part", F.lit(False)), allowMissingColumns=True)
    return each_group(rows, ["file_key"], [F.col("ordinal")], run, RESULT)


def breaches(before: bytes, after: bytes) -> Iterator[str]:
    """What :func:`contract_violations` says of one document, that of a package at hand."""
    if before == after:
        return
    olds, news = ([m[0] for m in _BLOCK.finditer(x.decode("utf-8"))] for x in (before, after))
    for i, (a, b) in enumerate(zip_longest(olds, news)):
        if a != b and "<w:sectPr" not in (a or "") and "<w:sectPr" not in (b or ""):
            was, now = (None if x is None else markup.contract_form_of(x) for x in (a, b))
            if was != now:
                yield f"paragraph {i} changed: {difference(was or '', now)}"


def analyse_packages(parts: DataFrame, config: Config) -> Analysis:
    got = analyse(docx.part_text(parts, DOCUMENT), config.available, hints=False)
    return Analysis(cut(got.enriched), got.filter_report)  # ruled and open rows are read from it, several times


def classify_packages(analysis: Analysis, config: Config, classifier: Classifier | None = None) -> DataFrame:
    """Rule roles and the classifier's roles of the open rows, asked in chunks with the texts around each row."""
    rows = analysis.unresolved.select("file_key", "paragraph_index", "text", "prev_text", "next_text", "marker_type", "p_style")
    labelled = classify_chunks(batches.chunked(rows), config.available or list(config.roles), classifier)
    return analysis.deterministic.unionByName(merge_chunks(labelled, ["file_key", "paragraph_index"]))


def patched_footers(parts: DataFrame, replacements: DataFrame, gone: DataFrame, final: DataFrame, config: Config) -> DataFrame:
    """``file_key, part_name, content``: the footers that hold tokens of the template, with those of the document."""
    keys = ["file_key", "part_name"]
    footer = F.col("part_name").rlike(r"^word/footer[^/]*\.xml$")
    kept = parts.where(footer).select(*keys, "content").join(replacements.select(*keys).unionByName(gone.select(*keys)), keys, "left_anti")
    rows = kept.unionByName(replacements.where(footer).select(*keys, "content")).select(*keys, F.decode("content", "UTF-8").alias("xml"))
    paragraphs = markup.explode_blocks(docx.part_text(parts, DOCUMENT), "xml", "w:p", "paragraph_index").select("file_key", "paragraph_index", markup.block_text(F.col("block")).alias("text"))
    title, number = config.tokens.get("SectionTitle") or "", config.tokens.get("SectionID_numeric")
    number = F.lit(number) if number else text.section_number(F.lit(config.tokens.get("SectionID") or ""))
    tokens = footers.document_tokens(final, paragraphs).withColumn("title", F.lit(title)).withColumn("number", number)
    changed = footers.patch_tokens(rows, tokens).withColumnRenamed("xml", "new").join(rows, keys).where("new <> xml")
    return changed.select(*keys, F.encode("new", "UTF-8").alias("content"))


def run_batch(
    spark, folder: str, contracts: str, out: str, classifier: Classifier | None = None, strict: bool = False, progress: Callable[[str, dict[str, int]], None] | None = None
) -> DataFrame:
    """Process all packages of a folder into ``out``; one row per package, by key.

    Gives ``file_key, source, success, error, log, modified, requested, duration_seconds, path, n_bytes``.
    A package fails alone: by an archive that cannot be read, by a step, by a part that must not be
    patched or is not well-formed, or by a paragraph that changed by more than an edit may. Only
    packages without any such problem are written. ``strict`` writes nothing unless every package
    succeeds. ``progress`` is told the counts of each stage, observed while the stage runs.
    """
    tell = progress or (lambda stage, counts: None)
    config = load_config(spark, contracts)
    parts, counts = cut_counted(docx.read_packages(spark, folder), parts=F.count(F.lit(1)), unreadable=F.count("error"))
    tell("read", counts)
    final, counts = cut_counted(classify_packages(analyse_packages(parts, config), config, classifier), paragraphs=F.count(F.lit(1)))
    tell("classify", counts)
    done, counts = cut_counted(apply(parts, final, config), packages=F.count_if(F.col("kind") == "result"), failed=F.count_if(~F.col("success")), modified=F.sum("modified"))
    tell("apply", counts)
    keys = ["file_key", "part_name"]
    made, gone = done.where("kind = 'part'").select(*keys, "content"), done.where("kind = 'gone'").select(*keys)
    if config.tokens:
        footed = cut(patched_footers(parts, made, gone, final, config))
        made = made.join(footed.select(*keys), keys, "left_anti").unionByName(footed)
    problems = docx.patch_violations(made, gone).select("file_key", "error").unionByName(done.where("kind = 'breach'").select("file_key", "error"))
    problems = cut(problems.groupBy("file_key").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("problem")))
    results = done.where("kind = 'result'").drop("kind", "part_name", "content").join(problems, "file_key", "left")
    results = results.withColumn("success", F.col("success") & F.col("problem").isNull()).withColumn("error", F.coalesce("error", "problem")).drop("problem")
    results = cut(parts.groupBy("file_key").agg(F.min("path").alias("source")).join(results, "file_key"))
    if strict:
        raise_if_any(results.where("not success").select("file_key", "error"), "packages failed")
    good = results.where("success").select("file_key")
    only_good = lambda rows: rows.join(good, "file_key", "left_semi")
    written, counts = cut_counted(docx.write_packages(docx.patch_packages(only_good(parts), only_good(made), only_good(gone), check=False), out), packages=F.count(F.lit(1)), n_bytes=F.sum("n_bytes"))
    tell("write", counts)
    return results.join(written, "file_key", "left").orderBy("file_key")


def contract_violations(parts: DataFrame, made: DataFrame) -> DataFrame:
    """``file_key, error`` of the paragraphs without section properties that changed by more than an edit may, with their difference."""
    changes = contract_changes(docx.part_text(parts, DOCUMENT), docx.part_text(made, DOCUMENT).select("file_key", "xml"))
    touched = changes.join(made.where(F.col("part_name") == DOCUMENT).select("file_key"), "file_key", "left_semi")
    section = lambda c: F.coalesce(F.contains(c, F.lit("<w:sectPr")), F.lit(False))
    differs = edit.column(difference, 2)(F.coalesce("before", F.lit("")), "after")
    return touched.where(~section(F.col("before")) & ~section(F.col("after"))).select("file_key", F.format_string("paragraph %d changed: %s", "idx", differs).alias("error"))


def contract_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paragraphs that differ by more than an edit may change: ``file_key, idx`` with both forms."""
    forms = [markup.explode_blocks(d.select("file_key", "xml"), "xml", "w:p").select("file_key", "idx", markup.contract_form(F.col("block")).alias("form")) for d in (before, after)]
    return compare_maps(forms[0], forms[1], ["file_key", "idx"], "form")


def stability_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Header and footer parts whose content differs between two states of packages: ``file_key, part_name, before, after, change``, contents as hashes."""
    held = lambda parts: parts.where(F.col("part_name").rlike(r"^word/(header|footer)[^/]*\.xml$")).select("file_key", "part_name", F.sha2("content", 256).alias("digest"))
    return compare_maps(held(before), held(after), ["file_key", "part_name"], "digest")


def difference(before: str, after: str | None, most: int = 4000) -> str:
    """A unified diff of two forms, cut at ``most`` characters."""
    lines = difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), "before", "after", lineterm="")
    return "\n".join(lines)[:most]


def output_violations(before: DataFrame, after: DataFrame, after_parts: DataFrame, expected_parts: list[str] | None = None) -> DataFrame:
    """``file_key, rule, item``: section properties or run formatting lost, references without relationship, wrong set of header and footer parts.

    ``before`` and ``after`` hold the document parts as ``file_key, xml``. The part set is only checked
    where headers and footers were imported.
    """
    section = lambda d: markup.explode_blocks(d.select("file_key", "xml"), "xml", "w:sectPr").select("file_key", "idx", markup.section_form(F.col("block")).alias("form"))
    sections = compare_maps(section(before), section(after), ["file_key", "idx"], "form").select("file_key", F.lit("section").alias("rule"), F.col("idx").cast("string").alias("item"))
    run = lambda d: markup.explode_blocks(d.select("file_key", "xml"), "xml", "w:rPr").select("file_key", markup.run_form(F.col("block")).alias("form")).where("form not in ('', '<w:rPr></w:rPr>')")
    runs = missing_from_bag(run(before), run(after), ["file_key", "form"]).select("file_key", F.lit("run_formatting").alias("rule"), F.col("form").alias("item"))
    refs = after.select("file_key", F.explode(F.regexp_extract_all("xml", F.lit(r'<w:(?:header|footer)Reference\b[^>]*\br:id="([^"]+)"'), F.lit(1))).alias("item")).distinct()
    ids = docx.part_text(after_parts, environment.RELS_PART).select("file_key", F.explode(F.regexp_extract_all("xml", F.lit(r'<Relationship\b[^>]*\sId="([^"]+)"'), F.lit(1))).alias("item"))
    dangling = refs.join(ids, ["file_key", "item"], "left_anti").select("file_key", F.lit("reference").alias("rule"), "item")
    out = sections.unionByName(runs).unionByName(dangling)
    if expected_parts is not None:
        have = after_parts.where(F.col("part_name").rlike(r"^word/(header|footer)[^/]*\.xml$")).select("file_key", F.col("part_name").alias("item"))
        want = after.select("file_key", F.explode(F.array(*map(F.lit, expected_parts))).alias("item"))
        out = out.unionByName(have.join(want, ["file_key", "item"], "left_anti").select("file_key", F.lit("extra_part").alias("rule"), "item"))
        out = out.unionByName(want.join(have, ["file_key", "item"], "left_anti").select("file_key", F.lit("missing_part").alias("rule"), "item"))
    return out
