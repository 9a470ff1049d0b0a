"""Requests, answers and reassembly."""

import pytest
from pyspark.sql import functions as F

from docframe.functions import markup
from docframe.operators import batches, classify, pipeline

ROLES = ["PART", "PARAGRAPH"]


@pytest.fixture
def rows(spark):
    data = [("a", i, f"text {i}") for i in range(60)] + [("b", 3, "only")]
    return spark.createDataFrame(data, "file_key string, paragraph_index int, text string")


def answers(spark, chunks, change=lambda k, c, items: items, status=lambda k, c: "succeeded"):
    out = []
    for r in chunks.groupBy("file_key", "chunk").agg(F.sort_array(F.collect_list("paragraph_index")).alias("i")).collect():
        items = change(r.file_key, r.chunk, [{"paragraph_index": i, "csi_role": "PARAGRAPH"} for i in r.i])
        import json

        out.append((f"{r.file_key}__chunk{r.chunk}", status(r.file_key, r.chunk), "```json\n" + json.dumps({"classifications": items, "notes": []}) + "\n```" if items is not None else "no json"))
    return spark.createDataFrame(out, "custom_id string, status string, text string")


def test_requests(spark, rows):
    chunks = batches.chunked(rows, 0, 10**9, 300)
    assert {r.chunk for r in chunks.collect()} == {0}
    chunks = batches.chunked(rows, 0, 1500, 300)
    requests = batches.build_requests(chunks, "Do.", ROLES).collect()
    assert len(requests) > 2 and all(r.message.startswith('Do.\n\navailable_roles: ["PART","PARAGRAPH"]') for r in requests)
    with pytest.raises(ValueError, match="more than 1"):
        batches.build_requests(chunks, "Do.", ROLES, 1)


def test_reassembly(spark, rows):
    chunks = batches.chunked(rows, 0, 1500, 300)
    final, failed = batches.reassemble(chunks, answers(spark, chunks), ROLES)
    assert final.count() == 61 and failed.count() == 0
    batches.require_all(failed)
    for name, kwargs in {
        "request expired": {"status": lambda k, c: "expired" if (k, c) == ("a", 1) else "succeeded"},
        "unreadable answer": {"change": lambda k, c, items: None if (k, c) == ("a", 1) else items},
        "missing coverage": {"change": lambda k, c, items: items[1:] if (k, c) == ("a", 0) else items},
        "duplicate": {"change": lambda k, c, items: items + items[:1] if (k, c) == ("a", 0) else items},
        "bad_role": {"change": lambda k, c, items: [{**items[0], "csi_role": "X"}, *items[1:]] if (k, c) == ("a", 0) else items},
    }.items():
        final, failed = batches.reassemble(chunks, answers(spark, chunks, **kwargs), ROLES)
        reasons = {r.file_key: r.reason for r in failed.collect()}
        assert set(reasons) == {"a"} and (name in reasons["a"] or "expected" in reasons["a"]), (name, reasons)
        assert [r.file_key for r in final.collect()] == ["b"]
    with pytest.raises(ValueError, match="could not be classified"):
        batches.require_all(failed)


def test_reports(spark):
    final = spark.createDataFrame([("a", 2, "PART"), ("a", 1, "ODD")], "file_key string, paragraph_index int, csi_role string")
    assert batches.classification_json(final, ["n"]).first().json == '{"classifications":[{"paragraph_index":1,"csi_role":"ODD"},{"paragraph_index":2,"csi_role":"PART"}],"notes":["n"]}'
    styles = spark.createDataFrame([("PART", "p")], "role string, style_id string")
    assert {r.role: r.mapped for r in batches.preflight_report(final, styles).collect()} == {"PART": True, "ODD": False}
    blocks = spark.sql("select array(struct('text' as type, 'a' as text), struct('thinking' as type, 'b' as text), struct('text' as type, 'c' as text)) as b")
    assert blocks.select(batches.text_of_blocks(F.col("b"))).first()[0] == "ac"
    rels = spark.sql("""select '<R><Relationship Id="2" Type="x/relationships/header"/><Relationship Id="1" Type="x/relationships/footer"/><Relationship Id="0" Type="x/relationships/styles" Target="a/header"/></R>' as r""")
    assert len(rels.select(markup.header_footer_relationships(F.col("r"))).first()[0]) == 2
    assert "-a" in pipeline.difference("a\nb", "c\nb")


class Service:
    """A transport that ends at the third look and loses what it is told to."""

    def __init__(self, lose=()):
        self.looks, self.lose = 0, lose

    def submit(self, requests):
        self.requests = requests
        return "b1"

    def status(self, batch):
        self.looks += 1
        return self.looks == 3, {"done": self.looks}

    def results(self, batch):
        import json
        import re

        for r in self.requests:
            if r["custom_id"] not in self.lose:
                rows = [{"paragraph_index": int(i), "csi_role": "PARAGRAPH"} for i in re.findall(r'"paragraph_index":([0-9]+)', r["message"])]
                yield {"custom_id": r["custom_id"], "status": "succeeded", "text": json.dumps({"classifications": rows, "notes": [f"note {r['custom_id'][-1]}"]})}


def test_submit_and_poll(spark, rows):
    chunks = batches.chunked(rows, 0, 1500, 300)
    requests = batches.build_requests(chunks, "Do.", ROLES)
    counts, pauses = [], []
    responses = batches.submit_and_poll(requests, Service(), 0.1, progress=counts.append, wait=pauses.append)
    assert counts == [{"done": 1}, {"done": 2}, {"done": 3}] and pauses == [1.0, 1.0]
    final, failed = batches.reassemble(chunks, responses, ROLES)
    assert final.count() == 61 and failed.count() == 0
    notes = {r.file_key: r.notes for r in batches.notes(responses).collect()}
    assert notes["b"] == ["note 0"] and notes["a"][:2] == ["note 0", "note 1"]
    _, failed = batches.reassemble(chunks, batches.submit_and_poll(requests, Service({"a__chunk1"}), wait=pauses.append), ROLES)
    assert [(r.file_key, "missing" in r.reason or "expected" in r.reason) for r in failed.collect()] == [("a", True)]
    with pytest.raises(TimeoutError):
        batches.submit_and_poll(requests, Service(), attempts=2, wait=pauses.append)


def test_classifier_sees_the_rows_of_its_chunk(spark, rows):
    class Reader:
        def classify_rows(self, records, roles):
            assert [r["paragraph_index"] for r in records] == sorted(r["paragraph_index"] for r in records)
            return ["PART" if r["prev_text"] is None else "PARAGRAPH" for r in records]

    seen = rows.withColumn("prev_text", F.when(F.col("paragraph_index") > 0, "x"))
    got = classify.merge_chunks(classify.classify_chunks(batches.chunked(seen, 0, 2500, 300), ROLES, Reader()), ["file_key", "paragraph_index"])
    assert {(r.file_key, r.paragraph_index) for r in got.where("csi_role = 'PART'").collect()} == {("a", 0)} and got.count() == 61
