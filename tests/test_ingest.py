"""Captured items and filed entries."""

from pyspark.sql import functions as F

from vellumflow.operators import ingest

COLS = "entry_no int, raw_text string, content string, category string, memory_type string, timestamp string, due_date string, dataview_fields map<string,string>, extracted_wikilinks array<string>, block_id string"


def test_filed_entries(spark):
    rows = [
        (1, "I need to ship [Report] by Sunday", "Awaiting user instructions", "log", "fact", "2026-08-21 10:00", None, {"k": "old"}, ["[[B|b]]"], None),
        (2, "status:: open [k:: new] note ^id1", "status:: open [k:: new] note ^id1", "log", "fact", "10:00", None, {"k": "old"}, None, None),
        (3, None, None, None, None, None, None, None, None, None),
    ]
    out = {r.entry_no: r for r in ingest.filed_entries(spark.createDataFrame(rows, COLS), F.lit("2026-08-21").cast("date")).collect()}
    assert out[1].content == "- [ ] I need to ship [[Report]] by Sunday ➕ 2026-08-21 📅 2026-08-23"
    assert (out[1].category, out[1].due_date, out[1].extracted_wikilinks) == ("task", "2026-08-23", ["B", "Report"])
    assert out[2].dataview_fields == {"k": "old", "status": "open"} and out[2].block_id == "id1" and out[2].category == "log"
    assert out[3].content is None and out[3].dataview_fields == {}


def test_items(spark):
    rows = [("text", " hi ", None, None), ("image", None, None, "a/b.png"), ("url", "https://x.y", "T", None), ("document", None, "cap", None), ("voice", None, "cap", None), ("forwarded", "m", None, None), (None, "z", None, None)]
    df = spark.createDataFrame(rows, "m string, c string, cap string, f string")
    none = F.lit(None).cast("string")
    got = [r[0] for r in df.select(ingest.item_text(F.col("m"), F.col("c"), F.col("cap"), F.col("f"), none, F.lit("Ann"), F.lit("spoken"))).collect()]
    assert got == ["hi", "🖼️ Visual capture [Attachment: ![[b.png]]]", "🔗 [T](https://x.y)", "cap", "cap - spoken", "Forwarded from Ann:\nm", "z"]
