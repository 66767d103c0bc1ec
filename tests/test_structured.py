"""Structured segments: nested titles, sheets, slides, table rows and their typed columns."""

import pytest

from siltstone.sources.structured import structured_segments

SHEET = """## Budget
| Costs 2024 | | |
| --- | --- | --- |
| Item | Owner | Amount |
| Desk | Ann | 10 |
| Lamp | Bob | 20 |

### Notes
Some *words*
on two lines

## Sheet: Plan
text
"""
SLIDES = """<!-- Slide number: 3 -->
# Intro
Hello
## Details
### Deep
- one
<!-- a comment -->
- two
# Slide 9: Named
#
| A | B |
|---|---|
| x | y |
not | a table
"""
PLAIN = "# Top\nline | with pipe\n\n## Below\n[link](u) ![img](p)\r\nnext\n"


def parse(spark, rows, **kw):
    got = structured_segments(spark.createDataFrame(rows, "path string, suffix string, content string"), **kw)
    return [r.asDict() for r in got.orderBy("path", "paragraph_index").collect()]


def test_sheets(spark):
    got = parse(spark, [("s", ".XLSX", SHEET)])
    assert [r["section_title"] for r in got if r["segment_kind"] == "heading"] == ["Sheet: Budget", "Sheet: Budget / Notes", "Sheet: Plan"]
    assert {r["sheet_name"] for r in got} == {"Budget", "Plan"} and [r["paragraph_index"] for r in got] == list(range(1, len(got) + 1))
    table = [r for r in got if r["segment_kind"] == "table_row"]
    assert [(r["table_row_index"], r["table_headers"], r["table_caption"]) for r in table] == [(k, ["Item", "Owner", "Amount"], "Sheet: Budget / Costs 2024") for k in (1, 2)]
    assert "Desk" in table[0]["text"] and "Lamp" in table[1]["text"] and table[0]["section_title"] == "Sheet: Budget / Costs 2024"
    assert [r["text"] for r in got if r["segment_kind"] == "paragraph"] == ["Some words on two lines", "text"]


def test_slides(spark):
    got = parse(spark, [("p", ".pptx", SLIDES)])
    titles = [r["section_title"] for r in got if r["segment_kind"] == "heading"]
    assert titles[:4] == ["Slide 3: Intro", "Slide 3: Intro / Details", "Slide 3: Intro / Details / Deep", "Slide 9: Named"]
    by_text = {r["text"]: r for r in got}
    assert (by_text["Hello"]["slide_number"], by_text["Hello"]["slide_title"]) == (3, "Intro")
    assert by_text["one"]["section_title"] == by_text["two"]["section_title"] == titles[2]  # the comment parts the lines
    row = next(r for r in got if r["segment_kind"] == "table_row")
    assert (row["slide_number"], row["slide_title"], row["table_headers"], row["table_row_index"]) == (9, "Named", ["A", "B"], 1)


def test_plain_files(spark):
    got = parse(spark, [("a", ".md", PLAIN), ("b", ".md", None), ("c", ".md", ""), ("d", None, "only")])
    assert [(r["path"], r["text"], r["section_title"]) for r in got] == [("a", "Top", "Top"), ("a", "line | with pipe", "Top"), ("a", "Below", "Below"), ("a", "link next", "Below"), ("d", "only", None)]
    assert all(r["sheet_name"] is None and r["slide_number"] is None for r in got)


def test_row_limit(spark):
    assert len(parse(spark, [("s", ".xlsx", SHEET)], max_rows=2)) == 7
    with pytest.raises(Exception, match="more than 1 data rows: s"):
        parse(spark, [("s", ".xlsx", SHEET)], max_rows=1)
