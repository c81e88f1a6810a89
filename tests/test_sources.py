import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import contracts
from folioforge.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sheet_of_a_workbook(spark, tmp_path):
    shared = "<sst xmlns='m'><si><t>id</t></si><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si></sst>"
    book = "<workbook xmlns='m'><sheets><sheet name='first'/><sheet name='second'/></sheets></workbook>"
    rows = "<row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row><c r='A2'><v>7</v></c><c r='B2' t='s'><v>2</v></c></row><row><c r='B3' t='inlineStr'><is><t>Bo</t></is></c></row><row/>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/workbook.xml", book)
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet xmlns='m'><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet xmlns='m'><sheetData>{rows}</sheetData></worksheet>")
    got = files.sheet(spark, f"{tmp_path}/b.xlsx", "second").collect()
    assert [(r.id, r.name) for r in got] == [("7", "Anna"), (None, "Bo")]
    with pytest.raises(ValueError):
        files.sheet(spark, f"{tmp_path}/b.xlsx", "third")
    found = files.sheet(spark, f"{tmp_path}/b.xlsx", "second", required=("7",)).collect()
    assert [tuple(r) for r in found] == [(None, "Bo")], "the header is the first row with the required names"
    reviews = spark.createDataFrame([("1", "approved "), ("2", None), ("3", "OPEN"), ("3", "OPEN")], "id string, status string")
    assert sorted(r.id for r in files.open_reviews(reviews).collect()) == ["2", "3"]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    sha = hashlib.sha256((tmp_path / "a.json").read_bytes()).hexdigest()
    assert [r.a for r in files.checked_json(spark, f"{tmp_path}/a.json", "a long", sha).collect()] == [1, 2]
    with pytest.raises(ValueError):
        files.checked_json(spark, f"{tmp_path}/a.json", "a long", "0")


def test_page_xml(spark):
    xml = "<PcGts xmlns='u'><Page><TextRegion><TextLine id='a'><Coords points='0,0 1,0 1,1'/><TextEquiv><Unicode>one</Unicode></TextEquiv></TextLine><TextLine id='b'><TextEquiv><Unicode>  </Unicode></TextEquiv></TextLine></TextRegion><TextLine id='c'><TextEquiv><Unicode>zwei</Unicode></TextEquiv></TextLine></Page></PcGts>"
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, xml.replace(" xmlns='u'", ""))], "page long, xml string")
    got = sorted(map(tuple, files.page_xml_lines(df).collect()))
    one = [(0, "a", "one", "0,0 1,0 1,1", 0, 3), (1, "c", "zwei", None, 4, 8)]
    assert got == [(p, *r) for p in (1, 4) for r in one]


def test_checked_csv_listing_and_reports(spark, tmp_path):
    path = tmp_path / "in" / "a.csv"
    path.parent.mkdir()
    path.write_text("k,v\n1,a\n2,b\n")
    sha = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.checked_csv(spark, str(path), "k int, v string", sha).count() == 2
    with pytest.raises(ValueError):
        files.checked_csv(spark, str(path), "k int, v string", "0" * 64)
    path.write_text("k,v\nx,a\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|failed"):
        files.checked_csv(spark, str(path), "k int, v string").collect()
    shown = files.listing(spark, str(path.parent)).collect()
    assert [(r.key.endswith("a.csv"), r["size"]) for r in shown] == [(True, 8)]
    files.write_reports(spark.range(3), str(tmp_path / "out"), {"rows": 3})
    assert spark.read.json(str(tmp_path / "out/json")).count() == 3 and "| rows | 3 |" in [r[0] for r in spark.read.text(str(tmp_path / "out/markdown")).collect()]


def test_snapshots_are_appended_once(spark):
    old = spark.createDataFrame([(1, "a")], "doc long, print string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "doc long, print string")
    assert sorted(map(tuple, files.append_snapshots(old, new, ["doc", "print"]).collect())) == [(1, "b"), (2, "a")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://www.youtube.com/watch?list=x&v=abcdefghijk&t=42", ("youtube", "abcdefghijk", 42)), ("youtu.be/abcdefghijk", ("youtube", "abcdefghijk", None)),
        ("https://vimeo.com/video/12345", ("vimeo", "12345", None)), ("https://example.com/watch?v=abcdefghijk", None), ("", None),
    ],
)
def test_video_addresses(spark, raw, want):
    got = value(spark, contracts.video_address(F.lit(raw)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("raw", "want"), [('{"0": 5, "1": 7}', {1: 5, 2: 7}), ('{"1": 5, "2": 7}', {1: 5, 2: 7}), ('{"0": 5, "2": 7}', None), ('{"0": 5, "1": 5}', None), ('{"a": 1}', None), ("{}", None), ("[1]", None)]
)
def test_page_numbers(spark, raw, want):
    assert value(spark, contracts.page_numbers(F.lit(raw))) == want


def test_payloads_and_words(spark):
    err = lambda raw, n: value(spark, contracts.payload_error(F.lit(raw), F.lit(n)))
    good = '{"schema_version": 1, "pages": [{"page_index": 1, "text": "a"}, {"page_index": 2, "text": null}]}'
    assert err(good, 2) is None and err(good, 3) == "page_count" and err("nope", 1) == "json" and err('{"schema_version": 1}', 1) == "keys"
    assert err(good.replace(": 2,", ": 3,"), 2) == "page_order" and err('{"schema_version": 1, "pages": [{"page_index": 1, "text": " "}]}', 1) == "no_text"
    word = '{"boundingBox": {"vertices": [{"x": 1, "y": 2}, {"x": 9, "y": 2}, {"x": 9, "y": 8}, {"x": 1, "y": 8}]}, "symbols": [{"text": "a"}, {"text": "b"}]}'
    page = '{"pages": [{"blocks": [{"paragraphs": [{"words": [%s]}]}]}]}' % word
    assert [tuple(w) for w in value(spark, contracts.word_boxes(F.lit(page), F.lit(10), F.lit(10)))] == [(0, "ab", 1, 2, 9, 8)]
    assert value(spark, contracts.word_boxes(F.lit(page), F.lit(5), F.lit(10))) is None
    assert value(spark, contracts.mime_type(F.lit("Image/JPG; q=1"))) == "image/jpeg" and value(spark, contracts.display_name(F.lit(" Ann "), F.lit("Dr. "))) == "Dr. Ann"
