"""Rich content and small text rules on literal rows."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillbank.functions import rich, wording
from quillbank.plans.registry import QUERIES


def kinds(html):
    return [(t["kind"], t["value"]) for t in rich.html_tokens(html).tokens]


def test_tokens_of_markup():
    assert kinds("<p>A <b>b</b>c</p>") == [("open:p", ""), ("text", "abc"), ("close:p", "")]
    assert kinds("x<sup>2</sup>") != kinds("x2")
    assert kinds("<p>a<p>b") == [("open:p", ""), ("text", "a"), ("close:p", ""), ("open:p", ""), ("text", "b"), ("close:p", "")]
    assert [k for k, _ in kinds("<table><tr><td>1<td colspan=2>2<tr><td>3</table>")].count("close:td") == 3
    assert kinds("<script>x</script><style>y</style>z") == [("text", "z")]
    assert kinds('<span data-latex=" X ">shown</span>y') == [("formula", "X"), ("text", "y")]
    assert kinds('<span data-latex="x"></span>') != kinds('<span data-latex="X"></span>')
    out = rich.html_tokens("a<br>b<svg><g></g></svg>")
    assert out.unverified and out.row()["text"] == "a\nb"
    assert not rich.html_tokens("<p>\u200b </p>").meaningful and kinds("") == []
    assert len(kinds("<li>" * 3000)) == 6000


def test_tokens_of_documents():
    text = lambda s, *marks: {"type": "text", "text": s, "marks": [{"type": m} for m in marks]}
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [text("x"), text("2", "superscript"), {"type": "hardBreak"}]}, {"type": "heading", "attrs": {"level": 9}}]}
    assert [t["kind"] for t in rich.document_tokens(doc).tokens] == ["open:p", "text", "open:sup", "text", "close:sup", "break", "close:p", "open:h6", "close:h6"]
    deep = {"type": "doc"}
    for _ in range(5000):
        deep = {"type": "blockquote", "content": [deep]}
    assert len(rich.document_tokens(deep).tokens) == 10000
    assert rich.document_tokens({"type": ["odd"], "content": [None, 3], "attrs": 7}).tokens == []


def test_fingerprints(spark):
    para = lambda s: json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": s}]}]})
    rows = [
        (1, "<p>ＡＢ c</p>", None, None, None),
        (2, None, para("abC"), None, None),
        (3, None, None, "abc", None),
        (4, "<p>abc</p>", para("abc"), None, ""),
        (5, "<p>abc</p>", para("abd"), None, None),
        (6, '<p>abc<img data-resource-id="r1"></p>', None, None, None),
        (7, '<p>abc<img data-resource-id="r2"></p>', None, None, None),
        (8, '<p>abc<img data-resource-id="r3"></p>', None, None, None),
        (9, "<p>abc</p>", "{damaged", None, "<w/>"),
        (10, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, html string, doc string, plain string, ooxml string")
    df = df.withColumn("p", rich.rich_parts(F.col("html"), F.col("doc"), F.col("plain")))
    resources = spark.createDataFrame([("r1", "aa"), ("r2", "aa")], "id string, sha256 string")
    df = rich.with_hashes(df, "id", rich.image_ids(F.col("p")), resources)
    df = df.withColumn("i", rich.content_identity(F.col("p"), F.col("hashes"), F.col("ooxml")))
    no = F.array().cast("array<struct<tokens:array<struct<kind:string,value:string>>,comparable:boolean>>")
    df = df.withColumn("f", rich.rich_fingerprint(F.lit("short_answer"), no, [F.col("i")] * 3)).withColumn("c", rich.all_comparable(no, [F.col("i")]))
    got = {r["id"]: r for r in df.withColumn("has", rich.has_content(F.col("p"))).collect()}
    prints = {k: r["f"] for k, r in got.items()}
    assert prints[1] == prints[2] == prints[3] == prints[4] and prints[6] == prints[7]
    assert len({prints[k] for k in (1, 5, 6, 8, 9, 10)}) == 6
    assert {k for k, r in got.items() if not r["c"]} == {5, 8} and {k for k, r in got.items() if not r["has"]} == {10}
    with_options = df.select(rich.rich_fingerprint(F.lit("x"), F.array(F.col("i")), [F.col("i")] * 3)).distinct().count()
    assert with_options == 6


def test_unsafe_markup(spark):
    rows = [("<p>on = x</p>", False), ("<P ONclick = 'x'>", True), ("<scr", False), ("<SCRIPT >", True), ("<a href='JavaScript:x'>", True), (None, False), ("<a srcdoc=x>", True), ("a < b and onload=1", False), ("<a\nonload=1>", True)]
    df = spark.createDataFrame(rows, "h string, bad boolean")
    assert [r[0] for r in df.select(rich.is_unsafe(F.col("h"))).collect()] == [x[1] for x in rows]
    assert spark.createDataFrame([("a\x1fb",)], "t string").select(rich.has_reserved_mark(F.col("t"))).first()[0]
    assert spark.createDataFrame([("a<table><tr></table>b<IMG src=x>",)], "t string").select(rich.compact_stem(F.col("t"))).first()[0] == "a[表格]b[图片]"


@pytest.mark.parametrize(("text", "value"), [("12", 12), ("0", None), ("十", 10), ("二十一", 21), ("一百零", None), ("一百二十三", 123), ("", None), ("x", None)])
def test_numerals(text, value):
    assert wording.numeral_value(text) == value


def test_labels(spark):
    df = spark.createDataFrame([(i,) for i in (1, 10, 11, 20, 99, 100)], "n int")
    assert [r[0] for r in df.select(wording.chinese_numeral(F.col("n"))).collect()] == ["一", "十", "十一", "二十", "九十九", "100"]
    df = spark.createDataFrame([(i,) for i in (0, 25, 26, 51, 52, 701)], "n int")
    assert [r[0] for r in df.select(wording.column_label(F.col("n"))).collect()] == ["A", "Z", "AA", "AZ", "BA", "ZZ"]
    df = spark.createDataFrame([("（ 未填写 ）。",), ("x",), (None,), (" 三十二 ",)], "t string")
    assert [r[0] for r in df.select(wording.without_placeholder(F.col("t"))).collect()] == ["", "x", None, " 三十二 "]
    assert [r[0] for r in df.select(wording.from_numeral(F.col("t"))).collect()] == [None, None, None, 32]
    assert spark.range(1).select(wording.xml_escaped(F.lit("<a&'\">"))).first()[0] == "&lt;a&amp;&apos;&quot;&gt;"


def test_answers_follow_options(spark):
    rows = [("b,a",), ("C",), ("not 1",), ("",), (None,), ("ＢＢ",), ("Z",)]
    df = spark.createDataFrame(rows, "a string").withColumn("before", F.array(*map(F.lit, "xyz"))).withColumn("after", F.array(*map(F.lit, "yx")))
    got = [tuple(r[0]) for r in df.select(wording.remapped_answer(F.col("before"), F.col("after"), F.col("a"))).collect()]
    assert got == [("A、B", False), ("", True), ("not 1", True), ("", False), (None, False), ("A", False), ("", True)]


def test_signatures(spark):
    assert wording.fnv1a("") == "811c9dc5" and wording.fnv1a("a") == "e40c292c" and wording.fnv1a("😀") != wording.fnv1a("a")
    df = spark.createDataFrame([('{"id":1,"b":2,"a":{"tagIds":["y","x"]}}',), ('{"a":{"tagIds":["x","y"],"id":3},"b":2}',), ("{",), (None,)], "d string")
    got = [r[0] for r in df.select(wording.semantic_signature(F.col("d"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] is None
    one = F.array(F.struct(F.lit("i").alias("id"), F.lit(0).alias("position"), F.lit(1).alias("version"), F.lit(5).alias("updated_at")))
    assert spark.range(1).select(wording.layout_signature(F.lit("t"), F.lit("m"), F.lit(None).cast("string"), one)).first()[0] == f"paper-v1:1:{wording.fnv1a('t|m||i:0:1:5')}"
    h = spark.range(1).select(wording.framed_hash(F.lit("ab"), F.lit("c")), wording.framed_hash(F.lit("a"), F.lit("bc")), wording.framed_hash(F.lit("ab"), F.lit(None).cast("string"))).first()
    assert len(set(h)) == 3


def test_formula_tokens(spark):
    text = wording.inject_formulas("a\ufffcb", [(1, "k1"), (3, "k2")])
    assert text == "a\ue000k1\ue001b\ue000k2\ue001"
    df = spark.createDataFrame([(text,), (None,), ("",), ("x\ufffc",)], "t string")
    assert [r[0] for r in df.select(wording.formula_text(F.col("t"), F.create_map(F.lit("k1"), F.lit("x^2")))).collect()] == ["a\\(x^2\\)b[公式]", None, "", "x[公式]"]


def test_equal_content_is_parsed_once(monkeypatch):
    calls, real = [], rich.parts
    monkeypatch.setattr(rich, "parts", lambda *x: calls.append(x) or real(*x))
    got = rich._parts_of(pa.array(["<p>a</p>", None, "<p>a</p>", "<p>b</p>"]), pa.array([None, "{}", None, None], pa.string()), pa.array([None, None, None, "x"]))
    assert len(calls) == 3 and [x["main"]["text"] for x in got.to_pylist()] == ["a", "", "a", "b"]


def test_ascii_is_squeezed_as_other_text():
    text = "".join(map(chr, range(128)))
    assert rich.squeezed(text + "é") == rich.squeezed(text) + "é"


def test_rich_identity_parses_once(spark, tmp_path):
    rows = [(i, f"name {i // 2}", "Brand#1", "T") for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["rich_identity"](spark, str(tmp_path))
    assert "EvalPython" not in out._jdf.queryExecution().toString()  # once, in the checkpoint
    assert {r["id"]: r["least"] for r in out.collect()} == {i: i - i % 2 for i in range(40)}
