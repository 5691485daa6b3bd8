"""Document trees against the plain walk, and places in merged text against plain string work."""

import json
import random

from pyspark.sql import functions as F

from quillbank.functions import rich
from quillbank.operators import document_tree, offsets


def _random_node(rng, depth):
    kind = rng.choice(["text", "text", "paragraph", "bulletList", "listItem", "table", "tableRow", "tableCell", "tableHeader", "heading", "mathNode", "image", "hardBreak", "doc", "other", 7, None])
    node = {"type": kind, "text": rng.choice(["A b", " ", "Ｗide", "", "x\n", 5, "ſharp​", "　"]), "attrs": rng.choice([{}, {"level": rng.choice([0, 2, 9, -1, True, "3", 2.5])}, {"colspan": 2, "rowspan": rng.choice([3, None])}, 4, {"latex": rng.choice([" \\Frac ａ ", " ", 3])}, {"resourceId": rng.choice(["r1", " ", "r0"]), "src": rng.choice(["", "s.png"]), "alt": "alt"}])}
    if rng.random() < 0.5:
        node["marks"] = rng.choice([[{"type": "superscript"}], [{"type": "bold"}, {"type": "subscript"}, {"type": "superscript"}], [3, None], "x"])
    if depth and rng.random() < 0.8:
        node["content"] = rng.choice([[_random_node(rng, depth - 1) for _ in range(rng.randrange(5))] + [None, 3][: rng.randrange(3)], "no list"]) if rng.random() < 0.9 else None
    return node


def test_document_trees_are_those_of_the_plain_walk(spark):
    rng = random.Random(9)
    trees = [_random_node(rng, rng.randrange(6)) for _ in range(150)]
    deep = {"type": "text", "text": "Deep"}
    for i in range(24):
        deep = {"type": "listItem" if i % 2 else "bulletList", "content": [deep]}
    trees += [deep, {}, {"type": "doc", "content": []}]
    rows = [(i, json.dumps(x, ensure_ascii=i % 2 == 0)) for i, x in enumerate(trees)] + [(900, None), (901, ""), (902, "[1]"), (903, "{"), (904, '"x"')]
    got = {r["id"]: r for r in document_tree.document_tokens(spark.createDataFrame(rows, "id long, document string")).collect()}
    assert not {900, 901, 902, 903, 904} & set(got)
    silent = {"tokens": [], "text": "", "meaningful": False, "unverified": False, "image_ids": []}
    for i, tree in enumerate(trees):
        want = rich.document_tokens(tree).row()
        found = {**got[i].asDict(), "tokens": [t.asDict() for t in got[i]["tokens"]]} if i in got else silent
        assert {k: found[k] for k in want} == want, (tree, found)
    assert len(got[150]["tokens"]) == 49


def test_offsets_in_replaced_and_merged_text(spark):
    rng = random.Random(3)
    paragraphs, edits, anchors, want = [], [], [], {}
    for doc in range(6):
        merged = ""
        for p in rng.sample(range(100), 8):
            paragraphs.append((doc, p, "".join(rng.choices("abc é漢", k=rng.randrange(30))) if p % 9 else None))
        for _, p, text in sorted(x for x in paragraphs if x[0] == doc):
            text = text or ""
            cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
            parts = [(a, b, rng.choice(["", "X", "long text"])) for a, b in zip(cuts[::2], cuts[1::2])]
            edits += [(doc, p, *x) for x in parts] + [(doc, p, 50, 99, "beyond"), (doc, p, -2, 1, "before"), (doc, 777, 0, 0, "nowhere")]
            merged += "\n" * bool(merged or want.get((doc, "any")))
            want[doc, "any"] = True
            start, out, at, places = len(merged), "", 0, {}
            for a, b, new in parts:
                places.update({k: start + len(out) + k - at for k in range(at, a + 1)})
                out += text[at:a] + new
                places.update({k: start + len(out) for k in range(a + 1, b + 1)})
                at = b
            places.update({k: start + len(out) + k - at for k in range(at if not parts else at + 1, len(text) + 1)})
            merged += out + text[at:]
            for k in range(len(text) + 1):
                if k not in [a for a, b, _ in parts if a == b]:
                    anchors.append((doc, p, k))
                    want[doc, p, k] = places[k]
            anchors += [(doc, p, 999), (doc, p, None)]
            want[doc, p, 999] = want[doc, p, None] = len(merged)
        want[doc] = merged
    df = spark.createDataFrame(paragraphs, "doc_id int, paragraph_index int, text string")
    replaced = offsets.replaced_paragraphs(df, spark.createDataFrame(edits, "doc_id int, paragraph_index int, start int, end int, text string")).cache()
    assert {r["doc_id"]: r["text"] for r in offsets.merged_texts(replaced).collect()} == {d: want[d] for d in range(6)}
    anchors.append((0, 555, 1))
    got = offsets.rebased(spark.createDataFrame(anchors, "doc_id int, paragraph_index int, offset int"), replaced).collect()
    assert {(r["doc_id"], r["paragraph_index"], r["offset"]): r["place"] for r in got} == {k: want.get(k) for k in anchors}
    first = {d: sorted(p for x, p, _ in paragraphs if x == d) for d in range(6)}
    tables = spark.createDataFrame([(d, "t", first[d][1], first[d][3]) for d in range(6)] + [(0, "u", 500, 501)], "doc_id int, table_id string, first int, last int")
    spans = {(r["doc_id"], r["table_id"]): (r["start"], r["end"]) for r in offsets.rebased_tables(tables, replaced).collect()}
    ends = {(r["doc_id"], r["paragraph_index"]): (r["start"], r["end"]) for r in replaced.collect()}
    assert spans == {**{(d, "t"): (ends[d, first[d][1]][0], ends[d, first[d][3]][1]) for d in range(6)}, (0, "u"): (None, None)}


def test_tables_in_tables_are_one(spark):
    html = ["a<table><tr><td>x<table><tr><td>y</td></tr></table>z</td></tr></table>b<img src='q'>", "<TABLE>1</TABLE><table>2</table >", "<table>open", "no", None, "<table><table><table>1</table></table></table>"]
    got = spark.createDataFrame([(x,) for x in html], "h string").select(rich.compact_stem(F.col("h")).alias("s")).collect()
    assert [r["s"] for r in got] == ["a[表格]b[图片]", "[表格][表格]", "<table>open", "no", None, "[表格]"]
