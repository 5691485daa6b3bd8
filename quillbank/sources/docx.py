"""Word documents: paragraphs, tables, images and formulas, read with the standard library inside executors."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree.ElementTree import Element, ParseError, XMLPullParser
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.functions.omml import M, W, latex
from quillbank.functions.wording import OBJECT_MARK
from quillbank.sources.xlsx import WorkbookError, _opened, _tree

BODY = "word/document.xml"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_V = "{urn:schemas-microsoft-com:vml}"
_BLANKS = " 　\xa0"
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "wmf": "image/x-wmf", "emf": "image/x-emf", "svg": "image/svg+xml"}

_PARAGRAPH = pa.struct([("paragraph_index", pa.int32()), ("text", pa.string()), ("table_id", pa.int32()), ("table_row", pa.int32()), ("table_cell", pa.int32()), ("scripts", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))])
_IMAGE = pa.struct([("paragraph_index", pa.int32()), ("at", pa.int32()), ("ref", pa.string()), ("part", pa.string()), ("mime_type", pa.string()), ("sha256", pa.string()), ("byte_size", pa.int64()), ("width_px", pa.int32()), ("height_px", pa.int32())])
_FORMULA = pa.struct([("paragraph_index", pa.int32()), ("at", pa.int32()), ("ref", pa.string()), ("latex", pa.string()), ("complete", pa.bool_())])
_ARROW = pa.schema([("path", pa.string()), ("paragraphs", pa.list_(_PARAGRAPH)), ("images", pa.list_(_IMAGE)), ("formulas", pa.list_(_FORMULA)), ("error", pa.string())])
_PARAGRAPHS = pa.schema([("doc_id", pa.string()), *_PARAGRAPH, ("images", pa.list_(_IMAGE)), ("formulas", pa.list_(_FORMULA))])
_READ, _ROWS_HELD = 1 << 16, 4096
SHAPE = (
    "path string, paragraphs array<struct<paragraph_index:int,text:string,table_id:int,table_row:int,table_cell:int,scripts:array<struct<start:int,end:int,kind:string>>>>, "
    "images array<struct<paragraph_index:int,at:int,ref:string,part:string,mime_type:string,sha256:string,byte_size:bigint,width_px:int,height_px:int>>, "
    "formulas array<struct<paragraph_index:int,at:int,ref:string,latex:string,complete:boolean>>, error string"
)

PARAGRAPHS_SHAPE = (
    "doc_id string, paragraph_index int, text string, table_id int, table_row int, table_cell int, scripts array<struct<start:int,end:int,kind:string>>, "
    "images array<struct<paragraph_index:int,at:int,ref:string,part:string,mime_type:string,sha256:string,byte_size:bigint,width_px:int,height_px:int>>, "
    "formulas array<struct<paragraph_index:int,at:int,ref:string,latex:string,complete:boolean>>"
)


@dataclass
class _Found:
    """What a document's body holds."""

    paragraphs: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    formulas: list[dict] = field(default_factory=list)
    gone: tuple[int, int] = (0, 0)  # paragraphs and formulas that were taken

    def taken(self) -> list[dict]:
        """The paragraphs so far, each with its images and formulas; they are not held any longer."""
        for x in self.paragraphs:
            x.update(images=[], formulas=[])
        for kind in ("images", "formulas"):
            for x in getattr(self, kind):
                self.paragraphs[x["paragraph_index"] - self.gone[0]][kind].append(x)
        out, self.gone = self.paragraphs, (self.gone[0] + len(self.paragraphs), self.gone[1] + len(self.formulas))
        self.paragraphs, self.images, self.formulas = [], [], []
        return out


def _switched_on(run: Element, name: str) -> bool:
    x = run.find(f"{W}rPr/{W}{name}")
    return x is not None and x.get(f"{W}val", "single") not in ("none", "false", "0")


def _pixels(emu: str | None) -> int | None:
    return max(1, round(int(emu) / 9525)) if emu and emu.isdigit() else None


class _Paragraph:
    def __init__(self, found: _Found, place: tuple):
        self.found, self.place, self.index = found, place, found.gone[0] + len(found.paragraphs)
        self.text, self.scripts, self.row = "", [], {"paragraph_index": self.index}
        found.paragraphs.append(self.row)

    def walk(self, node: Element) -> None:
        for x in node:
            tag = x.tag
            if tag in (f"{W}del", f"{W}moveFrom", f"{W}pPr"):
                continue
            if tag == f"{W}r":
                self.run(x)
            elif tag == f"{M}oMath":
                shown, complete = latex(x)
                self.found.formulas.append({"paragraph_index": self.index, "at": len(self.text), "ref": f"f{self.found.gone[1] + len(self.found.formulas)}", "latex": shown, "complete": complete})
                self.text += OBJECT_MARK
            elif tag == f"{W}p":
                raise WorkbookError("a paragraph inside a paragraph")
            else:
                self.walk(x)

    def run(self, run: Element) -> None:
        start = len(self.text)
        for x in run:
            match x.tag.removeprefix(W):
                case "t":
                    self.text += x.text or ""
                case "tab":
                    self.text += "\t"
                case "br" | "cr":
                    self.text += "\n"
                case "noBreakHyphen":
                    self.text += "-"
                case "drawing" | "pict" | "object":
                    self.pictures(x)
                case other if other.endswith("}AlternateContent"):
                    self.pictures(x)
        said = self.text[start:]
        if said and not said.strip(_BLANKS) and _switched_on(run, "u"):
            self.text = self.text[:start] + "_" * len(said)
        raised = run.find(f"{W}rPr/{W}vertAlign")
        kind = {"superscript": "sup", "subscript": "sub"}.get("" if raised is None else raised.get(f"{W}val", ""))
        if kind and said:
            self.scripts.append({"start": start, "end": len(self.text), "kind": kind})

    def pictures(self, node: Element) -> None:
        size = next(node.iter(f"{_WP}extent"), None)
        seen, todo = set(), [node]
        while todo:
            x = todo.pop()
            if x.tag == f"{W}txbxContent":
                continue
            todo.extend(reversed(x))
            ref = x.get(f"{_R}embed") if x.tag == f"{_A}blip" else x.get(f"{_R}id") if x.tag == f"{_V}imagedata" else None
            if ref and ref not in seen:
                seen.add(ref)
                wide, high = (None, None) if size is None else (_pixels(size.get("cx")), _pixels(size.get("cy")))
                self.found.images.append({"paragraph_index": self.index, "at": len(self.text), "ref": ref, "width_px": wide, "height_px": high})

    def done(self) -> None:
        table, row, cell = self.place
        self.row.update(text=self.text, table_id=table, table_row=row, table_cell=cell, scripts=self.scripts)


def _walker(found: _Found) -> Callable[[Iterable[Element], tuple], None]:
    """What puts the paragraphs of nodes at a place into `found`."""
    tables = 0

    def walk(node: Iterable[Element], place: tuple) -> None:
        nonlocal tables
        row = cell = -1
        for x in node:
            tag = x.tag.removeprefix(W)
            if tag == "altChunk":
                raise WorkbookError("an embedded document")
            if tag in ("txbxContent", "del", "moveFrom", "sectPr"):
                continue
            if tag == "p":
                p = _Paragraph(found, place)
                p.walk(x)
                p.done()
            elif tag == "tbl" and place[0] is None:
                tables += 1
                walk(x, (tables - 1, None, None))
            elif tag == "tr" and place[0] is not None and place[1] is None:
                row += 1
                walk(x, (place[0], row, None))
            elif tag == "tc" and place[1] is not None and place[2] is None:
                cell += 1
                walk(x, (place[0], place[1], cell))
            else:
                walk(x, place)

    return walk


def body(root: Element) -> _Found:
    """Paragraphs in order, those of a table with the place in the outermost one; text boxes are left out.

    Deleted and moved-away runs and field instructions do not count; a formula leaves one object mark; underlined blanks
    become underscores. Embedded documents are an error.
    """
    found, start = _Found(), root.find(f"{W}body")
    if start is None:
        raise WorkbookError("not a document")
    _walker(found)(start, (None, None, None))
    return found


def _body_nodes(archive: ZipFile) -> Iterator[Element]:
    """The nodes of a document's body one by one; each goes when the next one is asked for."""
    if BODY not in archive.namelist():
        raise WorkbookError(f"part {BODY} is missing")
    parser, above, start, found = XMLPullParser(("start", "end")), [], None, False
    try:
        with archive.open(BODY) as f:
            data = f.read(_READ)
            if b"<!DOCTYPE" in data[:4096]:
                raise WorkbookError("document types are not read")
            while True:
                parser.feed(data)
                if not data:
                    parser.close()
                for event, x in parser.read_events():
                    if event == "start":
                        if len(above) == 1 and not found and x.tag == f"{W}body":
                            start, found = x, True
                        above.append(x)
                        continue
                    above.pop()
                    if len(above) == 2 and above[-1] is start:
                        yield x
                        start.remove(x)
                if not data:
                    break
                data = f.read(_READ)
    except ParseError as e:
        raise WorkbookError(f"part {BODY} is damaged") from e
    if not found:
        raise WorkbookError("not a document")


def _linked(archive: ZipFile) -> Callable[[dict], None]:
    """What adds part, type, digest and size to an image."""
    names, links = set(archive.namelist()), {}
    if "word/_rels/document.xml.rels" in names:
        links = {x.get("Id"): x for x in _tree(archive, "word/_rels/document.xml.rels")}

    def add(image: dict) -> None:
        link = links.get(image["ref"])
        outside = link is None or link.get("TargetMode") == "External"
        target = "" if outside else link.get("Target", "")
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"word/{target}") if target else ""
        image["part"] = part if part in names else None
        image["mime_type"] = MEDIA.get(part.rpartition(".")[2].lower())
        media = archive.read(part) if part in names else None
        image["sha256"], image["byte_size"] = (None, None) if media is None else (hashlib.sha256(media).hexdigest(), len(media))

    return add


def document_of(path: str, data: bytes) -> dict:
    """A document's row; `error` says why a file cannot be read."""
    try:
        archive = _opened(data)
        found = body(_tree(archive, BODY))
        linked = _linked(archive)
        for image in found.images:
            linked(image)
        return {"path": path, "paragraphs": found.paragraphs, "images": found.images, "formulas": found.formulas, "error": None}
    except (WorkbookError, RecursionError) as e:
        return {"path": path, "paragraphs": [], "images": [], "formulas": [], "error": str(e)}


def parsed(files: DataFrame) -> DataFrame:
    """One row for each document in files (path, content), with nested paragraphs, images and formulas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist([document_of(p.as_py(), data.as_py())], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SHAPE)


def _paragraph_batches(path: str, data: bytes) -> list[pa.RecordBatch]:
    """A document's paragraphs; none if it cannot be read."""
    out, held, found = [], [], _Found()
    try:
        archive = _opened(data)
        linked, walk = _linked(archive), _walker(found)
        for x in _body_nodes(archive):
            walk([x], (None, None, None))
            if len(found.paragraphs) >= _ROWS_HELD:
                held = found.taken()
                for image in (i for p in held for i in p["images"]):
                    linked(image)
                out.append(pa.RecordBatch.from_pylist([{"doc_id": path, **p} for p in held], schema=_PARAGRAPHS))
        held = found.taken()
        for image in (i for p in held for i in p["images"]):
            linked(image)
        return [*out, pa.RecordBatch.from_pylist([{"doc_id": path, **p} for p in held], schema=_PARAGRAPHS)]
    except (WorkbookError, RecursionError):
        return []


def paragraphs_with_parts(files: DataFrame) -> DataFrame:
    """The paragraphs of parsed(), one row each with the document's path as doc_id and its own images and formulas.

    Each document is parsed once, node by node; a task holds one file and its paragraphs as Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from _paragraph_batches(p.as_py(), data.as_py())

    return files.select("path", "content").mapInArrow(run, PARAGRAPHS_SHAPE)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """parsed() of every document at path, a file or a folder."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path))


def document_parts(documents: DataFrame, part: str) -> DataFrame:
    """Rows of `paragraphs`, `images` or `formulas` with the document's path as doc_id."""
    return documents.select(F.col("path").alias("doc_id"), F.explode(part).alias("x")).select("doc_id", "x.*")
