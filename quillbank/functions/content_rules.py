"""What keeps rich content from being saved, as one fault or none, in expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbank.functions.rich import has_reserved_mark, is_unsafe

#: Fixed value: the only editor whose documents are read.
EDITOR = "tiptap"
VERSION_LENGTH = 64
POLICIES = ("question", "question or empty", "draft field", "draft document")


@dataclass(frozen=True)
class Limits:
    """Most bytes (UTF-8) of the parts of one field."""

    html: int = 2 << 20
    document: int = 4 << 20
    plain: int = 512 << 10
    ooxml: int = 4 << 20


def _document_fault(content: Column, limits: Limits | None) -> Column:
    document = content["document"]
    newer = F.coalesce(content["editor"], content["editor_version"], document)
    label = F.trim(F.coalesce(content["editor_version"], F.lit("")))
    root = F.get_json_object(document, "$.type")
    fault = (
        F.when(content["schema_version"] == 1, F.when(newer.isNotNull(), "old version with an editor"))
        .when(~content["schema_version"].eqNullSafe(F.lit(2)), "unknown version")
        .when(~content["editor"].eqNullSafe(F.lit(EDITOR)), "unknown editor")
        .when((label == "") | (F.length(label) > VERSION_LENGTH), "bad editor version")
        .when(document.isNull(), "no document")
        .when(~root.eqNullSafe(F.lit("doc")), "bad document")
    )
    return fault if limits is None else F.coalesce(fault, F.when((content["schema_version"] == 2) & (F.octet_length(document) > limits.document), "document too large"))


def content_fault(content: Column, policy: str, meaningful: Column | None = None, limits: Limits = Limits()) -> Column:
    """The first fault of a field, or null: content (schema_version, editor, editor_version, document, html, plain_text, source_ooxml).

    Policies: "question" has to hold something (`meaningful`, by default a text that is not blank), "question or empty"
    need not; "draft field" may not hold separators anywhere, and "draft document" is not limited in size, as its batch
    is. The order is: version and document, separators in a question's text, sizes, separators in drafts, active
    content, emptiness. Null parts count as absent, and a null field has an unknown version. A document is JSON text.
    """
    if policy not in POLICIES:
        raise ValueError(f"a policy is one of {POLICIES}")
    question, limited = policy.startswith("question"), policy != "draft document"
    html, plain, ooxml = (F.coalesce(content[c], F.lit("")) for c in ("html", "plain_text", "source_ooxml"))
    too_large = lambda x, most: F.octet_length(x) > most
    faults = [_document_fault(content, limits if limited else None)]
    if question:
        faults.append(F.when(has_reserved_mark(plain), "separator"))
    if limited:
        faults.append(F.when(too_large(html, limits.html), "html too large").when(too_large(plain, limits.plain), "text too long").when(too_large(ooxml, limits.ooxml), "source too large"))
    if not question:
        faults.append(F.when(has_reserved_mark(html) | has_reserved_mark(plain) | has_reserved_mark(ooxml), "separator"))
    faults.append(F.when(is_unsafe(html), "unsafe"))
    if policy == "question":
        faults.append(F.when(~(F.trim(plain) != "" if meaningful is None else F.coalesce(meaningful, F.lit(False))), "empty"))
    return F.coalesce(*faults)


def content_bytes(content: Column) -> Column:
    """Bytes of all parts of a field together."""
    sizes = [F.coalesce(F.octet_length(content[c]), F.lit(0)).cast("long") for c in ("html", "plain_text", "source_ooxml", "document")]
    return sizes[0] + sizes[1] + sizes[2] + sizes[3]
