"""Citations and documents in TEI XML. Parsing needs a tree, so it runs in Python on Arrow batches; all after it is columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from . import scalars as s
from .scalars import Col, col

TEI_URI, XML_URI = "http://www.tei-c.org/ns/1.0", "http://www.w3.org/XML/1998/namespace"
TEI, XML = "{" + TEI_URI + "}", "{" + XML_URI + "}"


def _row(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


AFFILIATION = StructType([*_row("institution", "department", "laboratory"), StructField("address", MapType(StringType(), StringType()))])
AUTHOR = StructType([*_row("name", "given_name", "surname"), StructField("affiliation", AFFILIATION)])
AUTHORS = StructField("authors", ArrayType(AUTHOR))
CITATION = StructType([*_row("id", "unstructured", "title", "journal"), AUTHORS, *_row("publisher", "date", "volume", "issue", "doi", "arxiv_id", "pmcid", "pmid", "pages", "url")])
INDEXED = StructType([*CITATION.fields, StructField("index", IntegerType())])
JOURNAL = StructType(_row("name", "publisher", "issn", "eissn", "volume", "issue"))
DOCUMENT = StructType(
    [*_row("grobid_version", "grobid_timestamp", "title"), AUTHORS, StructField("journal", JOURNAL), *_row("date", "release_ident", "doi"), StructField("citations", ArrayType(INDEXED)), *_row("language_code", "abstract", "body", "acknowledgement", "annex")]
)


def _strip_namespace(root: ET.Element) -> ET.Element:
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.removeprefix(TEI)
    return root


def _text(e: ET.Element, path: str) -> str | None:
    return e.findtext(path) or None


def _all_text(e: ET.Element | None) -> str | None:
    """The inner text of an element that has children; one without counts as absent."""
    return " ".join(e.itertext()).strip() or None if e is not None and len(e) else None


def parse_authors(e: ET.Element | None) -> list[dict]:
    out = []
    for author in [] if e is None else e.iterfind(".//author"):
        person = author.find("persName")
        if person is None or not len(person):
            continue
        own = {"name": " ".join(" ".join(person.itertext()).split()), "given_name": _text(person, "forename"), "surname": _text(person, "surname")}
        place = author.find("affiliation")
        if place is not None and len(place):
            at = place.find("address")
            own["affiliation"] = {o.get("type"): o.text for o in place.iterfind("orgName") if o.get("type")}
            own["affiliation"]["address"] = [(c.tag, c.text) for c in at] if at is not None and len(at) else None
        out.append(own)
    return out


def parse_citation(e: ET.Element) -> dict:
    article, whole = _text(e, ".//analytic/title"), _text(e, ".//monogr/title")
    date, page, link = e.find(".//date[@type='published']"), e.find(".//biblScope[@unit='page']"), e.find(".//ptr[@target]")
    pages = None
    if page is not None:
        a, b = page.get("from"), page.get("to")
        pages = f"{a}-{b}" if a and b else page.text
    number = lambda kind: _text(e, f".//idno[@type='{kind}']")
    part = lambda unit: _text(e, f".//biblScope[@unit='{unit}']")
    return {
        "id": e.get(XML + "id"), "unstructured": _text(e, ".//note[@type='raw_reference']"), "title": article or whole, "journal": whole if article else None, "authors": parse_authors(e),
        "publisher": _text(e, ".//publicationStmt/publisher") or _text(e, ".//imprint/publisher"), "date": None if date is None else date.get("when"), "volume": part("volume"), "issue": part("issue"),
        "doi": number("DOI"), "arxiv_id": number("arXiv"), "pmcid": number("PMCID"), "pmid": number("PMID"), "pages": pages, "url": None if link is None else link.get("target"),
    }


def parse_reference(xml: str | None) -> dict | None:
    """A single citation; null if it is no XML or has nothing in it."""
    try:
        ref = parse_citation(_strip_namespace(ET.fromstring(xml or "")))
    except ET.ParseError:
        return None
    return ref if any(ref.values()) else None


def parse_document(xml: str | None, encumbered: bool = True, ident_type: str = "release") -> dict | None:
    """Header, citations and, if ``encumbered``, texts of a TEI document; null if it isn't one.

    ``ident_type``: the type of the idno that holds the catalog's own ident.
    """
    try:
        root = _strip_namespace(ET.fromstring(xml or ""))
    except ET.ParseError:
        return None
    head = root if root.tag == "teiHeader" else root.find(".//teiHeader")
    if head is None:
        return None
    made, date, text = head.find(".//appInfo/application"), head.find(".//date[@type='published']"), root.find(".//text")
    journal = {
        "name": _text(head, ".//monogr/title"), "publisher": _text(head, ".//publicationStmt/publisher"), "issn": _text(head, ".//idno[@type='ISSN']"), "eissn": _text(head, ".//idno[@type='eISSN']"),
        "volume": _text(head, ".//biblScope[@unit='volume']"), "issue": _text(head, ".//biblScope[@unit='issue']"),
    }
    out = {
        "grobid_version": None if made is None else (made.get("version") or "").strip() or None, "grobid_timestamp": None if made is None else (made.get("when") or "").strip() or None,
        "title": _text(head, ".//analytic/title"), "authors": parse_authors(head.find(".//sourceDesc//biblStruct")) or None, "journal": journal if any(journal.values()) else None, "date": None if date is None else date.get("when"),
        "release_ident": _text(head, f".//idno[@type='{ident_type}']"), "doi": (_text(head, ".//idno[@type='DOI']") or "").lower() or None,
        "citations": [parse_citation(b) | {"index": i} for i, b in enumerate(root.iterfind(".//listBibl/biblStruct"))] or None,
        "language_code": text.get(XML + "lang") if text is not None and len(text) else None,
    }
    if encumbered:
        out |= {"abstract": _all_text(root.find(".//profileDesc/abstract")), "body": _all_text(root.find(".//text/body")), "acknowledgement": _all_text(root.find(".//back/div[@type='acknowledgement']")), "annex": _all_text(root.find(".//back/div[@type='annex']"))}
    return out


def _udf(kind: StructType, parse):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([parse(x) for x in a.to_pylist()], arrow)

    return parsed


def _corrected(ref: Column) -> Column:
    return ref.withField("arxiv_id", s.strip_arxiv(ref["arxiv_id"])).withField("url", s.fix_url(ref["url"]))


def citation(xml: Col) -> Column:
    """Struct of a citation's fields; null if it doesn't parse or has none."""
    ref = _udf(CITATION, parse_reference)(col(xml))
    return F.when(ref.isNotNull(), _corrected(ref))


def tei_document(xml: Col, encumbered: bool = True, ident_type: str = "release") -> Column:
    """Struct of a TEI document's fields; null if it isn't one."""
    doc = _udf(DOCUMENT, lambda x: parse_document(x, encumbered, ident_type))(col(xml))
    return F.when(doc.isNotNull(), doc.withField("citations", F.transform(doc["citations"], _corrected)))
