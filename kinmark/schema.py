"""Schemas of the records the engine works on; missing and JSON null are both SQL NULL."""

from __future__ import annotations

#: External identifiers in the order in which a lookup tries them.
ID_TYPES = ("doi", "wikidata_qid", "isbn13", "pmid", "pmcid", "core", "arxiv", "jstor", "ark", "mag", "doaj", "dblp", "oai")

AUTHOR = "struct<raw_name:string,given_name:string,surname:string>"
EXT_IDS = "struct<" + ",".join(f"{x}:string" for x in ID_TYPES) + ">"
RELATION = "struct<relatedIdentifier:string,relatedIdentifierType:string,relationType:string>"
EXTRA = f"struct<container_name:string,subtitle:array<string>,crossref:struct<type:string>,datacite:struct<metadataVersion:int,relations:array<{RELATION}>>,skate:struct<status:string>>"

_FIELDS = [
    "ident string", "work_id string", "container_id string", "title string", "release_type string", "release_stage string", "release_year string", "publisher string",
    "volume string", "issue string", "pages string", f"contribs array<{AUTHOR}>", f"ext_ids {EXT_IDS}", f"extra {EXTRA}",
]

#: A record as read from JSON: the year may be a number or a string there.
RELEASE_INPUT_DDL = ", ".join(_FIELDS)
#: A record in the engine: the year is an integer.
RELEASE_DDL = RELEASE_INPUT_DDL.replace("release_year string", "release_year int")
CONTAINER_DDL = "ident string, name string, issnl string, issns array<string>"
BIBLIO_DDL = (
    "title string, journal string, conference string, authors array<struct<name:string,given_name:string,surname:string>>, author_names array<string>, first_author string, year string, date string, "
    "volume string, issue string, pages string, first_page string, publisher string, doi string, pmid string, pmcid string, arxiv_id string, release_type string, release_stage string"
)


RELEASE_STRUCT = "struct<" + ",".join(f.replace(" ", ":", 1) for f in _FIELDS).replace("release_year:string", "release_year:int") + ">"
CLUSTER_DDL = f"k string, v array<{RELEASE_STRUCT}>"
CLUSTER_INPUT_DDL = CLUSTER_DDL.replace("release_year:int", "release_year:string")
