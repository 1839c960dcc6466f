"""Article sources: publisher XML and JATS to nested rows, file hashes, JSON sinks.

XML is read with expat without namespaces, so a prefixed tag is matched by its local name whether
its prefix is declared or not. A file that cannot be parsed is a row with ``error`` set.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, content_hash string, format string, paper_id string, doi string, title string, year int, journal string, abstract string, highlights array<string>, keywords array<string>, "
    "authors array<struct<ordinal:int,full_name:string,given_name:string,surname:string,email:string,orcid:string,affiliations:array<string>>>, "
    "sections array<struct<section_id:string,parent_section_id:string,title:string,section_type:string,level:int,ordinal:int,text:string>>, "
    "tables array<struct<table_id:string,ordinal:int,label:string,caption:string,text:string,rows:int,columns:int>>, "
    "figures array<struct<figure_id:string,ordinal:int,label:string,caption:string>>, "
    "refs array<struct<reference_id:string,label:string,title:string,doi:string,source_text:string>>, error string"
)


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    parts: list = field(default_factory=list)

    @property
    def children(self) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element)]

    def all(self, *tags: str) -> Iterator[Element]:
        for c in self.children:
            if c.tag in tags:
                yield c
            yield from c.all(*tags)

    def first(self, *tags: str) -> Element | None:
        return next(self.all(*tags), None)

    def text(self) -> str:
        """Rendered text: placeholders for equations, tables and figures, in reading order."""
        out = []
        for p in self.parts:
            if isinstance(p, str):
                out.append(p)
            elif p.tag in ("math", "formula", "disp-formula", "inline-formula"):
                inner = tidy("".join(x for x in _strings(p)))
                out.append(f" [Equation {inner}] " if inner else " [Equation] ")
            elif p.tag in ("table", "table-wrap"):
                out.append(f" [Table: {_said(p, 'label') or _said(p, 'caption') or 'table'}] ")
            elif p.tag in ("figure", "fig"):
                out.append(f" [Figure: {_said(p, 'label') or _said(p, 'caption') or 'figure'}] ")
            else:
                out.append(p.text())
        return tidy("".join(out))


def _strings(e: Element) -> Iterator[str]:
    for p in e.parts:
        if isinstance(p, str):
            yield p
        else:
            yield from _strings(p)


def _said(e: Element | None, *tags: str) -> str:
    hit = e.first(*tags) if e else None
    return hit.text() if hit else ""


def tidy(s: str) -> str:
    return re.sub(r"\s+([,.;:!?])", r"\1", re.sub(r"\s+", " ", s)).strip()


def slug(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-") or "unknown"


def parse_xml(data: bytes) -> Element:
    root = Element("", {})
    stack = [root]
    p = expat.ParserCreate()

    def start(name: str, attrs: dict[str, str]) -> None:
        e = Element(name.rsplit(":", 1)[-1], {k.rsplit(":", 1)[-1]: v for k, v in attrs.items()})
        stack[-1].parts.append(e)
        stack.append(e)

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: stack.pop()
    p.CharacterDataHandler = lambda s: stack[-1].parts.append(s)
    p.Parse(data, True)
    return root.children[0]


def _kind(title: str) -> str:
    from paperloom.functions.text import SECTION_KINDS

    s = slug(title)
    return next((k for part, k in SECTION_KINDS if part in s), "body")


def _sections(parent: Element, paper_id: str, tags: tuple[str, ...], title_tags: tuple[str, ...], paragraph_tags: tuple[str, ...], out: list[dict], level: int = 1, above: str | None = None) -> None:
    for e in parent.children:
        if e.tag in tags:
            title = _said_direct(e, title_tags)
            sid = slug(f"{paper_id}-{e.attrs.get('id') or f'section-{len(out) + 1}'}")
            paragraphs = [c.text() for c in e.children if c.tag in paragraph_tags]
            for lists in (c for c in e.children if c.tag == "list"):
                paragraphs += [i.text() for i in lists.all("list-item")]
            out.append({"section_id": sid, "parent_section_id": above, "title": title, "section_type": _kind(title), "level": level, "ordinal": len(out), "text": "\n".join(p for p in paragraphs if p)})
            _sections(e, paper_id, tags, title_tags, paragraph_tags, out, level + 1, sid)
        elif e.tag in ("sections", "body"):
            _sections(e, paper_id, tags, title_tags, paragraph_tags, out, level, above)


def _said_direct(e: Element, tags: tuple[str, ...]) -> str:
    return next((c.text() for c in e.children if c.tag in tags), "")


def _tables(root: Element, paper_id: str, wraps: tuple[str, ...]) -> list[dict]:
    out = []
    for k, t in enumerate(root.all(*wraps)):
        rows = [[c.text() for c in r.children if c.tag in ("entry", "td", "th")] for r in t.all("row", "tr")]
        lines = [x for x in (_said(t, "label"), _said(t, "caption"), *(f"Row {i + 1}: {' | '.join(r)}" for i, r in enumerate(rows))) if x]
        out.append({"table_id": slug(f"{paper_id}-{t.attrs.get('id') or f'table-{k + 1}'}"), "ordinal": k, "label": _said(t, "label"), "caption": _said(t, "caption"), "text": "\n".join(lines), "rows": len(rows), "columns": max(map(len, rows), default=0)})
    return out


def _figures(root: Element, paper_id: str, wraps: tuple[str, ...]) -> list[dict]:
    return [{"figure_id": slug(f"{paper_id}-{f.attrs.get('id') or f'figure-{k + 1}'}"), "ordinal": k, "label": _said(f, "label"), "caption": _said(f, "caption")} for k, f in enumerate(root.all(*wraps))]


def glue(parts: list[str]) -> str:
    """Short keyword parts with a single letter belong together."""
    return "".join(parts) if len(parts) <= 3 and any(len(p) == 1 for p in parts) else " ".join(parts)


def parse_publisher(root: Element) -> dict:
    doi = _said(root, "doi")
    paper_id = slug(doi) if doi else "journal-article"
    head, tail = root.first("head") or root, root.first("tail") or root
    places = {a.attrs.get("id", ""): _said(a, "textfn") or a.text() for a in head.all("affiliation")}
    authors = []
    for k, a in enumerate(head.all("author")):
        given, surname = _said(a, "given-name"), _said(a, "surname")
        refs = [places[c.attrs["refid"]] for c in a.all("cross-ref") if c.attrs.get("refid") in places]
        authors.append({"ordinal": k, "full_name": " ".join(x for x in (given, surname) if x) or f"Author {k + 1}", "given_name": given or None, "surname": surname or None, "email": _said(a, "e-address") or None, "orcid": a.attrs.get("orcid"), "affiliations": refs})
    abstracts = [a for a in head.all("abstract")]
    plain = next((re.sub(r"^Abstract:?\s*", "", a.text()) for a in abstracts if "highlight" not in a.attrs.get("class", "")), "")
    marks = [x.strip() for a in abstracts if "highlight" in a.attrs.get("class", "") for x in a.text().split("•") if x.strip()]
    years = [root.first("copyright").attrs.get("year")] if root.first("copyright") else []
    years += re.findall(r"(?:19|20)\d\d", " ".join(" ".join([*e.attrs.values(), e.text()]) for e in root.all("date-accepted")))
    sections: list[dict] = []
    _sections(root.first("body") or Element("", {}), paper_id, ("section",), ("section-title", "title"), ("para", "simple-para"), sections)
    refs = []
    for k, r in enumerate(tail.all("bib-reference")):
        source = _said(r, "source-text") or r.text()
        refs.append({"reference_id": r.attrs.get("id") or f"ref-{k + 1}", "label": _said(r, "label"), "title": _said(r, "maintitle", "title") or None, "doi": _said(r, "doi") or None, "source_text": source})
    return {
        "format": "publisher", "paper_id": paper_id, "doi": doi or None, "title": _said(head, "title"), "year": next((int(y) for y in years if y), None), "journal": _said(root, "jid", "journal-title") or None, "abstract": plain,
        "highlights": marks, "keywords": [glue(k.text().split()) for k in head.all("keyword") if k.text()], "authors": authors, "sections": sections, "tables": _tables(root, paper_id, ("table",)), "figures": _figures(root, paper_id, ("figure",)), "refs": refs,
    }


def parse_jats(root: Element) -> dict:
    doi = next((e.text() for e in root.all("article-id") if e.attrs.get("pub-id-type") == "doi"), "")
    paper_id = slug(doi) if doi else "journal-article"
    authors = []
    for k, a in enumerate(c for c in root.all("contrib") if c.attrs.get("contrib-type", "author") == "author"):
        given, surname = _said(a, "given-names"), _said(a, "surname")
        authors.append({"ordinal": k, "full_name": " ".join(x for x in (given, surname) if x) or f"Author {k + 1}", "given_name": given or None, "surname": surname or None, "email": _said(a, "email") or None, "orcid": _said(a, "contrib-id") or None, "affiliations": [x.text() for x in a.all("aff")]})
    sections = []
    for e in (root.first("body") or Element("", {})).all("sec"):
        title = _said_direct(e, ("title",))
        sections.append({"section_id": slug(f"{paper_id}-{e.attrs.get('id') or f'section-{len(sections) + 1}'}"), "parent_section_id": None, "title": title, "section_type": _kind(title), "level": 1, "ordinal": len(sections), "text": "\n".join(p.text() for p in e.all("p"))})
    refs = [{"reference_id": r.attrs.get("id") or f"ref-{k + 1}", "label": _said(r, "label"), "title": _said(r, "article-title") or None, "doi": next((p.text() for p in r.all("pub-id") if p.attrs.get("pub-id-type") == "doi"), None), "source_text": r.text()} for k, r in enumerate(root.all("ref"))]
    year = _said(root.first("pub-date"), "year")
    return {
        "format": "jats", "paper_id": paper_id, "doi": doi or None, "title": _said(root, "article-title"), "year": int(year) if year.isdigit() else None, "journal": _said(root, "journal-title") or None, "abstract": _said(root, "abstract"),
        "highlights": [], "keywords": [k.text() for k in root.all("kwd")], "authors": authors, "sections": sections, "tables": _tables(root, paper_id, ("table-wrap",)), "figures": _figures(root, paper_id, ("fig",)), "refs": refs,
    }


#: Formats in order; the first whose test holds parses the file.
PARSERS: list[tuple[Callable[[Element], bool], Callable[[Element], dict]]] = [
    (lambda r: r.tag == "article" and (r.first("article-meta") is not None or r.first("front") is not None), parse_jats),
    (lambda r: r.first("head") is not None or r.first("body") is not None, parse_publisher),
]


def register(test: Callable[[Element], bool], parse: Callable[[Element], dict]) -> None:
    """A further format; it is asked before the others."""
    PARSERS.insert(0, (test, parse))


def parse_article(data: bytes, parsers: list | None = None) -> dict:
    root = parse_xml(data)
    for test, parse in parsers or PARSERS:
        if test(root):
            return parse(root)
    raise ValueError(f"no parser for <{root.tag}>")


_FIELDS = [f.split(" ")[0] for f in re.split(r", (?=[a-z_]+ (?:string|int|array))", SCHEMA)]


def read_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.xml`` of a folder as a row of :data:`SCHEMA`, with the hash of its content."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder))


def parse_files(binary: DataFrame) -> DataFrame:
    """``binary(path, content)`` to rows of :data:`SCHEMA`, by the parsers registered now."""
    parsers = list(PARSERS)  # goes to the executors, whose own module knows only the built-in ones
    files = binary.select("path", F.sha2("content", 256).alias("content_hash"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    row = {**parse_article(bytes(r.content), parsers), "error": None}
                except Exception as e:  # noqa: BLE001 - a bad file must not stop the others
                    row = {"error": str(e)[:500]}
                rows.append({**dict.fromkeys(_FIELDS), **row, "path": r.path, "content_hash": r.content_hash})
            yield pd.DataFrame(rows, columns=_FIELDS).astype(object)

    return files.mapInPandas(run, SCHEMA)


def child_table(articles: DataFrame, column: str) -> DataFrame:
    """The rows of a nested list with their paper."""
    return articles.where("error is null").select("paper_id", F.explode(column).alias("x")).select("paper_id", "x.*")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def visible_text(markup: str | None) -> str:
    """The text of an HTML page: without scripts, styles and tags, entities resolved."""
    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", markup or "")
    return tidy(html.unescape(re.sub(r"(?s)<[^>]+>", " ", t)))
