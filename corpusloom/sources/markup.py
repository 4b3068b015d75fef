"""What XML, wikitext and HTML need beyond built-in expressions: small functions over one record, run in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

#: Wiki sections without content.
WIKI_TAILS = {"references", "external links", "see also", "further reading", "notes"}


def name_of(element: ET.Element) -> str:
    return re.sub(r"^\{.*\}", "", element.tag) if isinstance(element.tag, str) else ""


def text_of(element: ET.Element | None) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip() if element is not None else ""


def named(root: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if name_of(e) in names)


def first_text(root: ET.Element, *names: str) -> str:
    return next((t for e in named(root, *names) if (t := text_of(e))), "")


def blocks(body: ET.Element) -> Iterator[tuple[str, str]]:
    """(heading, paragraph) in document order; a paragraph stands under the last title before it."""
    heading = "Content"
    for e in body.iter():
        kind, text = name_of(e), ""
        if kind in {"title", "p", "list-item", "caption"}:
            text = text_of(e)
        if not text:
            continue
        if kind == "title":
            heading = text
        else:
            yield heading, text


def sections(root: ET.Element) -> str:
    """Abstract, then the body's paragraphs under their headings; without a body the whole record is taken."""
    out: list[tuple[str, list[str]]] = []
    if abstract := first_text(root, "abstract"):
        out.append(("Abstract", [abstract]))
    before = len(out)
    for heading, text in blocks(next(named(root, "body", "book-body"), root)):
        if len(out) == before or out[-1][0] != heading:
            out.append((heading, []))
        out[-1][1].append(text)
    return "\n\n".join(f"## {h}\n\n" + "\n\n".join(ps) for h, ps in out)


def article(xml: str) -> dict:
    """One article or book part as a record."""
    root = ET.fromstring(re.sub(r"^\s*(<\?xml.*?\?>|<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>|\s)+", "", xml, flags=re.S))
    ids: dict[str, str] = {}
    for e in named(root, "article-id", "book-part-id"):
        kind = (e.get("pub-id-type") or e.get("book-part-id-type") or "").lower()
        if text := text_of(e):
            ids.setdefault("pmc" if kind == "pmcid" else kind, text)
    people = [" ".join(x for x in (first_text(c, "given-names"), first_text(c, "surname")) if x) for c in named(root, "contrib", "author")]
    return {
        "external_id": ids.get("pmc") or ids.get("pmid"),
        "doi": ids.get("doi"),
        "title": first_text(root, "article-title", "book-part-title", "title"),
        "authors": list(dict.fromkeys(p for p in people if p))[:100],
        "published": first_text(root, "year") or None,
        "text": sections(root),
    }


def descriptor(xml: str) -> dict:
    """One subject-heading record: its texts in a fixed order of kinds, each once."""
    root = ET.fromstring(xml)
    texts = [text_of(e) for kind in ("Annotation", "ScopeNote", "HistoryNote", "Term", "TreeNumber") for e in named(root, kind)]
    title = first_text(root, "DescriptorName", "String")
    return {"external_id": first_text(root, "DescriptorUI"), "title": title, "text": "\n\n".join([f"## MeSH descriptor\n\n{title}", *dict.fromkeys(t for t in texts if t)])}


def citation(xml: str) -> dict:
    """One PubMed citation: labelled abstract parts, subject headings, keywords, types and ids."""
    root = ET.fromstring(xml)
    cite = root.find("MedlineCitation")
    data = cite.find("Article") if cite is not None else None
    if data is None:
        return {"pmid": None, "title": None, "abstract": None}
    labelled = lambda e: ": ".join(x for x in (e.get("Label") or e.get("NlmCategory"), text_of(e)) if x)
    parts = [labelled(e) for e in data.findall("Abstract/AbstractText") if text_of(e)]
    mesh = [(text_of(e), e.get("UI"), e.get("MajorTopicYN") == "Y") for e in cite.findall("MeshHeadingList/MeshHeading/DescriptorName") if text_of(e)]
    date = data.find("Journal/JournalIssue/PubDate")
    return {
        "pmid": text_of(cite.find("PMID")) or None,
        "title": text_of(data.find("ArticleTitle")) or None,
        "abstract": "\n".join(parts) or None,
        "journal": text_of(data.find("Journal/Title")) or None,
        "year": (first_text(date, "Year") or first_text(date, "MedlineDate") or None) if date is not None else None,
        "doi": next((text_of(e) for e in root.findall("PubmedData/ArticleIdList/ArticleId") if e.get("IdType") == "doi"), None),
        "languages": [text_of(e).lower() for e in data.findall("Language") if text_of(e)],
        "publication_types": [text_of(e) for e in data.findall("PublicationTypeList/PublicationType") if text_of(e)],
        "keywords": sorted({text_of(e) for e in cite.findall("KeywordList/Keyword") if text_of(e)}),
        "mesh": [{"name": n, "ui": u, "major": m} for n, u, m in mesh],
    }


def wiki_plain(text: str) -> str:
    """Wikitext without templates, tables, references, files, links and emphasis."""
    text = re.sub(r"<!--.*?-->|<ref[^>]*/>|<ref.*?</ref>", "", text, flags=re.S)
    for form in (r"\{\{[^{}]*\}\}", r"\{\|[^{}]*?\|\}"):
        while form and (shorter := re.sub(form, "", text, flags=re.S)) != text:
            text = shorter
    text = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"\[https?://\S+\s*([^\]]*)\]", r"\1", text)
    text = re.sub(r"'{2,}|<[^>]+>|\[\d+\]", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def wiki_sections(text: str) -> str:
    """Sections of levels two to four under their headings, in a flat list, without tail sections."""
    parts = re.split(r"(?m)^={2,4}\s*(.+?)\s*={2,4}\s*$", text)
    pairs = [("Introduction", parts[0]), *zip(parts[1::2], parts[2::2])]
    plain = [(wiki_plain(h), wiki_plain(b)) for h, b in pairs]
    return "\n\n".join(f"## {h}\n\n{b}" for h, b in plain if b and h.casefold() not in WIKI_TAILS)


class _Events(HTMLParser):
    """Tags and texts in order, as (kind, value)."""

    def reset(self) -> None:
        super().reset()
        self.events: list[tuple[str, object]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append((f"/{tag}", None))

    def handle_data(self, data):
        self.events.append(("text", data))


def links(html: str, base: str) -> list[tuple[str, str]]:
    """(absolute address, title) of each anchor, without fragments; script, mail and telephone links are left out.

    The title is the anchor's own, then its texts and what its images are called, white space collapsed.
    """
    source = _Events(convert_charrefs=True)
    source.feed(html)
    source.close()
    out: list[tuple[str, str]] = []
    events = source.events
    for i, (kind, value) in enumerate(events):
        if kind != "a" or not value.get("href") or re.match(r"\s*(javascript|mailto|tel):", value["href"], re.I):
            continue
        named_ = [value.get("title")]
        for inner, v in events[i + 1 :]:
            if inner in ("a", "/a"):
                break
            named_ += [v] if inner == "text" else [v.get("alt"), v.get("title")] if inner == "img" else []
        out.append((urldefrag(urljoin(base, value["href"].strip()))[0], " ".join(" ".join(x or "" for x in named_).split())))
    return out
