"""HTML to typed page rows, in one Arrow pass.

What needs the markup is taken here once for each page: fields, links, images,
JSON-LD facts, accessibility findings.  What the text mentions, and rules, are
column expressions over that.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mentions import with_mentions

TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote figcaption td th dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "noscript"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_LINK = "array<struct<rel:string,href:string,hreflang:string>>"
FACTS = "items int, nodes int, types array<string>, faq boolean, faq_entities int, faq_pairs int, local_business boolean, organization boolean, person boolean, author boolean, publisher boolean, dated boolean, modified boolean, price boolean, howto boolean, telephone boolean, address boolean, place boolean, map boolean, hours boolean, rating boolean, review boolean, names array<string>, organization_names array<string>, services array<string>"
SCHEMA = (
    "site_id string, pos long, url string, status_code int, title string, description string, h1 string, h2 array<string>, h3 array<string>, meta map<string,string>, body_text string, word_count int, "
    "internal_links array<string>, external_links array<string>, images array<struct<src:string,alt:string,loading:string,width:string,height:string>>, canonical_url string, robots_meta string, html_lang string, last_modified string, "
    f"headings array<struct<level:int,text:string>>, text_blocks array<struct<tag:string,text:string>>, contact_links array<struct<kind:string,value:string>>, link_tags {_LINK}, ul int, ol int, tables int, has_faq boolean, "
    f"facts struct<{', '.join(f.replace(' ', ':', 1) for f in FACTS.split(', '))}>, a11y array<string>"
)
#: What the parser reads from markup, and with what its text mentions.
TOKENS = SCHEMA
SCHEMA = TOKENS.replace("a11y array<string>", "signals array<string>, phones array<struct<digits:string,area:string>>, addresses array<string>, valid_hours boolean, emails int, sentences array<string>, a11y array<string>")


def present(v) -> bool:
    if isinstance(v, str):
        return bool(v.strip())
    if isinstance(v, bool) or v is None:
        return False
    return True if isinstance(v, int | float) else bool(v)


def _types(node) -> list[str]:
    t = node.get("@type") if isinstance(node, dict) else None
    return [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []


def _each(v) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def nodes_of(items: list) -> list[dict]:
    """Objects of JSON-LD, arrays and @graph laid flat."""
    out, todo = [], list(reversed(items))
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            out.append(x)
            if isinstance(x.get("@graph"), list):
                todo += reversed(x["@graph"])
    return out


LOCAL_TYPES = re.compile(r"^(LocalBusiness|Bakery|Dentist|MedicalClinic|Hotel|LodgingBusiness|Restaurant|CafeOrCoffeeShop|Store|.*Business|.*Store|.*Shop|.*Salon|.*Clinic)$")
ORG_TYPES = re.compile(r"^(Organization|Corporation|.*Organization|LocalBusiness)$")


def schema_facts(items: list) -> dict:
    nodes = nodes_of(items)
    has = lambda *keys: any(present(n.get(k)) for n in nodes for k in keys)
    typed = lambda *names: any(t in names for n in nodes for t in _types(n))
    name = lambda n: n["name"].strip() if isinstance(n, dict) and isinstance(n.get("name"), str) and n["name"].strip() else None
    phone = lambda n: present(n.get("telephone")) or any(isinstance(c, dict) and present(c.get("telephone")) for c in _each(n.get("contactPoint")))
    local = [n for n in nodes if any(LOCAL_TYPES.match(t) for t in _types(n))]
    org = [n for n in nodes if any(ORG_TYPES.match(t) for t in _types(n))] + [n for n in local if not any(ORG_TYPES.match(t) for t in _types(n))]
    faqs = [q for n in nodes if "FAQPage" in _types(n) for q in _each(n.get("mainEntity")) if isinstance(q, dict)]
    answer = lambda q: (lambda a: a.get("text") if isinstance(a, dict) else a)(q.get("acceptedAnswer") or q.get("suggestedAnswer"))
    offers = [o for n in nodes for o in _each(n.get("offers")) if isinstance(o, dict)]
    spec = [n["priceSpecification"] for n in nodes if isinstance(n.get("priceSpecification"), dict)]
    offered = [x for n in nodes for o in _each(n.get("makesOffer")) + _each((n.get("hasOfferCatalog") or {}).get("itemListElement") if isinstance(n.get("hasOfferCatalog"), dict) else None) if isinstance(o, dict) for x in (o, o.get("itemOffered"))]
    services = [s for s in ([name(n) for n in nodes if set(_types(n)) & {"Service", "Offer", "Product"}] + [name(n.get("itemOffered")) for n in nodes] + [name(x) for x in offered]) if s]
    rated = [n.get("aggregateRating") for n in nodes if present(n.get("aggregateRating"))]
    return {
        "items": sum(len(x) if isinstance(x, list) else 1 for x in items), "nodes": len(nodes), "types": sorted({t for n in nodes for t in _types(n)}), "faq": typed("FAQPage"),
        "faq_entities": sum("Question" in _types(q) or present(q.get("name")) or "@type" not in q for q in faqs), "faq_pairs": sum("Question" in _types(q) and present(q.get("name")) and present(answer(q)) for q in faqs),
        "local_business": any(name(n) and (present(n.get("address")) or phone(n)) for n in local), "organization": bool(org), "person": typed("Person"), "author": has("author"), "publisher": has("publisher"),
        "dated": has("datePublished", "dateModified"), "modified": has("dateModified"),
        "price": has("price", "lowPrice", "highPrice") or any(present(o.get("price")) for o in offers) or any(present(s.get(k)) for s in spec for k in ("price", "minPrice", "maxPrice")),
        "howto": any("HowTo" in _types(n) and (len(n["step"]) >= 2 if isinstance(n.get("step"), list) else present(n.get("step"))) for n in nodes),
        "telephone": any(phone(n) for n in nodes), "address": has("address"), "place": has("address", "geo", "hasMap"), "map": has("hasMap"), "hours": has("openingHours", "openingHoursSpecification"),
        "rating": bool(rated) or has("review"), "review": typed("Review") or has("review") or any(isinstance(r, dict) and any(present(r.get(k)) for k in ("ratingValue", "reviewCount", "ratingCount")) for r in rated),
        "names": [x for x in map(name, nodes) if x], "organization_names": [x for x in map(name, org) if x], "services": services,
    }


class PageParser(HTMLParser):
    """Fields of one page; open text elements gather what is said in them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.titles: list[str] = []
        self.lang = None
        self.meta: dict[str, str] = {}
        self.blocks: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.body: list[str] = []
        self.in_body, self.seen_body = False, False
        self.silent = 0
        self.json: list[str] | None = None
        self.ld: list = []
        self.links: list[dict] = []
        self.anchors: list[tuple[str, list[str], dict]] = []
        self.images: list[dict] = []
        self.count = {"ul": 0, "ol": 0, "table": 0}
        self.title_open = False
        self.ids: dict[str, int] = {}
        self.found: list[str] = []
        self.labels: set[str] = set()
        self.controls: list[tuple[str, dict, bool]] = []
        self.buttons: list[tuple[dict, list[str]]] = []
        self.landmarks = 0

    def _close(self, names: tuple[str, ...], bounds: tuple[str, ...] = ()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                del self.open[k:]
                return
            if self.open[k][0] in bounds:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "") for k, v in reversed(attrs)}
        if tag == "html":
            self.lang = self.lang or (a.get("lang") or "").strip() or None
            return
        if tag == "body" or (not self.seen_body and tag not in ("head", "title", "meta", "link", "base", *SILENT)):
            self.in_body = self.seen_body = True
            if tag == "body":
                return
        if tag in CLOSES_P:
            self._close(("p",), ("td", "th", "button"))
        if tag in SELF_CLOSING:
            self._close(SELF_CLOSING[tag], ("ul", "ol", "dl", "table") if tag in ("li", "dt", "dd") else ("table",))
        if a.get("id"):
            self.ids[a["id"]] = self.ids.get(a["id"], 0) + 1
        if tag in SILENT:
            self.silent += 1
            if tag == "script" and a.get("type", "").strip() == "application/ld+json":
                self.json = []
        elif tag == "title":
            self.title_open = not self.in_body or not self.titles
            if self.title_open:
                self.titles.append("")
        elif tag == "meta":
            name = a.get("name") or a.get("property") or a.get("http-equiv")
            if name and "content" in a:
                self.meta[name.lower()] = a["content"]
        elif tag == "link":
            self.links.append({"rel": a["rel"].strip().lower() if a.get("rel") else None, "href": a["href"].strip() if a.get("href") else None, "hreflang": a["hreflang"].strip() if a.get("hreflang") else None})
        elif tag == "img" and a.get("src"):
            given = lambda k: a[k].strip() or None if a.get(k) else None
            self.images.append({"src": a["src"], "alt": a.get("alt"), "loading": (given("loading") or "").lower() or None, "width": given("width"), "height": given("height")})
        self._look(tag, a)
        if tag in self.count:
            self.count[tag] += 1
        if tag in VOID:
            return
        held: list[str] | None = None
        if tag in TEXT_TAGS and self.in_body:
            held = []
            self.blocks.append((tag, held))
        elif tag == "a" and "href" in a:
            held = []
            self.anchors.append((a["href"].strip(), held, a))
        elif tag == "button":
            held = []
            self.buttons.append((a, held))
        self.open.append((tag, held))

    def _look(self, tag: str, a: dict) -> None:
        """What accessibility checks need of a start tag."""
        if tag == "img" and "alt" not in a and a.get("role") not in ("presentation", "none") and a.get("aria-hidden") != "true":
            self.found.append("image-alt")
        if tag == "label" and a.get("for"):
            self.labels.add(a["for"])
        if tag in ("input", "select", "textarea"):
            inside = any(t == "label" for t, _ in self.open)
            self.controls.append((tag, a, inside))
        if tag == "main" or a.get("role") == "main":
            self.landmarks += 1
        if a.get("tabindex", "").strip().lstrip("+").isdigit() and int(a["tabindex"]) > 0:
            self.found.append("tabindex")
        if tag == "li" and not any(t in ("ul", "ol", "menu") for t, _ in self.open):
            self.found.append("list")
        if tag in ("video", "audio"):
            if "autoplay" in a and "muted" not in a:
                self.found.append("autoplay")
        if a.get("aria-hidden") == "true" and tag in ("a", "button", "input", "select", "textarea") and a.get("tabindex") != "-1":
            self.found.append("focusable-content")
        for k in a:
            if k.startswith("aria-") and k[5:] not in ARIA:
                self.found.append("aria-valid-attr")
        style = a.get("style", "")
        if re.search(r"outline\s*:\s*(none|0)\b", style):
            self.found.append("focus-order-semantics")
        if style and _low_contrast(style):
            self.found.append("color-contrast")

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
            if tag == "script" and self.json is not None:
                try:
                    x = json.loads("".join(self.json))
                    self.ld += x if isinstance(x, list) else [x]
                except ValueError:
                    pass
                self.json = None
        elif tag == "title":
            self.title_open = False
        elif tag == "head":
            self.in_body = self.in_body or False
        else:
            self._close((tag,))

    def handle_data(self, data: str) -> None:
        if self.json is not None:
            self.json.append(data)
        if self.silent:
            return
        if self.title_open:
            self.titles[-1] += data
            return
        if not self.in_body:
            if not data.strip():
                return
            self.in_body = self.seen_body = True
        self.body.append(data)
        for _, held in self.open:
            if held is not None:
                held.append(data)


ARIA = frozenset(
    "activedescendant atomic autocomplete braillelabel brailleroledescription busy checked colcount colindex colindextext colspan controls current describedby description details disabled dropeffect errormessage expanded flowto grabbed haspopup hidden invalid keyshortcuts label labelledby level live modal multiline multiselectable orientation owns placeholder posinset pressed readonly relevant required roledescription rowcount rowindex rowindextext rowspan selected setsize sort valuemax valuemin valuenow valuetext".split()
)


def _colour(text: str) -> tuple[float, float, float] | None:
    m = re.match(r"\s*#([0-9a-f]{3}|[0-9a-f]{6})\b", text, re.I)
    if m:
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return tuple(int(h[k : k + 2], 16) / 255 for k in (0, 2, 4))
    m = re.match(r"\s*rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", text)
    if m:
        return tuple(min(int(x), 255) / 255 for x in m.groups())
    return {"white": (1.0, 1.0, 1.0), "black": (0.0, 0.0, 0.0)}.get(text.strip().lower())


def _low_contrast(style: str) -> bool:
    """Whether an element's own colours are below a contrast of 4.5."""
    rules = {k.strip().lower(): v for k, _, v in (d.partition(":") for d in style.split(";"))}
    fore, back = _colour(rules.get("color", "")), _colour(rules.get("background-color", rules.get("background", "")))
    if not fore or not back:
        return False
    light = [sum(w * (c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4) for w, c in zip((0.2126, 0.7152, 0.0722), x, strict=True)) for x in (fore, back)]
    return (max(light) + 0.05) / (min(light) + 0.05) < 4.5


def _squash(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _site(url: str) -> str:
    try:
        h = (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""
    return h[4:] if h.startswith("www.") else h


def _findings(p: PageParser, headings: list[dict]) -> list[str]:
    out = list(p.found)
    for tag, a, inside in p.controls:
        kind = a.get("type", "text").lower() if tag == "input" else tag
        named = inside or a.get("id") in p.labels or any(a.get(k, "").strip() for k in ("aria-label", "aria-labelledby", "title"))
        if kind in ("submit", "button", "reset"):
            if not (a.get("value", "").strip() or named or kind != "button"):
                out.append("input-button-name")
        elif kind not in ("hidden", "image") and not named:
            out.append("label")
    for a, held in p.buttons:
        if not (_squash(held) or any(a.get(k, "").strip() for k in ("aria-label", "aria-labelledby", "title"))):
            out.append("button-name")
    for _, held, a in p.anchors:
        if not (_squash(held) or any(a.get(k, "").strip() for k in ("aria-label", "aria-labelledby", "title"))):
            out.append("link-name")
    if not p.lang:
        out.append("html-has-lang")
    elif not re.match(r"^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$", p.lang):
        out.append("html-lang-valid")
    if not (p.titles and p.titles[0].strip()):
        out.append("document-title")
    if any(b["level"] > a["level"] + 1 for a, b in zip(headings, headings[1:], strict=False)):
        out.append("heading-order")
    if p.landmarks != 1:
        out.append("landmark-one-main")
    if any(n > 1 for n in p.ids.values()):
        out.append("duplicate-id")
    if re.search(r"user-scalable\s*=\s*no|maximum-scale\s*=\s*1(\.0)?\b", p.meta.get("viewport", "")):
        out.append("meta-viewport")
    return sorted(set(out))


def parse_page(html: str, url: str) -> dict:
    p = PageParser()
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError, RecursionError):  # what was read so far stands
        pass
    text = {id(held): _squash(held) for _, held in p.blocks}
    blocks = [{"tag": t, "text": text[id(held)]} for t, held in p.blocks if text[id(held)]]
    headings = [{"level": int(b["tag"][1]), "text": b["text"]} for b in blocks if re.fullmatch("h[1-6]", b["tag"])]
    body = _squash(p.body)
    inner, outer, contact = [], [], []
    for href, held, _ in p.anchors:
        low = href.lower()
        if not href or low.startswith(("javascript:", "#")):
            continue
        kind = next((k for k in ("mailto", "tel") if low.startswith(f"{k}:")), None)
        if kind:
            contact.append({"kind": kind, "value": re.split(r"[?#]", href[len(kind) + 1 :])[0]})
            continue
        try:
            full = urljoin(url, href)
        except ValueError:
            continue
        if re.match(r"(?i)https?://", full):
            (inner if _site(full) == _site(url) else outer).append(full.rstrip("/") if _site(full) == _site(url) and urlsplit(full).path.strip("/") else full)
    canonical = next((x["href"] for x in p.links if x["rel"] == "canonical" and x["href"]), None)
    meta = p.meta
    facts = schema_facts(p.ld)
    h2, h3 = ([h["text"] for h in headings if h["level"] == k] for k in (2, 3))
    faq = re.compile(r"자주\s*묻는\s*질문|FAQ|Q&A", re.I)
    return {
        "title": (p.titles[0].strip() or None) if p.titles else None, "description": meta.get("description"), "h1": next((h["text"] for h in headings if h["level"] == 1), None), "h2": h2, "h3": h3, "meta": meta,
        "body_text": body, "word_count": len(body.split()), "internal_links": list(dict.fromkeys(inner)), "external_links": list(dict.fromkeys(outer)),
        "images": [x | {"src": urljoin(url, x["src"]) if not x["src"].startswith("data:") else x["src"]} for x in p.images], "canonical_url": urljoin(url, canonical) if canonical else None, "robots_meta": meta.get("robots"), "html_lang": p.lang,
        "last_modified": meta.get("article:modified_time") or meta.get("og:updated_time") or meta.get("last-modified"), "headings": headings, "text_blocks": blocks, "contact_links": contact, "link_tags": p.links,
        "ul": p.count["ul"], "ol": p.count["ol"], "tables": p.count["table"], "has_faq": facts["faq"] or any(faq.search(h) for h in h2 + h3), "facts": facts,
        "a11y": _findings(p, headings),
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages: site_id, pos, url, html, status_code.  One row per row; null html
    or url count as empty.  Markup that is not well formed never fails.  Python reads
    the markup; what the text mentions are expressions over that."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(at, 200).to_pylist():
                    page = parse_page(r["html"] or "", r["url"] or "")
                    page["meta"] = list(page["meta"].items())
                    rows.append({k: r[k] for k in ("site_id", "pos", "url", "status_code")} | page)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    read = pages.select(F.col("site_id").cast("string"), F.col("pos").cast("long"), "url", "html", F.col("status_code").cast("int")).mapInArrow(run, TOKENS)
    return with_mentions(read).select(*(f.name for f in _parse_datatype_string(SCHEMA).fields))
