"""Detection and extraction of one document in plain Python: what the Arrow functions run for each row."""

from __future__ import annotations

from foliospark.config import Config, Profile
from foliospark.errors import ExtractFailure
from foliospark.operators import article_xml, html_article

XML_HEAD, HTML_HEAD = 2048, 150_000


def head(text: str, size: int) -> str:
    return text.encode("utf-8", "replace")[:size].decode("utf-8", "ignore")


def fits(text: str, profile: Profile) -> bool:
    if not profile.detect and not profile.detect_any:
        return False
    return all(m in text for m in profile.detect) and (not profile.detect_any or any(m in text for m in profile.detect_any))


def detect(ext: str, text: str, config: Config) -> tuple[str, str | None]:
    """(format name, profile key of an HTML page)."""
    if ext == "epub":
        return "epub", None
    if ext == "xml":
        start = head(text, XML_HEAD)
        if "<component" in start and "wiley" in start:
            return "wiley-xml", None
        return ("jats-xml" if "<article" in start else "unknown"), None
    if ext != "html":
        return "unknown", None
    start = head(text, HTML_HEAD)
    name = next((k for k, p in config.ordered if fits(start, p)), "other")
    return (name if name.endswith("-html") else f"{name}-html"), name


def extract_text(kind: str, profile_key: str | None, text: str, config: Config, strip_refs: bool = False) -> dict:
    if kind == "jats-xml":
        return article_xml.extract(text, article_xml.Jats)
    if kind == "wiley-xml":
        return article_xml.extract(text, article_xml.Wml)
    if profile_key is not None:
        return html_article.extract(text, config.profile(profile_key), strip_refs)
    raise ExtractFailure("unknown format")


def escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace('"', '\\"')


def rendered(id_: str, kind: str, found: dict) -> str:
    """The whole Markdown document; doi, id and format are written as they are."""
    out = ["---", f"id: {id_}", f"source_format: {kind}"]
    if found["title"] is not None:
        out.append(f'title: "{escaped(found["title"])}"')
    if found["authors"]:
        out += ["authors:", *[f'  - "{escaped(a)}"' for a in found["authors"]]]
    if found["doi"] is not None:
        out.append(f'doi: "{found["doi"]}"')
    if found["journal"] is not None:
        out.append(f'journal: "{escaped(found["journal"])}"')
    text = "\n".join([*out, "---", "", found["body"]])
    return text if text.endswith("\n") else text + "\n"
