"""Publisher profiles and settings, and how layers of settings merge: maps deeply, lists and scalars by replacement."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from foliospark.errors import EngineError


@dataclass(frozen=True)
class Profile:
    detect: tuple[str, ...] = ()
    detect_any: tuple[str, ...] = ()
    body_selectors: tuple[str, ...] = ()
    cruft_selectors: tuple[str, ...] = ()
    ref_selector: str | None = None
    fulltext_required: str | None = None
    no_content_marker: str | None = None
    content_marker: str | None = None
    abstract_only: bool = False


@dataclass(frozen=True)
class SplitConfig:
    subdir: str = "{book}"
    file: str = "{n}-{slug}.md"
    front: str = "00-frontmatter.md"
    pad: int = 2


# The markers and selectors by which pages of these publishers are known and cut.

FALLBACK = Profile(
    body_selectors=("article", "main", "div.article-body", "div.content"),
    cruft_selectors=("nav", "footer", "header", "script", "style", "div.sidebar", "aside"),
)

PUBLISHERS: dict[str, Profile] = {
    "springer": Profile(
        detect_any=("c-article-body", "c-article-title"),
        body_selectors=("div.c-article-body", "main.c-chapter-body", "article#main"),
        cruft_selectors=(
            "div.c-article-recommendations", "aside.c-article-sidebar", "nav", "footer", "header.eds-c-header", "header.c-header",
            'div[data-test="cobranding-download"]', 'section[data-title="Inline Recommendations"]', "div#MagazineFulltextArticleBodySuffix",
            "div.c-article-author-institutional-author", "script", "style", "div.c-article-identifiers",
        ),
        ref_selector='section[data-title="References"]',
    ),
    "wiley-html": Profile(
        detect_any=("article__content", "onlinelibrary.wiley.com", "onlinelibrary-wiley-com"),
        body_selectors=("div#article__content", "div.article__body", 'article[lang="en"]'),
        cruft_selectors=(
            "div.advert", "div.main-footer", "div.banner-wrapper", "nav", "div.mange-cookies-btn", "div.article-tools__block", "div.coolBar",
            "div.articleAdvert", "script", "style",
        ),
        ref_selector="section.article-section__references",
    ),
    "tandf": Profile(
        detect_any=("hlFld-Fulltext", "hlFld-Abstract", "tandfonline.com", "tandfonline-com"),
        fulltext_required="hlFld-Fulltext",
        body_selectors=("div.hlFld-Fulltext", "article.article"),
        cruft_selectors=("div.articleMetricsContainer", "div.articleTools", "div.widget", "div.pb-dropzone", "div.articleMeta", "script", "style", "nav"),
        ref_selector="div#references-Section1",
    ),
    "oup-book": Profile(
        detect=("chapter-title",),
        detect_any=("academic.oup.com", "academic-oup-com"),
        body_selectors=("div.content-inner-wrap", "div.widget-items--chapters"),
        cruft_selectors=("div.ad-banner", "div.global-footer", "nav", "div.info-widget-wrap", "div.widget", "script", "style"),
    ),
    "oup-journal": Profile(
        detect_any=("widget-ArticleFulltext", "academic.oup.com", "academic-oup-com"),
        body_selectors=("div.widget-ArticleFulltext", "div.article-body"),
        cruft_selectors=("div.ad-banner", "div.global-footer", "nav", "div.article-info-wrap", "div.section-jump-link", "script", "style"),
        ref_selector="div.ref-list",
    ),
    "cambridge": Profile(
        detect_any=("cambridge.org", "cambridge-org"),
        no_content_marker="no-content",
        content_marker="scrollspy-content",
        body_selectors=("div.content-container", "div.scrollspy-content", "div.article-wrapper"),
        cruft_selectors=("div.cited-by-wrapper", "div.modal", "div.action-bar", "div.table-of-content-mobile", "script", "style", "nav"),
        ref_selector="div#references-list",
    ),
    "plos": Profile(
        detect_any=("plos.org", "plos-org", "artText"),
        body_selectors=("div#artText", "div.article-text"),
        cruft_selectors=("ul.article-tabs", "div.fig-btns-container", "script", "style", "nav"),
    ),
    "sage-html": Profile(detect_any=("sagepub.com", "sagepub-com"), abstract_only=True),
    "acs": Profile(
        detect_any=("pubs.acs.org", "pubs-acs-org"),
        body_selectors=("div.article_content-left", "div.article_content", "div.NLM_sec_level_1"),
        cruft_selectors=("div.article_header", "div.article_citation", "div.articleMetrics", "div.support-info", "div.article-tools", "script", "style", "nav"),
        ref_selector="div.article_references",
    ),
    "elsevier": Profile(
        detect_any=("sciencedirect.com", "sciencedirect-com", "sd-article"),
        body_selectors=("div#body", "div.Body", "section.Body", "div.article-body"),
        cruft_selectors=("div.sidebar", "div.RelatedContent", "div.Appendices", "div.article-tools", "div.author-info", "div.publication-history", "script", "style", "nav"),
        ref_selector="div.References",
    ),
    "frontiers": Profile(
        detect_any=("frontiersin.org", "frontiersin-org"),
        body_selectors=("div.ArticleContent", "div.JournalFullText", "div.article-section", "article.article-text"),
        cruft_selectors=(
            "div.References", "div.AbstractSummary", "div.article-header", "div.article-footer", "div.notes-section", "button.ArticleReference",
            "script", "style", "nav",
        ),
    ),
    "ieee": Profile(
        detect_any=("ieeexplore.ieee.org", "ieeexplore-ieee-org"),
        body_selectors=("div#article-content", "div.article-content", "section.article-content"),
        cruft_selectors=(
            "div.stats-document-abstract-publishedIn", "div.document-header", "div.document-footer", "div.article-action-toolbar", "div.metrics-section",
            "script", "style", "nav",
        ),
        ref_selector="div.reference-container",
    ),
    "mdpi": Profile(
        detect_any=("mdpi.com", "mdpi-com"),
        body_selectors=("div.html-body", "div#html-article-content", "article.article"),
        cruft_selectors=("div.article-icons", "div.art-supplementary", "div.article-metrics", "section.SupplementaryMaterial", "script", "style", "nav"),
        ref_selector="section.html-references",
    ),
}


@dataclass(frozen=True)
class Config:
    input_dir: str = "input"
    output_dir: str = "output"
    split: SplitConfig = SplitConfig()
    heading_classes: dict[str, dict[str, int]] = field(default_factory=dict)
    publishers: dict[str, Profile] = field(default_factory=lambda: dict(PUBLISHERS))
    fallback: Profile = FALLBACK
    #: Comment prefix of the chapter markers that are written; markers of any prefix in it are read.
    marker: str = "book"

    @property
    def ordered(self) -> list[tuple[str, Profile]]:
        """Detection order: by key, in byte order."""
        return sorted(self.publishers.items(), key=lambda kv: kv[0].encode())

    def profile(self, name: str) -> Profile:
        return self.publishers.get(name, self.fallback)


def _profile_from(base: Profile, given: dict) -> Profile:
    known = {f.name for f in fields(Profile)}
    if unknown := set(given) - known:
        raise EngineError("config_error", f"unknown profile settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def merged(base: Config, layer: dict) -> Config:
    """`base` with a layer of settings (from a file or flags) over it."""
    out = base
    for key, value in (layer or {}).items():
        if key in ("input_dir", "output_dir", "marker"):
            out = replace(out, **{key: value})
        elif key == "split":
            out = replace(out, split=replace(out.split, **value))
        elif key == "epub":
            classes = {k: dict(v) for k, v in out.heading_classes.items()}
            for publisher, levels in (value.get("heading_classes") or {}).items():
                classes.setdefault(publisher, {}).update(levels)
            out = replace(out, heading_classes=classes)
        elif key == "publishers":
            all_ = dict(out.publishers)
            for name, given in value.items():
                all_[name] = _profile_from(all_.get(name, Profile()), given)
            out = replace(out, publishers=all_)
        elif key == "fallback":
            out = replace(out, fallback=_profile_from(out.fallback, value))
        else:
            raise EngineError("config_error", f"unknown setting: {key}")
    return out


def load(*paths: str | Path, base: Config | None = None) -> Config:
    """Files in rising order of precedence; YAML, TOML or JSON by their extension."""
    out = base or Config()
    for path in map(Path, paths):
        try:
            text = path.read_text("utf-8")
            if path.suffix == ".toml":
                layer = tomllib.loads(text)
            elif path.suffix == ".json":
                layer = json.loads(text)
            else:
                import yaml

                layer = yaml.safe_load(text)
        except OSError as e:
            raise EngineError("io_error", f"reading {path}: {e}") from e
        except ValueError as e:
            raise EngineError("config_error", f"{path}: {e}") from e
        try:
            out = merged(out, layer or {})
        except (TypeError, AttributeError) as e:
            raise EngineError("config_error", f"{path}: {e}") from e
    return out


ENDINGS = (".yaml", ".toml", ".json")


def discovered(folder: str | Path | None = None, home: str | Path | None = None) -> list[Path]:
    """The user's file, then the project's: the first found from `folder` upwards."""
    folder, home = Path(folder or Path.cwd()).resolve(), Path(home or Path.home())
    named = lambda stem: next((p for e in ENDINGS if (p := stem.with_name(stem.name + e)).is_file()), None)
    user = named(home / ".config" / "foliospark" / "config")
    places = [at / n for at in (folder, *folder.parents) for n in (".foliospark", ".config/foliospark", "foliospark")]
    project = next((p for stem in places if (p := named(stem))), None)
    return [p for p in (user, project) if p is not None]


def layered(*paths: str | Path, folder: str | Path | None = None, home: str | Path | None = None, environment: dict | None = None) -> Config:
    """In rising order of precedence: defaults, the user's file, the project's, the environment (FOLIOSPARK_INPUT_DIR,
    FOLIOSPARK_OUTPUT_DIR, FOLIOSPARK_MARKER), the files named in `paths`. Flags come after these."""
    given = os.environ if environment is None else environment
    found = load(*discovered(folder, home))
    found = merged(found, {k: v for k in ("input_dir", "output_dir", "marker") if (v := given.get(f"FOLIOSPARK_{k.upper()}"))})
    return load(*paths, base=found)
