"""Format detection and preflight as one generated CASE: markers are searched in the JVM, before any parser runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.config import Config, Profile
from foliospark.functions.text import byte_prefix
from foliospark.operators.document import HTML_HEAD, XML_HEAD


def matches_profile(text: Column, profile: Profile) -> Column:
    groups = []
    if profile.detect:
        groups.append(reduce(lambda a, b: a & b, [text.contains(m) for m in profile.detect]))
    if profile.detect_any:
        groups.append(reduce(lambda a, b: a | b, [text.contains(m) for m in profile.detect_any]))
    return reduce(lambda a, b: a & b, groups) if groups else F.lit(False)


def profile_of(text: Column, config: Config) -> Column:
    """Key of the first profile that matches a page's first bytes, else `other`."""
    start = byte_prefix(text, HTML_HEAD)
    out = F.lit("other")
    for name, profile in reversed(config.ordered):
        out = F.when(matches_profile(start, profile), F.lit(name)).otherwise(out)
    return out


def xml_format(text: Column) -> Column:
    start = byte_prefix(text, XML_HEAD)
    return F.when(start.contains("<component") & start.contains("wiley"), "wiley-xml").when(start.contains("<article"), "jats-xml").otherwise("unknown")


def format_name(profile: Column) -> Column:
    return F.when(profile.endswith("-html"), profile).otherwise(F.concat(profile, F.lit("-html")))


def detect_format(ext: Column, text: Column, config: Config) -> Column:
    """The format's name. ePub goes by its extension alone, so its bytes aren't read."""
    return F.when(ext == "epub", "epub").when(ext == "xml", xml_format(text)).when(ext == "html", format_name(profile_of(text, config))).otherwise("unknown")


def preflight(profile_key: Column, text: Column, config: Config) -> Column:
    """The reason why a page can't be extracted, as far as its text shows; else null."""
    out = F.lit(None).cast("string")
    for name, p in config.ordered:
        reasons = F.lit(None).cast("string")
        if p.abstract_only:
            reasons = F.lit("abstract-only format")
        else:
            if p.no_content_marker:
                gone = text.contains(p.no_content_marker)
                if p.content_marker:
                    gone &= ~text.contains(p.content_marker)
                reasons = F.when(gone, "no-content page (abstract only)")
            if p.fulltext_required:
                reasons = F.when(~text.contains(p.fulltext_required), "abstract-only (no fulltext)").otherwise(reasons)
        if p.abstract_only or p.no_content_marker or p.fulltext_required:
            out = F.when(profile_key == name, reasons).otherwise(out)
    return out
