"""Column functions over issue text and links (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# URL pattern: scheme then a run of URL characters.  The class range `$-_`
# covers digits, upper case, `%`, `@` and punctuation; a flat class (no
# alternation under a repeat) keeps Java's regex from recursing on long URLs.
URL_PATTERN = r"https?://[!$-_a-z]+"
IMG_TAG_PATTERN = r'<img[^>]*?src="([^">]+)"[^>]*>'
IMG_STYLE = "width:auto;height:auto;max-width:100%;"
REPO_LINK_PATTERN = r"^https://github\.com/([^/]+)/([^/?#]+)"
REPO_LINK_PREFIX = "https://github.com/"
API_ISSUES_URL = "https://api.github.com/repos/%s/%s/issues"
API_CHILD_URL = API_ISSUES_URL + "/%s/%s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_urls(text) -> Column:
    """Remove http(s) URLs from text."""
    return F.regexp_replace(_c(text), URL_PATTERN, "")


def rewrite_images(text) -> Column:
    """Rewrite each ``<img … src="u" …>`` to a fixed responsive tag.

    Tags without a non-empty src stay as they are; null text becomes "".
    """
    repl = '<img src="$1" style="' + IMG_STYLE + '" />'
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), IMG_TAG_PATTERN, repl)


def image_urls(text) -> Column:
    """Image sources of all whole ``<img ...>`` tags of the text, in order (array<string>)."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(IMG_TAG_PATTERN), 1)


def repo_owner_from_link(link) -> Column:
    v = F.regexp_extract(_c(link), REPO_LINK_PATTERN, 1)
    return F.when(v != "", v)


def repo_name_from_link(link) -> Column:
    v = F.regexp_extract(_c(link), REPO_LINK_PATTERN, 2)
    return F.when(v != "", v)


def issues_endpoint(owner, repo) -> Column:
    """REST endpoint listing the issues of a repository."""
    return F.format_string(API_ISSUES_URL, _c(owner), _c(repo))


def children_endpoint(owner, repo, number, kind: str) -> Column:
    """REST endpoint of an issue's ``comments`` or ``reactions``."""
    return F.format_string(API_CHILD_URL, _c(owner), _c(repo), _c(number).cast("string"), F.lit(kind))
