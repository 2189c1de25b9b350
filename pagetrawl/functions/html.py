"""HTML to columns with regular expressions that survive malformed pages.

Arguments are column names or SQL expressions; see :mod:`pagetrawl.functions.text`.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrawl.functions.text import UNTIDY_SPACE, col, decode_sql, let, quote, strip, strip_sql, truncate
from pagetrawl.functions.urls import is_page_link_sql, is_web_url_sql, resolve_in_sql, split_base_sql
from pagetrawl.schemas import (
    DEFAULT_IMAGE_TITLE, MAX_LINKS, NOISE_IMAGE_MARKS, SNIPPET_CHARS,
)

#: One attribute after the other: a name, then maybe a quoted or bare value. Possessive, so that the
#: matcher neither recurses nor goes back over a long tag; a quote inside a bare value belongs to it.
_ATTRIBUTE = r"""[\s/]++|{other}[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|="""
_ATTRIBUTES = "((?:" + _ATTRIBUTE.format(other="") + ")*+)>"

_COMMENT = r"(?s)<!--.*?-->"
#: Begins with a single character, which the matcher finds without trying the alternatives at every other.
_COMMENT_OR_SCRIPT = r"(?is)<(?=[!s])(?:!--.*?-->|(script|style)\b.*?(?:</\1\s*>|\z))"
_BODY_START = r"(?i)<body[\s>]"
_HEAD_END = r"(?i)</head\s*>"
_TITLE = r"(?is)<title(?=[\s>])[^>]*>([^<]*)"
#: Comments and tags; of a script or style element its text, the third group, stays. A tag that does
#: not end by the rules ends at the next ">".
_TAG_OR_COMMENT = (
    r"(?is)<!--.*?-->|<(script|style)(?=[\s/>])" + _ATTRIBUTES + r"(.*?)(?:</\1\s*>|\z)"
    + r"|</?[a-z][^\s/>]*+" + _ATTRIBUTES + r"|<[^>]*>")


def _without(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {quote(pattern)}, ' ')"


def markup(html: str) -> Column:
    """The page without comments, scripts and styles: where tags are looked for."""
    return F.expr(_without(html, _COMMENT_OR_SCRIPT))


def title_in(markup_: str) -> Column:
    """:func:`page_title` of a page whose comments and scripts are gone already."""
    return F.expr(_title_text(markup_))


def _tags(markup_: str, name: str) -> str:
    """The attribute text of every ``name`` tag."""
    return f"regexp_extract_all({markup_}, {quote(rf'(?i)<{name}(?=[\s/>])' + _ATTRIBUTES)}, 1)"


def _attribute(tag: str, name: str) -> str:
    """Value of an attribute, decoded; null if the tag does not have it.

    A tag is read once, up to the value and only if the name is in it; the value alone is then freed of its quotes.
    """
    before = "(?:" + _ATTRIBUTE.format(other=rf"(?!{name}\s*+=)") + ")*+"
    written = rf"""(?is)^{before}{name}\s*+(=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))"""
    value = r"""^=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+))"""
    parts = ", ".join(f"regexp_extract(v, {quote(value)}, {i})" for i in (1, 2, 3))
    found = f"CASE WHEN contains(lower({tag}), '{name}') THEN regexp_extract({tag}, {quote(written)}, 1) ELSE '' END"
    return let(found, "v", f"CASE WHEN v <> '' THEN {decode_sql(f'concat({parts})')} END")


def page_title(html: str) -> Column:
    """Text of the first title element outside comments and scripts, stripped; empty if there is none."""
    return F.expr(_page_title(html))


def _page_title(html: str) -> str:
    return _title_text(_without(html, _COMMENT_OR_SCRIPT))


def _title_text(markup_: str) -> str:
    return strip_sql(decode_sql(f"regexp_extract({markup_}, {quote(_TITLE)}, 1)"))


def extract_title(html: str, url: str) -> Column:
    """Text of the first title element, or the URL if that is blank."""
    return F.expr(f"coalesce(nullif({_page_title(html)}, ''), {url})")


def _body(html: str) -> str:
    """The page from its body tag on, to its end because many pages never close it.

    Without a body tag the text after the head counts, or all but the title.
    """
    def start(pattern: str) -> str:
        return f"nullif(regexp_instr({html}, {quote(pattern)}), 0)"

    return (
        f"coalesce(substr({html}, {start(_BODY_START)}), substr({html}, {start(_HEAD_END)}), "
        f"{_without(html, _TITLE)})"
    )


def extract_content(html: str, drop_script_style: bool = False) -> Column:
    """Text of the body with tags and comments as breaks and whitespace collapsed.

    Script and style text in the body counts, as it stands, unless dropped. Neither a body tag nor text
    inside a comment counts.
    """
    body = _body(_without(html, _COMMENT_OR_SCRIPT if drop_script_style else _COMMENT))
    text = decode_sql(f"regexp_replace({body}, {quote(_TAG_OR_COMMENT)}, ' $3 ')")
    return F.expr(f"trim({_without(text, UNTIDY_SPACE)})")


def description_in(markup_: str) -> Column:
    """Content of the first description meta tag; null if there is none."""
    return F.expr(_description(markup_))


def _description(markup_: str) -> str:
    described = f"filter({_tags(markup_, 'meta')}, a -> {_attribute('a', 'name')} = 'description')"
    contents = f"transform({described}, a -> {_attribute('a', 'content')})"
    return f"get(filter({contents}, c -> c IS NOT NULL), 0)"


def snippet_of(description, content) -> Column:
    """The description if there is one, else the start of the content."""
    return F.when(col(description) != "", strip(description)).otherwise(truncate(content, SNIPPET_CHARS))


def extract_snippet(html: str, content: str) -> Column:
    """:func:`snippet_of` for a page given as HTML."""
    return snippet_of(F.expr(_description(_without(html, _COMMENT_OR_SCRIPT))), content)


def _hrefs(markup_: str) -> str:
    return f"filter(transform({_tags(markup_, 'a')}, a -> {_attribute('a', 'href')}), h -> h IS NOT NULL)"


def extract_hrefs(html: str) -> Column:
    """All link targets in document order, as written but decoded."""
    return F.expr(_hrefs(_without(html, _COMMENT_OR_SCRIPT)))


def resolved_hrefs(url: str, html: str) -> Column:
    """:func:`extract_hrefs` resolved against the page, whatever they lead to."""
    hrefs = _hrefs(_without(html, _COMMENT_OR_SCRIPT))
    return F.expr(let(split_base_sql(url), "b", resolve_in_sql("b", hrefs)))


def cap_links(links, n: int = MAX_LINKS) -> Column:
    """The first ``n`` distinct links of a page."""
    return F.slice(F.array_distinct(col(links)), 1, n)


def links_in(url: str, markup_: str, same_host: bool = False, n: int | None = None) -> Column:
    """Resolved page links of one page, distinct, in order; the first ``n`` if given.

    With ``same_host`` only those whose authority is the page's, in any case.
    """
    wanted = is_page_link_sql("u")
    if same_host:
        wanted += " AND lower(regexp_extract(u, '^[^:/?#]+://([^/?#]*)', 1)) = lower(b.netloc)"
    links = f"array_distinct({let(split_base_sql(url), 'b', f'filter({resolve_in_sql("b", _hrefs(markup_))}, u -> {wanted})')})"
    return F.expr(links if n is None else f"slice({links}, 1, {int(n)})")


def images_in(url: str, markup_: str, title: str) -> Column:
    """Image records with resolved source and title chain; http(s) only."""
    tags = (
        f"transform({_tags(markup_, 'img')}, a -> struct({_attribute('a', 'src')} AS src, "
        f"coalesce({_attribute('a', 'alt')}, '') AS alt, {_attribute('a', 'title')} AS title))"
    )
    name = f"coalesce(nullif(i.title, ''), nullif(i.alt, ''), nullif({title}, ''), {quote(DEFAULT_IMAGE_TITLE)})"
    record = (
        f"struct(s AS url, {strip_sql('i.alt')} AS alt_text, {url} AS source_url, {strip_sql(name)} AS title)"
    )
    sources = let(split_base_sql(url), "b", resolve_in_sql("b", "transform(k, i -> i.src)"))
    records = let(f"filter({tags}, i -> i.src <> '')", "k", f"zip_with(k, {sources}, (i, s) -> {record})")
    return F.expr(f"filter({records}, r -> {is_web_url_sql('r.url')})")


def extract_images(html: str, url: str, title: str) -> Column:
    """:func:`images_in` for a page given as HTML."""
    return images_in(url, _without(html, _COMMENT_OR_SCRIPT), title)


def filter_images(images: str, n: int | None = None) -> Column:
    """The images that are not layout, tracking or GIF files; the first ``n`` if given."""
    marks = quote("|".join(NOISE_IMAGE_MARKS) + r"|\.gif$")
    kept = f"filter({images}, i -> NOT lower(i.url) RLIKE {marks})"
    return F.expr(kept if n is None else f"slice({kept}, 1, {int(n)})")


def split_links(csv: str) -> Column:
    """A comma-separated link list as an array without blanks."""
    return F.expr(f"filter(transform(split({csv}, ','), x -> {strip_sql('x')}), x -> x <> '')")
