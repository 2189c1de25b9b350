"""URL helpers: ids, parts, resolution against a page and link tests.

URLs are taken apart with the generic pattern of RFC 3986 (appendix B). Unlike
a strict URI parser it has a result for every text, as web pages need.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrawl.functions.text import col, let, quote
from pagetrawl.schemas import NON_PAGE_ENDINGS

_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"^[^#]*#(.*)$"


def _part(url: str, pattern: str) -> str:
    return f"regexp_extract({url}, {quote(pattern)}, 1)"


def scheme_sql(url: str) -> str:
    """SQL form of :func:`scheme`."""
    return f"lower({_part(url, _SCHEME)})"


def is_web_url_sql(url: str) -> str:
    """SQL form of :func:`is_web_url`."""
    return f"{scheme_sql(url)} IN ('http', 'https')"


def is_page_link_sql(url: str) -> str:
    """SQL form of :func:`is_page_link`."""
    endings = "|".join(e[1:] for e in NON_PAGE_ENDINGS)
    ending = rf"\.(?:{endings})$"
    return f"({is_web_url_sql(url)} AND NOT {_part(url, _PATH)} RLIKE {quote(ending)})"


def url_id(url) -> Column:
    """Key of a page or an image: SHA-256 of its URL in hex."""
    return F.sha2(col(url), 256)


def link_id(source, target) -> Column:
    """Key of a link: SHA-256 of ``source->target`` in hex."""
    return F.sha2(F.concat(col(source), F.lit("->"), col(target)), 256)


def scheme(url) -> Column:
    """Scheme in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(col(url), _SCHEME, 1))


def netloc(url) -> Column:
    """Authority with port, user and case kept; null if there is none or it is broken."""
    part = F.regexp_extract(col(url), _NETLOC, 1)
    return F.when((part != "") & (part.contains("[") == part.contains("]")), part)


def path(url) -> Column:
    """Path without query and fragment."""
    return F.regexp_extract(col(url), _PATH, 1)


def host_text(url) -> Column:
    """Text between the scheme and the first slash, by plain replacement."""
    return F.split_part(F.regexp_replace(col(url), "https?://", ""), F.lit("/"), F.lit(1))


def domain_key(domain) -> Column:
    """Key of a seed: the domain with ``. / :`` as underscores."""
    return F.translate(col(domain), "./:", "___")


def domain_url(domain) -> Column:
    """Start URL of a domain."""
    return F.concat(F.lit("https://"), col(domain))


def starts_with_http(url) -> Column:
    """Validity test of submitted page and image URLs."""
    return F.coalesce(col(url).startswith("http"), F.lit(False))


def is_web_url(url: str) -> Column:
    """True for http and https URLs."""
    return F.expr(is_web_url_sql(url))


def is_page_link(url: str) -> Column:
    """True for http(s) URLs whose path has no file ending that rules out a page."""
    return F.expr(is_page_link_sql(url))


def _merge_paths(base_path: str, path_: str) -> str:
    """A relative or rooted path resolved against the path of a page.

    ``.`` and ``..`` are carried out by a fold over the segments that drops the
    last kept segment for every ``..``.
    """
    folder = f"coalesce(nullif(regexp_extract({base_path}, '^(.*/)[^/]*$', 1), ''), '/')"
    relative = f"regexp_replace(concat({folder}, {path_}), '(?<!^)/{{2,}}', '/')"
    joined = f"CASE WHEN startswith({path_}, '/') THEN {path_} ELSE {relative} END"
    fold = (
        "aggregate(s, CAST(array() AS ARRAY<STRING>), (done, x) -> CASE WHEN x = '.' THEN done "
        "WHEN x = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) ELSE array_append(done, x) END)"
    )
    kept = f"CASE WHEN element_at(s, -1) IN ('.', '..') THEN array_append({fold}, '') ELSE {fold} END"
    joined_again = f"array_join({let('split(j, chr(47))', 's', kept)}, '/')"
    undotted = let(joined_again, "r", "CASE WHEN startswith(r, '/') THEN r ELSE '/' || r END")
    dotted = quote(r"(?:^|/)\.\.?(?:/|$)")
    return let(joined, "j", f"CASE WHEN j RLIKE {dotted} THEN {undotted} ELSE j END")


def split_base_sql(url: str) -> str:
    """The parts of a page URL that resolving its links needs, as a struct."""
    return (
        f"struct({url} AS url, {scheme_sql(url)} AS scheme, {_part(url, _NETLOC)} AS netloc, "
        f"{_part(url, _PATH)} AS path, {_part(url, _QUERY)} AS query)"
    )


def resolve_in_sql(base: str, hrefs: str) -> str:
    """SQL of an array of hrefs resolved against one page, see :func:`resolve_url`.

    ``base`` names the struct of :func:`split_base_sql`. Each step is one
    ``transform``, so that parts found once per href are not computed again.
    """
    trimmed = quote(r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]")
    cleaned = f"transform({hrefs}, h -> regexp_replace(h, {trimmed}, ''))"
    parts = (
        f"transform({cleaned}, h -> struct(h AS href, {scheme_sql('h')} AS scheme, {_part('h', _NETLOC)} AS netloc, "
        f"{_part('h', _PATH)} AS path, {_part('h', _QUERY)} AS query, {_part('h', _FRAGMENT)} AS fragment))"
    )
    path_ = (
        f"CASE WHEN q.netloc <> '' THEN q.path WHEN q.path = '' THEN {base}.path "
        f"ELSE {_merge_paths(f'{base}.path', 'q.path')} END"
    )
    query = f"CASE WHEN q.netloc = '' AND q.path = '' AND q.query = '' THEN {base}.query ELSE q.query END"
    rebuilt = (
        f"concat({base}.scheme, '://', coalesce(nullif(q.netloc, ''), {base}.netloc), {path_}, "
        f"coalesce('?' || nullif({query}, ''), ''), coalesce('#' || nullif(q.fragment, ''), ''))"
    )
    resolved = (
        f"CASE WHEN q.href = '' THEN {base}.url "
        f"WHEN q.scheme NOT IN ('', {base}.scheme) OR {base}.scheme NOT IN ('http', 'https') THEN q.href "
        f"ELSE {rebuilt} END"
    )
    return f"transform({parts}, q -> {resolved})"


def resolve_url(base: str, href: str) -> Column:
    """An href resolved against the URL of its page."""
    resolved = f"get({resolve_in_sql('b', f'array({href})')}, 0)"
    return F.expr(let(split_base_sql(base), "b", resolved))
