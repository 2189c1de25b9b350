"""Text helpers, entity decoding and the analyser of the text fields.

Expressions with many nested steps are put together as SQL text (names ending in
``_sql``), which the session parses once, instead of from many single columns.
"""

import re
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrawl.schemas import MIN_TERM_CHARS, STOP_WORDS

WHITESPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
# Runs of whitespace that are more or other than one space.
UNTIDY_SPACE = r" [\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85&&[^ ]][\s\p{Z}\x1c-\x1f\x85]*"
NON_TERM = r"[^\p{L}\p{N}]+"

# Decoded by plain replacement: with ``amp`` the entities that make up nearly all of
# those in real pages.
_FREQUENT = {
    "quot": '"', "lt": "<", "gt": ">", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7", "apos": "'",
}


def col(c) -> Column:
    """A column from its name, or the column itself."""
    return F.col(c) if isinstance(c, str) else c


def quote(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` as the value of ``value``, computed only once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip_sql(text: str) -> str:
    """SQL form of :func:`strip`."""
    return f"regexp_replace({text}, {quote(f'^{WHITESPACE}|{WHITESPACE}$')}, '')"


def falsy(c, *defaults) -> Column:
    """The first of ``c`` and ``defaults`` that is neither null nor empty text.

    The last default is taken as it is. A default given as plain text is a
    literal.
    """
    chain = [F.nullif(col(c), F.lit(""))]
    as_columns = [F.lit(d) if isinstance(d, str) else d for d in defaults]
    chain += [F.nullif(d, F.lit("")) for d in as_columns[:-1]] + as_columns[-1:]
    return F.coalesce(*chain)


def collapse(c) -> Column:
    """Runs of whitespace become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(col(c), UNTIDY_SPACE, " "))


def strip(c) -> Column:
    """Whitespace of any kind removed from both ends."""
    return F.regexp_replace(col(c), rf"^{WHITESPACE}|{WHITESPACE}$", "")


def truncate(c, n: int) -> Column:
    """The first ``n`` code points, with an ellipsis if anything was cut."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def contains_text(c, needle: str) -> Column:
    """Case-insensitive substring test that treats null as empty text."""
    return F.coalesce(F.lower(col(c)), F.lit("")).contains(needle.lower())


def words(c) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(F.trim(F.regexp_replace(col(c), WHITESPACE, " ")), " "), lambda w: w != "")


def analyse(c) -> Column:
    """Terms of a text in order: lower case, letters and digits, no stop words."""
    return F.filter(
        F.split(F.lower(F.coalesce(col(c), F.lit(""))), NON_TERM),
        lambda t: (F.length(t) >= MIN_TERM_CHARS) & ~t.isin(STOP_WORDS),
    )


def analyse_literal(text: str) -> list[str]:
    """The terms of a request argument, by the rule of :func:`analyse`."""
    terms = re.findall(r"[^\W_]+", text.lower())
    return [t for t in terms if len(t) >= MIN_TERM_CHARS and t not in STOP_WORDS]


def _entity_map() -> str:
    """All named entities as one literal map."""
    pairs = (f"{n}\x01{chr(c)}" for n, c in sorted(name2codepoint.items()))
    entries = "\x02".join(pairs)
    return f"str_to_map({quote(entries)}, '\x02', '\x01')"


def _code_point(digits: str, base: int) -> str:
    """The character with a number, null if there is none."""
    valid = "n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111"
    character = "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"
    number = f"CAST(conv({digits}, {base}, 10) AS BIGINT)"
    return let(number, "n", f"CASE WHEN {valid} THEN {character} END")


def _decode_pieces(text: str) -> str:
    """The text cut before every ``&``, each piece decoded, and joined again."""
    named = (
        f"transform(split({text}, '(?=&)'), p -> struct(p AS text, "
        f"regexp_extract(p, '^&(#?[A-Za-z0-9]+);', 1) AS name))"
    )
    character = (
        "CASE WHEN p.name = '' THEN NULL "
        f"WHEN p.name RLIKE '^#[0-9]{{1,7}}$' THEN {_code_point('substr(p.name, 2)', 10)} "
        f"WHEN p.name RLIKE '^#[xX][0-9A-Fa-f]{{1,6}}$' THEN {_code_point('substr(p.name, 3)', 16)} "
        f"ELSE try_element_at({_entity_map()}, p.name) END"
    )
    rest = "substr(p.text, length(p.name) + 3)"
    return f"array_join(transform({named}, p -> coalesce(concat({character}, {rest}), p.text)), '')"


def decode_sql(text: str) -> str:
    """SQL form of :func:`decode_entities`."""
    frequent = "t"
    for name, character in _FREQUENT.items():
        frequent = f"replace({frequent}, '&{name};', {quote(character)})"
    only_amp = "replace(u, '&amp;', '&')"
    rest = (
        f"CASE WHEN NOT contains(replace(u, '&amp;', ''), '&') THEN {only_amp} "
        f"WHEN u RLIKE '&(?!amp;)#?[A-Za-z0-9]{{1,10}};' THEN {_decode_pieces('u')} ELSE {only_amp} END"
    )
    return let(text, "t", f"CASE WHEN contains(t, '&') THEN {let(frequent, 'u', rest)} ELSE t END")


def decode_entities(text: str) -> Column:
    """Named and numeric character references of a column decoded, each once.

    ``&amp;lt;`` gives ``&lt;``. Unknown references stay as they are. Frequent
    entities take a fast way; only texts that hold others are cut into pieces.
    """
    return F.expr(decode_sql(text))
