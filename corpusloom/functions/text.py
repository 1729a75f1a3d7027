"""Cleaning, splitting and token expressions over string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal rewrites of the line normaliser, in the order they apply
# (after lower-casing; digits are blanked last).
NORMALIZE_REWRITES = [
    ("’", "'"),
    ("′", "'"),
    ("''", " "),
    ("'", " ' "),
    ("“", '"'),
    ("”", '"'),
    ('"', ' " '),
    (".", " . "),
    ("<br />", " "),
    (", ", " , "),
    ("(", " ( "),
    (")", " ) "),
    ("!", " ! "),
    ("?", " ? "),
    (";", " "),
    (":", " "),
    ("-", " - "),
    ("=", " "),
    ("*", " "),
    ("|", " "),
    ("«", " "),
]
DIGITS = "0123456789"

# Entity decoding of escaped article bodies, in order.
ENTITY_REWRITES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]

# Markup rewrites (regular expression, replacement) of a
# lower-cased article body, in the order they apply.
MARKUP_REWRITES = [
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"\|thumb", ""),
    (r"\|left", ""),
    (r"\|right", ""),
    (r"\|\d+px", ""),
    (r"\[\[image:[^\[\]]*\|", ""),
    (r"\[\[category:([^|\]]*)[^\]]*\]\]", "[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
]
REDIRECT_MARK = "#redirect"

# Rewrites whose plain pattern reads on to the end of the text from every opening
# that is never closed.  These forms give the same result: the last group takes
# an unclosed rest in one match and is put back.
UNCLOSED = {
    r"<[^>]*>": (r"<[^>]*>|(<[^>]*+\z)", "$1"),
    r"\[\[category:([^|\]]*)[^\]]*\]\]": (r"\[\[category:([^|\]]*+)[^\]]*+\]\]", "[[$1]]"),
    r"\[\[[a-z\-]*:[^\]]*\]\]": (
        r"\[\[[a-z\-]*:[^\]]*\]\]|(\[\[[a-z\-]*:[^\]]*+\z)",
        "$1",
    ),
    r"\[\[[^|\]]*\|": (r"\[\[[^|\]]*\||\[\[([^|\]]*+\z)", "[[$1"),
    r"\{\{[^}]*\}\}": (r"\{\{[^}]*\}\}|(\{\{[^}]*+\z)", "$1"),
    r"\{[^}]*\}": (r"\{[^}]*\}|(\{[^}]*+\z)", "$1"),
}
ENTITY = r"&[^;]*;"

# Word characters that are not decimal digits (letters, letter
# numbers, other numbers, underscore), and the line-break token of phrase input.
ALPHABETIC_RUN = r"[\p{L}\p{Nl}\p{No}_]+"
LINE_BREAK_TOKEN = "</s>"

LINE_END = "\n"


def _literal_rewrites(col: Column, rewrites: list[tuple[str, str]]) -> Column:
    for old, new in rewrites:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def normalize_text(text: Column) -> Column:
    """Lower-case, set punctuation apart by spaces, blank digits; keeps spacing as is."""
    col = _literal_rewrites(F.lower(text), NORMALIZE_REWRITES)
    return F.translate(col, DIGITS, " " * len(DIGITS))


def clean_markup(body: Column, decode_entities: bool = True) -> Column:
    """Visible text of a wiki article body, lower-cased, with one leading space.

    ``decode_entities`` undoes one level of escaping; turn it off for bodies
    an XML reader has decoded already.
    """
    col = F.lower(body)
    if decode_entities:
        col = _literal_rewrites(col, ENTITY_REWRITES)
    for pattern, replacement in MARKUP_REWRITES:
        if pattern == ENTITY:
            col = _replace_entities(col, replacement)
        else:
            col = F.regexp_replace(col, *UNCLOSED.get(pattern, (pattern, replacement)))
    return F.concat(F.lit(" "), col)


def _replace_entities(text: Column, replacement: str) -> Column:
    """ENTITY replaced; the text is cut at semicolons, so each part is read once."""

    def shortened(part: Column) -> Column:
        entity = F.concat(F.substring_index(part, "&", 1), F.lit(replacement))
        return F.when(F.contains(part, F.lit("&")), entity).otherwise(
            F.concat(part, F.lit(";"))
        )

    def joined(parts: Column) -> Column:
        closed = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), shortened)
        return F.concat(F.array_join(closed, ""), F.element_at(parts, -1))

    # the lambda binds the parts, which are computed once per row
    return F.get(F.transform(F.array(F.split(text, ";")), joined), F.lit(0))


def is_redirect(body: Column) -> Column:
    return F.contains(F.lower(body), F.lit(REDIRECT_MARK))


def space_tokens(text: Column) -> Column:
    """Split on single spaces; neighbouring spaces yield empty tokens."""
    return F.split(text, " ")


def document_space_tokens(text: Column) -> Column:
    """`space_tokens` of every line of a text, as one array."""
    return F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")


def blank_tokens(text: Column) -> Column:
    """Phrase tokens: carriage returns dropped, split on blanks, no empty token.

    Line ends, and lone line-break tokens, become elements that equal LINE_END.
    """
    flat = F.replace(F.translate(text, "\t\r", " "), F.lit("\n"), F.lit(f" {LINE_END} "))
    tokens = F.array_remove(F.split(flat, " "), "")
    mark = F.lit(LINE_BREAK_TOKEN)
    marked = F.transform(tokens, lambda t: F.when(t == mark, F.lit(LINE_END)).otherwise(t))
    # few texts hold the token at all
    return F.when(F.contains(text, mark), marked).otherwise(tokens)


def flat_tokens(text: Column) -> Column:
    """Phrase tokens of a whole text, line ends passed over."""
    tokens = F.split(F.translate(text, "\t\n\r", "  "), " ")
    return F.array_remove(F.array_remove(tokens, ""), LINE_BREAK_TOKEN)


def truncate_bytes(token: Column, length: int) -> Column:
    """First ``length`` bytes of a token's UTF-8 form; a character cut apart is replaced."""
    cut = F.substring(F.encode(token, "UTF-8"), 1, length).cast("string")
    return F.when(F.octet_length(token) <= length, token).otherwise(F.make_valid_utf8(cut))


def alphabetic_tokens(text: Column) -> Column:
    """Lower-case runs of word characters that are not digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({ALPHABETIC_RUN})"), F.lit(1))


def article_tokens(text: Column, min_length: int = 2, max_length: int = 15) -> Column:
    """Alphabetic tokens of an article within a length range, none led by an underscore."""
    return F.filter(
        alphabetic_tokens(text),
        lambda t: F.length(t).between(min_length, max_length) & ~F.startswith(t, F.lit("_")),
    )


def has_several_fields(text: Column) -> Column:
    """True where a line holds more than one blank-separated field."""
    return F.rlike(text, F.lit(r"[^ \t\n][ \t\n]+[^ \t\n]"))


def title_key(title: Column) -> Column:
    """Title as a lookup key: newlines removed, spaces as underscores."""
    return F.replace(F.replace(title, F.lit("\n"), F.lit("")), F.lit(" "), F.lit("_"))


def pair_key(previous: Column, current: Column) -> Column:
    """Vocabulary key of two neighbouring words; null where there is no previous word."""
    return F.concat(previous, F.lit("_"), current)
