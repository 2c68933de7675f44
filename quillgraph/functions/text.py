"""Text expressions: sentences, tokens, keys, front matter, markup, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentence boundary of the chunker.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9#\-*])|\n\n+"
# The form of a link to a note.
WIKILINK = r"\[\[([^\]\|#]+)(?:#[^\]\|]+)?(?:\|[^\]]+)?\]\]"
_SPACE = r"^\s+|\s+$"
# HTML elements whose content is no text.
DROPPED_TAGS = ["script", "style", "nav", "footer", "header", "iframe", "noscript"]
# The Markdown marks of tags.
TAG_MARKS = {
    "h1": "\n# ", "/h1": "\n", "h2": "\n## ", "/h2": "\n", "h3": "\n### ", "/h3": "\n", "p": "\n", "/p": "\n", "br": "\n", "li": "\n- ", "/li": "",
    "strong": "**", "/strong": "**", "b": "**", "/b": "**", "em": "*", "/em": "*", "i": "*", "/i": "*",
}


def _c(column: str | Column) -> Column:
    return column if isinstance(column, Column) else F.col(column)


def stripped(column: str | Column) -> Column:
    """Without white space around."""
    return F.regexp_replace(_c(column), _SPACE, "")


def words(column: str | Column) -> Column:
    """The runs between white space."""
    return F.filter(F.split(_c(column), r"\s+"), lambda x: x != "")


def sentences(column: str | Column) -> Column:
    """Sentences of a text: after an end mark before a capital, digit or list mark, and at blank lines."""
    return F.filter(F.transform(F.split(_c(column), SENTENCE_END), stripped), lambda x: x != "")


def token_estimate(column: str | Column) -> Column:
    """About 1.3 tokens a word, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(column)) * 13 / 10)).cast("bigint")


def preview(column: str | Column, size: int = 240) -> Column:
    """The first characters on one line, with dots where more follows."""
    c = _c(column)
    return F.concat(stripped(F.regexp_replace(F.substring(c, 1, size), r"\s+", " ")), F.when(F.length(c) > size, "...").otherwise(""))


def clean_stem(column: str | Column) -> Column:
    """The key by which a note's title, file name or id is looked up."""
    base = F.regexp_replace(_c(column), r"(?i)\.md$", "")
    plain = F.lower(stripped(F.regexp_replace(base, r"[^\p{L}\p{N}_\s-]", "")))
    return F.regexp_replace(plain, r"[\s-]+", "_")


def slug(column: str | Column) -> Column:
    """A file-name form of a title; ``note`` where nothing is left."""
    plain = F.regexp_replace(F.lower(stripped(F.regexp_replace(_c(column), r"[^\p{L}\p{N}_\s-]", ""))), r"\s+", "_")
    return F.when(plain == "", "note").otherwise(plain)


def normal_name(column: str | Column) -> Column:
    """An entity's name as its key: word characters, hyphens and single spaces, in lower case."""
    return F.regexp_replace(F.lower(stripped(F.regexp_replace(_c(column), r"[^\p{L}\p{N}_\s-]", ""))), r"\s+", " ")


def wikilinks(column: str | Column) -> Column:
    """Targets of ``[[target#anchor|alias]]``."""
    return F.transform(F.regexp_extract_all(_c(column), F.lit(WIKILINK), 1), stripped)


def front_matter(column: str | Column) -> Column:
    """``key: value`` lines between the leading ``---`` lines, as a map (the last of equal keys counts)."""
    block = F.regexp_extract(_c(column), r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("key"), stripped(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def body(column: str | Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(_c(column), r"(?s)^---\s*\n.*?\n---\s*\n", "")


def first_heading(column: str | Column) -> Column:
    """The first heading of the first level; null where there is none."""
    found = stripped(F.regexp_extract(_c(column), r"(?m)^#\s+(.+)$", 1))
    return F.when(found != "", found)


def tag_list(column: str | Column) -> Column:
    """Tags of a list in a string: JSON, or bare words in brackets; empty where there are none."""
    bare = F.regexp_replace(F.coalesce(_c(column), F.lit("")), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(bare, ","), stripped), lambda x: x != "")


def searchable(column: str | Column) -> Column:
    """A search text without anything but letters, digits and white space."""
    return F.regexp_replace(_c(column), r"[^\p{L}\p{N}\s]", "")


def lexical_tokens(column: str | Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(_c(column)), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def ascii_words(column: str | Column) -> Column:
    """A text in which letters beyond ASCII are ``_`` and other characters beyond ASCII are ``-``, so that word
    boundaries are the same in every regular-expression engine."""
    return F.regexp_replace(F.regexp_replace(_c(column), r"[^\x00-\x7F\p{L}\p{N}]", "-"), r"[^\x00-\x7F]", "_")


def html_title(column: str | Column) -> Column:
    """The title element with entities blanked; null where there is none."""
    found = stripped(F.regexp_replace(F.regexp_extract(_c(column), r"(?is)<title[^>]*>(.*?)</title>", 1), r"&[a-zA-Z#0-9]+;", " "))
    return F.when(found != "", found)


def html_to_markdown(column: str | Column) -> Column:
    """A page's text with headings, list items and emphasis in Markdown, non-empty lines divided by blank lines.

    The page is cut into tags and runs of text; each tag becomes its Markdown mark, or a blank where it has none.
    """
    shown = F.regexp_replace(_c(column), rf"(?is)<({'|'.join(DROPPED_TAGS)})\b[^>]*>.*?</\1>", "")
    pieces = F.regexp_extract_all(shown, F.lit(r"<[^>]+>|[^<]+|<"), 0)
    marks = F.create_map(*[F.lit(x) for pair in TAG_MARKS.items() for x in pair])

    def mark(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"^<\s*(/?[A-Za-z0-9]+)[^>]*>$", 1))
        return F.when(piece.rlike(r"(?s)^<[^>]+>$"), F.coalesce(F.try_element_at(marks, tag), F.lit(" "))).otherwise(piece)

    text = F.array_join(F.transform(pieces, mark), "")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != ""), "\n\n")


def filled(template: str | Column, values: str | Column) -> Column:
    """A template with every ``{name}`` replaced by the map's value; names that the map lacks become dots."""
    known = F.aggregate(F.map_entries(_c(values)), _c(template), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return F.regexp_replace(known, r"\{[A-Za-z_][A-Za-z0-9_]*\}", "...")


def replaced_once(column: str | Column, old: str | Column, new: str | Column) -> Column:
    """The first occurrence of ``old`` replaced; null where the text does not hold it."""
    c, o, n = _c(column), _c(old), _c(new)
    at = F.position(o, c)
    return F.when((at > 0) & (o != ""), F.concat(F.substring(c, F.lit(1), at - 1), n, F.substring(c, at + F.length(o), F.length(c))))


def retagged(column: str | Column, tags: str | Column) -> Column:
    """A note with the ``tags: [...]`` line of its front matter written anew; unchanged where there is none."""
    return F.regexp_replace(_c(column), F.lit(r"(?m)^tags:\s*\[.*?\]"), F.concat(F.lit("tags: ["), F.array_join(_c(tags), ", "), F.lit("]")))


def unfenced(column: str | Column) -> Column:
    """A text without the regions between ``---`` lines and without those lines; a region that never ends goes on to the end."""
    pieces = F.split(F.concat(F.lit("\n"), _c(column)), r"\n *--- *(?=\n|\z)")  # every second piece lies inside
    return F.substr(F.array_join(F.filter(pieces, lambda p, i: i % 2 == 0), ""), F.lit(2))
