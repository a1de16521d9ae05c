"""Splitting a block of Spark SQL into statements."""

from __future__ import annotations

import re

# One token per match: quoted text, comments, the separator, or a run of anything else.
_TOKEN = re.compile(
    r"""
      (?P<quoted> '(?:\\.|''|[^'\\])*' | "(?:\\.|""|[^"\\])*" | `(?:``|[^`])*` )
    | (?P<comment> --[^\n]* | /\* )
    | (?P<end> ; )
    | (?P<other> [^'"`;/-]+ | . )
    """,
    re.VERBOSE | re.DOTALL,
)

_COMMENT_MARK = re.compile(r"/\*|\*/")

_TEMP_VIEW = re.compile(
    r"^\s*CREATE\s+(?:OR\s+REPLACE\s+)?TEMP(?:ORARY)?\s+VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?"
    r"(`(?:``|[^`])+`|\w+)",
    re.IGNORECASE,
)


def split_sql(text: str) -> list[str]:
    """Statements of ``text`` in order, without the pieces that hold only blanks and comments.

    A ``;`` inside quotes or a comment does not end a statement. Plain comments are dropped; hints
    (``/*+ ... */``) are kept. Block comments nest, as they do in Spark.
    """
    statements, piece, at, text = [], [], 0, text or ""
    while at < len(text):
        match = _TOKEN.match(text, at)
        token = match.group()
        if token == "/*":
            token = text[at:_comment_end(text, at)]
        at += len(token)
        if match.lastgroup == "end":
            statements.append("".join(piece).strip())
            piece = []
        elif match.lastgroup == "comment" and not token.startswith("/*+"):
            piece.append(" ")
        else:
            piece.append(token)
    statements.append("".join(piece).strip())
    return [s for s in statements if s]


def _comment_end(text: str, start: int) -> int:
    """Where the block comment that begins at ``start`` ends; the end of ``text`` if it never does."""
    depth = 0
    for mark in _COMMENT_MARK.finditer(text, start):
        depth += 1 if mark.group() == "/*" else -1
        if depth == 0:
            return mark.end()
    return len(text)


def created_temp_view(statement: str) -> str | None:
    """Name of the temporary view a statement creates, if it creates one."""
    match = _TEMP_VIEW.match(statement)
    if not match:
        return None
    name = match.group(1)
    return name[1:-1].replace("``", "`") if name.startswith("`") else name
