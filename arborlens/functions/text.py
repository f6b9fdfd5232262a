"""Cleaning of file contents: comments, secrets, e-mail addresses, size limits. Columns only; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 2048

# The comment style by file name or ending, and the text of replacements.
HASH_NAMES = ("makefile",)
HASH_ENDINGS = ("yaml", "yml", "toml", "ini", "hcl", "py")
SLASH_ENDINGS = ("json", "js", "ts")
BOTH_ENDINGS = ("php",)
HTML_ENDINGS = ("md", "html", "xml")
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_MARK = "redacted@example.org"
SECRET_MARK = "[REDACTED]"

#: Own list: forms that tell a secret by themselves, then names with a value of some length.
SECRETS = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    r"\bglpat-[A-Za-z0-9_-]{20}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\b[sr]k_live_[A-Za-z0-9]{16,}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
)
NAMED_SECRET = r"(?i)((?:api_?key|secret|token|passwd|password)[\"']?[ \t]*[:=][ \t]*[\"']?)([A-Za-z0-9+/_.!#%@-]{12,})"


def strip_hash_comments(c: Column) -> Column:
    """Everything from a `#` to the line's end, with the blanks before it."""
    return F.regexp_replace(c, r"(?md)[\t\n\f\r ]*#.*$", "")


def strip_slash_comments(c: Column) -> Column:
    """Line comments from `//` on, then blocks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?md)[\t\n\f\r ]*//.*$", ""), r"(?s)/\*.*?\*/", "")


def strip_html_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def remove_comments(name: Column, content: Column) -> Column:
    """By the file's base name and ending, in any letter case; other files stay as they are, and so do files without a name."""
    base = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    ending = F.regexp_extract(base, r"\.([^.]*)$", 1)
    return (
        F.when(base.isin(*HASH_NAMES) | ending.isin(*HASH_ENDINGS), strip_hash_comments(content))
        .when(ending.isin(*SLASH_ENDINGS), strip_slash_comments(content))
        .when(ending.isin(*BOTH_ENDINGS), strip_hash_comments(strip_slash_comments(content)))
        .when(ending.isin(*HTML_ENDINGS), strip_html_comments(content))
        .otherwise(content)
    )


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, EMAIL_MARK)


def redact_secrets(c: Column) -> Column:
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, SECRET_MARK)
    return F.regexp_replace(c, NAMED_SECRET, "$1" + SECRET_MARK.replace("[", "\\[").replace("]", "\\]"))


def clean(name: Column, content: Column) -> Column:
    """Comments, then secrets, then e-mail addresses."""
    return redact_emails(redact_secrets(remove_comments(name, content)))


def is_text(content: Column) -> Column:
    """Whether bytes are text: no NUL and valid UTF-8; no bytes at all are text."""
    return ~F.contains(content, F.lit(b"\0")) & F.is_valid_utf8(content.cast("string"))


def head(content: Column, limit: int = LIMIT) -> Column:
    """The first `limit` bytes; a character cut there is left out."""
    part = F.substring(content, 1, limit)
    whole = F.expr("array(0, 1, 2, 3)")
    cuts = F.transform(whole, lambda n: F.substring(part, F.lit(1), F.length(part) - n))
    return F.coalesce(F.get(F.filter(cuts, lambda x: F.is_valid_utf8(x.cast("string"))), 0), part).cast("string")


def truncated(content: Column, limit: int = LIMIT) -> Column:
    return F.octet_length(content) > limit
