"""Text functions as Spark columns. White space and word characters are explicit ASCII
classes, so every engine with regular expressions agrees on them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[ \t\n\r\f\x0B]"

# What the screens look for.
SECRET_PATTERNS = (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b")
EXTRA_SECRET_PATTERNS = (r"(?:token|secret|password|api_key) ?= ?\"[0-9a-f]{40}\"",)
PAGE_LICENSE = r"(?i)This page is licensed:[ \t\n\r\f\x0B]*([^<\n]+)"
REVIEW_WORDS = r"(?i)adapted from|copied.{0,30}(?:from|permission)|originally from"
ELIGIBLE_LICENSES = ("MIT", "PostgreSQL")


def strip(text: Column) -> Column:
    """The text without ASCII white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def tidy(text: Column) -> Column:
    """Line ends as newlines, ends stripped; case, inner space and characters untouched."""
    return strip(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\r", "\n"))


def digest(text: Column) -> Column:
    """sha256 of the UTF-8 text, lowercase hex."""
    return F.sha2(text, 256)


@F.arrow_udf(StringType())
def blake2b_64(text: pa.Array) -> pa.Array:
    """The 8-byte BLAKE2b digest of the UTF-8 text, lowercase hex; null for null. No built-in
    function makes it, hence an Arrow function."""
    return pa.array([None if t is None else hashlib.blake2b(t, digest_size=8).hexdigest() for t in text.cast(pa.large_binary()).to_pylist()], pa.string())


def hash_bucket(text: Column, seed: str, buckets: int = 100) -> Column:
    """The first 8 hex digits of sha256(seed:text), modulo the number of buckets."""
    code = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), text), 256), 1, 8), 16, 10).cast("long")
    return code % buckets


def split_of(group: Column, seed: str) -> Column:
    """test for buckets under 5, validation under 10, else train."""
    bucket = hash_bucket(group, seed)
    return F.when(bucket < 5, "test").when(bucket < 10, "validation").otherwise("train")


def words(text: Column) -> Column:
    """The runs of other than white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def terms(text: Column) -> Column:
    """Distinct lower-case runs of ASCII word characters that have over two bytes."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^0-9a-z_\\x{80}-\\x{10FFFF}]+"), lambda w: F.octet_length(w) > 2))


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns is found."""
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def title(text: Column, fallback: Column) -> Column:
    """The first Markdown heading, else the fallback."""
    heading = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+)$", 1)
    return F.when(heading != "", heading).otherwise(fallback)


def license_of(raw: Column, declared: Column, has_notice: Column) -> tuple[Column, Column]:
    """(license, whether it is eligible): a marker in the text overrides the declared one;
    words that tell of copying ask for a review."""
    page = F.regexp_replace(strip(F.regexp_extract(raw, PAGE_LICENSE, 1)), "[_*]", "")
    name = F.when(page != "", page).otherwise(declared)
    return name, has_notice & name.isin(*ELIGIBLE_LICENSES) & ~raw.rlike(REVIEW_WORDS)


def chat_title(text: Column) -> Column:
    """White space collapsed, ends stripped, the first 64 characters."""
    return F.substring(strip(F.regexp_replace(text, f"{SPACE}+", " ")), 1, 64)


def sql_fence(text: Column) -> Column:
    """The first fenced sql block of an answer, else ''."""
    return strip(F.regexp_extract(text, r"(?s)```sql[ \t]*\n(.*?)```", 1))


def suppress_fences(text: Column, notice: str) -> Column:
    """The text with every fenced block replaced by the notice."""
    return F.regexp_replace(text, r"(?s)```.*?```", notice)


def slash_command(text: Column) -> tuple[Column, Column]:
    """(command, rest) of a message that starts with /name; '' and the text otherwise."""
    name = F.regexp_extract(text, r"^/([a-z]+)", 1)
    rest = F.regexp_extract(text, r"(?s)^/[a-z]+[ \t\n]*(.*)$", 1)
    known = name.isin("plan", "chat", "direct", "generate", "remarks", "help")
    return F.when(known, name).otherwise(F.lit("")), F.when(known, rest).otherwise(text)


# Code blocks and calls that change a vector collection.
CODE_BLOCK = r"(?is)```(?:python|typescript|javascript|js|ts)\s*(.*?)```"
MUTATING_CALL = (r"(?i)\.\s*(?:get_or_create_collection|getOrCreateCollection|create_collection|createCollection|delete_collection|deleteCollection"
                 r"|add|upsert|update|delete|modify|reset)\s*\(")


def answer_error(answer: Column, source_kind: Column) -> Column:
    """Why a drafted answer for a vector source is refused, else null: SQL where there are
    only collections, or code that changes a collection."""
    vector = source_kind.isin("chroma", "mixed")
    changes = F.exists(F.regexp_extract_all(answer, F.lit(CODE_BLOCK), F.lit(1)), lambda block: block.rlike(MUTATING_CALL))
    return F.when((source_kind == "chroma") & F.lower(answer).contains("```sql"), "sql for a vector source").when(vector & changes, "changes a collection")
