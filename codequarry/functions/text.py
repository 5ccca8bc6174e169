"""Scalar text, path and time functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that ranking leaves out, English and source-code ones.
STOP_WORDS = (
    "the and or but in on at to for of with by from as is was are were been be have has had do does did will would could "
    "should may might must shall can need dare ought used it its this that these those i you he she we they what which who "
    "whom whose where when why how all each every both few more most other some such no nor not only own same so than too "
    "very just if then else while although because since until unless though before after about into through during above "
    "below between under again further once function class const let var export import default async await return static "
    "public private protected interface type extends implements new try catch throw finally null undefined true false"
).split()

#: File extension -> language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go",
    "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "json": "json",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Lower-case words of a-z, 0-9 and _ over one character, without stop words. Null gives an empty array."""
    flat = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^a-z0-9\s_]", " ")
    return F.filter(F.split(flat, r"\s+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def query_tokens(text: str) -> list[str]:
    """The same rule for one query text, on the driver."""
    flat = "".join(c if c.isascii() and (c.isalnum() or c == "_") else " " for c in text.lower())
    return [t for t in flat.split() if len(t) > 1 and t not in STOP_WORDS]


def strip(c: str | Column) -> Column:
    """Without outer white space of any kind. Blanks inside are looked at once, however many."""
    return F.regexp_replace(_col(c), r"^[\s\p{Z}\x{FEFF}]+|(?<![\s\p{Z}\x{FEFF}])[\s\p{Z}\x{FEFF}]++\z", "")


def slug(c: str | Column, longest: int = 48, default: str = "untitled") -> Column:
    """Lower-case runs of a-z and 0-9 joined by dashes, cut at ``longest``, no dash at either end."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(_col(c), F.lit("")))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)\z", 1))


def language_of(path: str | Column, default: str = "text") -> Column:
    """The language of a file by its extension."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(default))


def normal_path(c: str | Column) -> Column:
    """Trimmed, without trailing slashes; only slashes become one; blank is null."""
    p = strip(c)
    cut = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", F.lit(None)).when(cut == "", F.lit("/")).otherwise(cut)


def one_spelling(c: str | Column) -> Column:
    """Spellings of one path made equal: ``\\`` is ``/``, ``//`` and ``/./`` are ``/``."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\\", "/"), r"/(?:\.?/)+", "/")


def scoped_path(owner: str | Column, path: str | Column) -> Column:
    """``owner::path``, the key of what an owner does with a path."""
    return F.concat(_col(owner).cast("string"), F.lit("::"), _col(path))


def scoped_parts(key: str | Column) -> Column:
    """A struct ``owner, path`` of such a key, cut at its first ``::``; null without both, or where the owner is no number."""
    at = F.instr(_col(key), F.lit("::"))
    owner = F.substring(_col(key), F.lit(1), at - 1).try_cast("double")
    path = F.substring(_col(key), at + 2, F.length(_col(key)))
    return F.when((at > 1) & (path != "") & owner.isNotNull(), F.struct(owner.alias("owner"), path.alias("path")))


def path_id(c: str | Column) -> Column:
    """The first 16 hex digits of the sha256 of the lower-cased path."""
    return F.substring(F.sha2(F.lower(_col(c)), 256), 1, 16)


def retry_wait_ms(c: str | Column) -> Column:
    """Milliseconds that a rate-limit message asks to wait: 'try again in N ms', else 'in N.N s' rounded up; else null."""
    ms = F.regexp_extract(_col(c), r"(?i)try again in (\d+)\s*ms", 1)
    s = F.regexp_extract(_col(c), r"(?i)try again in (\d+(?:\.\d+)?)\s*s", 1)
    return F.when(ms != "", ms.try_cast("long")).when(s != "", F.ceil(s.try_cast("double") * 1000).cast("long"))


def epoch_ms(value: str | Column) -> Column:
    """Epoch milliseconds of a number in s, ms, us or ns, or of ISO text; 0 for anything else or not positive."""
    c = _col(value).cast("string")
    n = F.when(c.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(c).try_cast("decimal(30,3)"))
    million, thousand = F.lit(1_000_000), F.lit(1_000)
    scaled = F.when(n > 9e15, F.floor(n / million)).when(n > 9e12, F.floor(n / thousand)).when(n < 1e12, F.floor(n * thousand)).otherwise(F.floor(n))
    iso = F.unix_millis(F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c)).cast("timestamp"))  # a failed parse is slow
    return F.coalesce(F.when(n > 0, scaled.cast("long")), F.when(n.isNull(), F.greatest(iso, F.lit(0))), F.lit(0).cast("long"))


def ulid_ms(c: str | Column) -> Column:
    """Epoch milliseconds of a ULID (26 Crockford letters, 'ses_' before it allowed); null for anything else."""
    alphabet = "0123456789abcdefghjkmnpqrstvwxyz"
    body = F.regexp_extract(F.lower(_col(c)), r"^(?:ses_)?([0-9a-hjkmnp-tv-z]{26})$", 1)
    digits = F.split(F.substring(body, 1, 10), "")
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: a * 32 + F.instr(F.lit(alphabet), d) - 1)
    return F.when(body != "", value)


def truncated(c: str | Column, longest: int, end: str = "...") -> Column:
    return F.when(F.length(_col(c)) > longest, F.concat(F.substring(_col(c), 1, longest), F.lit(end))).otherwise(_col(c))


def fingerprint(role: str | Column, text: str | Column, patch: str | Column | None = None) -> Column:
    """``length:prefix240`` of role, text and patch with white space collapsed."""
    flat = lambda c: F.regexp_replace(strip(F.coalesce(_col(c), F.lit(""))), r"\s+", " ")
    whole = F.concat_ws("|", _col(role), flat(text), flat(patch) if patch is not None else F.lit(""))
    return F.concat(F.length(whole).cast("string"), F.lit(":"), F.substring(whole, 1, 240))


def command(c: str | Column) -> Column:
    """Name of a chat command: first word, '/' first, without '@bot', lower case, '_' for '-'; null if there is none."""
    first = F.regexp_extract(strip(c), r"^/([^\s@]+)", 1)
    return F.when(first != "", F.regexp_replace(F.lower(first), "-", "_"))


def command_arguments(c: str | Column) -> Column:
    return strip(F.regexp_replace(strip(c), r"^\S+", ""))


def holds_html(text: str | Column) -> Column:
    """Whether a text holds a page, by its document type in any case. Null holds none."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike("(?i)<!doctype html>"), F.lit(False))
