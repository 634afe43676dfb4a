"""Text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace Python strips and splits on, for use in a class.
SPACE = (
    r" \t\n\x0b\f\r\x1c-\x1f\x85\xa0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same without LF, as characters.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n")
SPACE_RUN = rf"[{SPACE}]+"
NON_SPACE = rf"[^{SPACE}]"
_EDGES = rf"\A[{SPACE}]+|[{SPACE}]+\z"

# Line separators of Python's splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Unicode-aware strip of both ends."""
    return F.regexp_replace(text, _EDGES, "")


def has_text(text: Column) -> Column:
    """True when anything but whitespace is present."""
    return text.rlike(NON_SPACE)


def tokenize(text: Column) -> Column:
    """Lower-case and split on runs of Unicode whitespace; no other clean-up."""
    return F.array_remove(F.split(F.lower(text), SPACE_RUN), "")


def token_count(text: Column) -> Column:
    """Size of ``tokenize(text)``; only the first and the last piece of a split can be empty."""
    def count(t: Column) -> Column:
        first, last = t[0] == "", (F.size(t) > 1) & (F.element_at(t, -1) == "")
        return F.size(t) - first.cast("int") - last.cast("int")

    return let(F.split(text, SPACE_RUN), count)


def normalize_text(text: Column) -> Column:
    """LF line ends, no trailing blanks on lines, at most two blank lines in a row."""
    lf = line_feeds(text)
    lines = F.transform(F.split(lf, "\n", -1), lambda line: F.rtrim(line, F.lit(BLANKS)))
    return let(F.array_join(lines, "\n"), _collapse_blank_lines)


def line_feeds(text: Column) -> Column:
    """LF line ends; most texts have no others and pass as they are."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n|\r", "\n")).otherwise(text)


def _collapse_blank_lines(trimmed: Column) -> Column:
    # n newlines at an edge are n blank lines; inside a text they are n - 1.
    only_blank = F.when(trimmed.startswith("\n") & trimmed.rlike(r"\A\n+\z"), F.lit("\n"))
    collapsed = F.regexp_replace(
        F.regexp_replace(
            F.regexp_replace(trimmed, r"\A\n{3,}", "\n\n"), r"\n{3,}\z", "\n\n"
        ),
        r"\n{4,}",
        "\n\n\n",
    )
    return F.coalesce(only_blank, F.when(F.contains(trimmed, F.lit("\n\n\n")), collapsed).otherwise(trimmed))


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunk_id(doc_id: Column, char_start: Column, text: Column) -> Column:
    """First 16 hex digits of sha256("doc_id:char_start:text")."""
    return F.substring(
        sha256_text(F.concat_ws(":", doc_id, char_start.cast("string"), text)), 1, 16
    )


def preview(text: Column, length: int = 120) -> Column:
    """Single-line preview: cut, then fold newlines, then strip."""
    return strip(F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" ")))


def split_lines(text: Column) -> Column:
    """Lines as Python's splitlines() sees them, apart from a final empty one."""
    return F.split(text, LINE_BREAK)


def path_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def path_format(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"[^/]\.md$"), "markdown").otherwise("text")


def document_title(raw_text: Column, path: Column, fmt: Column) -> Column:
    """First "# " line of a Markdown text, else the file stem."""
    headings = F.filter(
        F.transform(split_lines(raw_text), strip), lambda line: line.startswith("# ")
    )
    first = F.get(headings, F.lit(0))
    heading = strip(F.substr(first, F.lit(3)))
    return F.when((fmt == "markdown") & first.isNotNull(), heading).otherwise(path_stem(path))


def source_group(doc_id: Column) -> Column:
    """First path component of a document id."""
    return F.split_part(doc_id, F.lit("/"), F.lit(1))


def path_order(doc_id: Column) -> Column:
    """Sort key that compares paths component by component: the separator sorts first."""
    return F.translate(doc_id, "/", "\x01")


def fixed(value: Column, digits: int) -> Column:
    """A number with that many decimals as Python and C print it: the exact binary value decides, ties go to the even digit.

    ``format_string`` rounds the shortest decimal form half up, so that 0.0625 became 0.063. Beyond
    2**52 steps, and for what is not finite, it still does the job.
    """
    scale = float(10 ** digits)

    def shown(v: Column) -> Column:
        x = F.abs(v)
        # The product with the scale and what its rounding left out, exactly (Dekker).
        high = x * 134217729.0 - (x * 134217729.0 - x)
        product = x * scale
        rest = (high * scale - product) + (x - high) * scale
        return let(F.struct(product.alias("product"), rest.alias("rest")), lambda p: F.when(
            p["product"] < 2.0 ** 52, let(_steps(p), lambda n: _places(v, n))
        ).otherwise(F.format_string(f"%.{digits}f", v)))

    def _steps(p: Column) -> Column:
        down = F.floor(p["product"]).cast("double")
        tie = p["product"] - down == 0.5
        return F.when(tie & (p["rest"] > 0), down + 1).when(tie & (p["rest"] < 0), down).otherwise(F.rint(p["product"])).cast("long")

    def _places(v: Column, n: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        whole = F.floor(n / F.lit(int(scale))).cast("long")
        return F.format_string(f"%s%d.%0{digits}d", sign, whole, n - whole * int(scale))

    return let(value.cast("double"), shown)  # bound, so that generated code does not repeat the value
