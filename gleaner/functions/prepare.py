"""Column functions that turn raw dataset rows into documents and questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import SPACE, SPACE_RUN, let, split_lines, strip

# Placeholder titles and the shape of a level-one heading.
PLACEHOLDER_TITLE = rf"\A\{{\{{[{SPACE}]*document\.title\.text[{SPACE}]*\}}\}}\z"
LEVEL_ONE = rf"\A[{SPACE}]{{0,3}}#(?!#)[{SPACE}]+(.+?)[{SPACE}]*#*[{SPACE}]*\z"


def slugify(text: Column) -> Column:
    """Lower-case file name stem: word characters and single dashes, at most 80."""
    kept = F.regexp_replace(strip(F.lower(text)), rf"[^\p{{L}}\p{{N}}_{SPACE}-]", "")
    dashed = F.regexp_replace(F.regexp_replace(kept, rf"[{SPACE}_]+", "-"), "-+", "-")
    stem = F.regexp_replace(F.substring(dashed, 1, 80), r"\A-+|-+\z", "")
    return F.when(stem == "", "doc").otherwise(stem)


def one_line(text: Column) -> Column:
    """Whitespace runs become single blanks; none at the ends."""
    return F.regexp_replace(strip(text), SPACE_RUN, " ")


def is_placeholder_title(title: Column) -> Column:
    flat = one_line(title)
    return (flat == "") | flat.rlike(PLACEHOLDER_TITLE)


def pick_text(*candidates: Column) -> Column:
    """First candidate with anything but whitespace, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit(""))


def first_h1(text: Column) -> Column:
    """First usable level-one heading outside fenced code; empty if there is none."""
    start = F.struct(F.lit(False).alias("fenced"), F.lit("").alias("title"))

    def step(s: Column, line: Column) -> Column:
        fence = F.regexp_replace(line, rf"\A[{SPACE}]+", "").rlike(r"\A(```|~~~)")
        heading = strip(F.regexp_extract(line, LEVEL_ONE, 1))
        usable = (
            (s["title"] == "") & ~fence & ~s["fenced"] & line.rlike(LEVEL_ONE)
            & ~is_placeholder_title(heading)
        )
        return F.struct(
            F.when(fence, ~s["fenced"]).otherwise(s["fenced"]).alias("fenced"),
            F.when(usable, heading).otherwise(s["title"]).alias("title"),
        )

    # Only fences and lines that may be headings matter to the fold.
    relevant = F.filter(
        split_lines(text), lambda line: line.rlike(rf"\A[{SPACE}]*(#|```|~~~)")
    )
    return F.aggregate(relevant, start, step, lambda s: s["title"])


def url_title(url: Column) -> Column:
    """Readable last path segment of a URL; empty if there is none."""
    bare = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    path = F.regexp_replace(bare, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", "")
    # Parameters after ";" belong to the last segment only.
    cut = F.regexp_replace(path, r";[^/]*\z", "")
    segments = F.filter(F.split(cut, "/"), lambda s: s != "")
    segment = F.try_element_at(segments, F.lit(-1))
    # url_decode turns "+" into a blank, a URL path keeps it.
    decoded = F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)
    name = F.regexp_replace(decoded, r"(?i)\.(?:html?|mdx?)\z", "")
    return F.coalesce(one_line(F.regexp_replace(name, r"[-_]+", " ")), F.lit(""))


def resolve_title(title: Column, text: Column, url: Column, doc_id: Column) -> Column:
    """struct(title, method): dataset title, first heading, URL path or the id."""
    def chosen(value: Column, method: str) -> Column:
        return F.struct(value.alias("title"), F.lit(method).alias("method"))

    return let(F.struct(first_h1(text).alias("h1"), url_title(url).alias("url")), lambda t: (
        F.when(~is_placeholder_title(title), chosen(strip(title), "dataset_title"))
        .when(t["h1"] != "", chosen(t["h1"], "markdown_h1"))
        .when(t["url"] != "", chosen(t["url"], "source_url_path"))
        .otherwise(chosen(doc_id, "original_doc_id"))
    ))


def doc_to_markdown(title: Column, text: Column) -> Column:
    bare = strip(title)
    heading = F.when(bare == "", "Untitled").otherwise(bare)
    return F.concat(F.lit("# "), heading, F.lit("\n\n"), strip(text), F.lit("\n"))


def gold_ids_from_text(raw: Column) -> Column:
    """Comma-separated ids as an array of stripped, non-empty ids."""
    return gold_ids_from_list(F.split(raw, ","))


def gold_ids_from_list(raw: Column) -> Column:
    return F.filter(F.transform(raw, strip), lambda i: i != "")
