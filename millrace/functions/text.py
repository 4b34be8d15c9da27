"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the tag tokenizer, English and Chinese.
TAG_STOP_WORDS = """
a an the and or but if then else when while for to of in on at by
with from as is are was were be been being have has had do does did
this that these those it its their there here i you he she we they
me him her us them my your our their what which who whom whose
not no nor so too very can could may might will would shall should
的 了 是 在 有 和 与 或 但 如果 那么 这 那 我 你 他 她 它 我们 你们
他们 也 都 而 及 等 于 上 下 中
""".split()
# The index tokenizer has some more.
INDEX_STOP_WORDS = [*TAG_STOP_WORDS, *"一 个 不 来 去 出 到 没".split()]

CJK = "一-鿿"


def strip(c: Column) -> Column:
    """Without white space (in Unicode's sense) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def index_tokens(text: Column, stop_words: list[str] | None = None, min_length: int = 1) -> Column:
    """Terms of a text for the index: lower-case runs of ASCII letters and digits; single Chinese characters of a run, then its pairs.

    Terms of digits alone, shorter ones than ``min_length`` and stop words are left out.  A null text has no terms.
    """
    if min_length < 1:
        raise ValueError("min_length must be at least 1")
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[A-Za-z0-9]+|[{CJK}]+"), F.lit(0))

    def terms(run: Column) -> Column:
        singles = F.filter(F.split(run, ""), lambda x: x != "")
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(singles, pairs)).otherwise(F.array(F.lower(run)))

    stops = INDEX_STOP_WORDS if stop_words is None else stop_words
    return F.filter(F.flatten(F.transform(runs, terms)), lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) >= min_length) & ~t.isin(stops))


def tag_tokens(text: Column) -> Column:
    """Words for tags: ASCII words of two characters or more and whole Chinese runs, lower case, no stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[A-Za-z][A-Za-z0-9_\-]+|[{CJK}]+"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: (F.length(t) >= 2) & ~t.isin(TAG_STOP_WORDS))


def truncate(text: Column, most: int, strip_end: bool = True) -> Column:
    """At most ``most`` characters; what is cut off is marked by an ellipsis. With most <= 1 it is only cut."""
    if most <= 1:
        return F.when(F.length(text) <= most, text).otherwise(F.substring(text, 1, max(most, 0)))
    cut = F.substring(text, 1, most - 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", "") if strip_end else cut, F.lit("…")))


def first_line(text: Column) -> Column:
    """First line with more than white space, stripped; null if there is none."""
    return F.try_element_at(F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != ""), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences: cut after an end mark and white space, and after line ends; blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?。！？])\s+|(?<=\n)\s*"), strip), lambda x: x != "")


def summary(text: Column, count: int = 2, most: int = 200) -> Column:
    """The first sentences joined by a space, truncated."""
    return truncate(F.array_join(F.slice(sentences(text), 1, count), " "), most)


def image_mentions(text: Column) -> Column:
    """Ids of images mentioned as ``[IMAGE: id]``, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"\[IMAGE:\s*([^\]]+?)\s*\]"), F.lit(1))


def is_marker(text: Column) -> Column:
    """Whether a text is only a ``doc_id:`` marker."""
    return text.rlike(r"(?i)^\s*doc_id\s*:\s*\S+\s*$")


def strip_code_fence(text: Column) -> Column:
    """Without a first and a last line that open or close a code fence."""
    lines = F.split(strip(text), "\n")
    lines = F.when(F.element_at(lines, 1).startswith("```"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    lines = F.when((F.size(lines) > 0) & F.try_element_at(lines, F.lit(-1)).startswith("```"), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return strip(F.array_join(lines, "\n"))


# The patterns of noise, in the order of their removal: (name, pattern, replacement).
NOISE_RULES = [
    ("comments", r"(?s)<!--.*?-->", ""),
    ("images", r"!\[.*?\]\([^)]*\)", ""),
    ("rules", r"(?mdU)^\s*[-*_]{3,}\s*$", ""),
    ("page_numbers", r"(?mdUi)^\s*(?:[-–—]\s*\d+\s*[-–—]|\d+|Page\s+\d+(?:\s+of\s+\d+)?)\s*$", ""),
    ("headers", r"(?mdU)^[A-Z][\w \-,&|]{2,80}$", ""),
    ("line_ends", r"(?md)[ \t]+$", ""),
    ("spaces", r"[ \t]+", " "),
    ("line_sides", r"(?mdU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""),
    ("blank_lines", r"\n{3,}", "\n\n"),
]


def clean(text: Column, skip: tuple[str, ...] = ()) -> Column:
    """Rule-based cleaning; fenced code is left alone, rules named in ``skip`` are not applied."""
    fence = r"(?sd)```[\w+-]*\n.*?```"
    kept = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    marked = F.regexp_replace(text, fence, "\u0000")
    for name, pattern, to in NOISE_RULES:
        if name not in skip:
            marked = F.regexp_replace(marked, pattern, to)
    parts = F.split(marked, "\u0000", -1)
    return strip(F.array_join(F.flatten(F.zip_with(parts, kept, lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))), ""))


def changed_enough(before: Column, after: Column, least: float) -> Column:
    """Whether cleaning changed a text's length by at least a share of it."""
    share = F.abs(F.length(after) - F.length(before)) / F.greatest(F.length(before), F.lit(1))
    return (after != before) & (after != "") & (share >= least)


def json_object(text: Column, schema: str) -> Column:
    """The object between the first ``{`` and the last ``}`` of a model's answer, by a schema; null if it can't be read or lacks a field."""
    found = F.from_json(F.regexp_extract(strip_code_fence(text), r"(?s)\{.*\}", 0), schema)
    names = [f.split()[0] for f in schema.split(",")]
    whole = F.lit(True)
    for n in names:
        whole = whole & found[n].isNotNull()
    return F.when(whole, found)


def json_list(text: Column, schema: str) -> Column:
    """The array between the first ``[`` and the last ``]`` of a model's answer; null if it can't be read."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>")


def says_decorative(text: Column) -> Column:
    """Whether an answer calls an image decoration."""
    return F.contains(F.lower(text), F.lit("decorative")) | F.contains(text, F.lit("装饰"))
