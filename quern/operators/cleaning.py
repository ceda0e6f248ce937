"""Cleaning of page texts as one operator: noise by patterns, repeated heads and feet, repeated and blank lines, with counts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: fixed values: times and pages that a printer leaves
NOISE = {
    "printed_at": r"\d{1,2}\.\s*\d{1,2}\.\s*\d{1,2}\.\s*(오전|오후)\s*\d{1,2}:\d{2}",
    "printed_time": r"(오전|오후)\s?\d{1,2}:\d{2}",
    "page_number": r"^\s*(페이지|[Pp]age)\s*\d+(\s*(/|of)\s*\d+)?\s*$",
}


def line_key(line: Column) -> Column:
    """What lines that differ by case and spaces share."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def noise_of(line: Column, patterns: dict[str, str]) -> Column:
    """The first pattern's name that the line matches."""
    out = F.lit(None).cast("string")
    for name, p in reversed(patterns.items()):
        out = F.when(line.rlike(p), F.lit(name)).otherwise(out)
    return out


def without_noise(lines: Column, patterns: dict[str, str]) -> Column:
    """struct kept (lines), counts (a map of each pattern's lines) and samples (three at most)."""
    named = F.transform(lines, lambda x: F.struct(noise_of(x, patterns).alias("n"), x.alias("x")))
    bad = F.filter(named, lambda s: s["n"].isNotNull())
    of = lambda name: F.size(F.filter(bad, lambda s: s["n"] == name))
    counts = F.map_from_arrays(F.array(*map(F.lit, patterns)), F.array(*map(of, patterns)))
    samples = F.transform(F.slice(bad, 1, 3), lambda s: F.concat(s["n"], F.lit(": "), F.left(s["x"], F.lit(50))))
    return F.struct(F.transform(F.filter(named, lambda s: s["n"].isNull()), lambda s: s["x"]).alias("kept"), counts.alias("counts"), samples.alias("samples"))


def page_edges(pages: Column, edge: int) -> Column:
    """The keys of the first and last ``edge`` lines of each page, those of more than five characters."""
    def of(page: Column) -> Column:
        lines = F.split(page, "\n")
        both = F.concat(F.slice(lines, 1, edge), F.reverse(F.slice(F.reverse(lines), 1, edge)))
        return F.transform(F.filter(both, lambda x: F.length(F.trim(x)) > 5), line_key)

    return F.flatten(F.transform(pages, of))


def repeated(keys: Column, least: int) -> Column:
    """Keys that stand in the array ``least`` times or more; sorted once, so equal ones stand together."""
    return let(F.array_sort(keys), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + (least - 1)) == x)))


def at_most(lines: Column, most: int) -> Column:
    """Of each run of equal lines the first ``most``."""
    def of(own: Column) -> Column:
        same = lambda x, i: F.forall(F.sequence(F.lit(1), F.lit(most)), lambda k: F.get(own, i - k) == x)
        return F.filter(own, lambda x, i: ~((i >= most) & F.coalesce(same(x, i), F.lit(False))))

    return let(lines, of)


def blank_lines(lines: Column) -> Column:
    """Runs of blank lines as one empty line, none at the ends."""
    bare = F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(x))
    one = let(bare, lambda b: F.filter(b, lambda x, i: (x != "") | (i == 0) | (F.get(b, i - 1) != "")))
    first = let(one, lambda o: F.when(F.get(o, F.lit(0)) == "", F.slice(o, F.lit(2), F.size(o))).otherwise(o))
    return let(first, lambda f: F.when(F.element_at(f, -1) == "", F.slice(f, F.lit(1), F.size(f) - 1)).otherwise(f))


def cleaned(docs: DataFrame, patterns: dict[str, str] | None = None, edge: int = 3, least: int = 3, most: int = 2, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``cleaned`` (text), ``noise`` (a map of counts), ``repeated`` and ``consecutive`` (lines removed) and ``samples``.

    Patterns go first, then lines that stand at the edges of ``least`` pages (form feeds part these), then all but ``most`` of equal
    lines in a run; blank lines are made one. A null text is an empty one.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_n", without_noise(F.split(whole, "\n"), patterns or NOISE))
    step = step.withColumn("_pages", F.split(F.array_join("_n.kept", "\n"), "\f")).withColumn("_bad", repeated(page_edges(F.col("_pages"), edge), least))
    step = step.withColumn("_lines", let(F.col("_bad"), lambda b: F.filter("_n.kept", lambda x: ~F.array_contains(b, line_key(x))))).withColumn("_once", at_most(F.col("_lines"), most))
    return step.select(*docs.columns, F.array_join(blank_lines(F.col("_once")), "\n").alias("cleaned"), F.col("_n.counts").alias("noise"), (F.size("_n.kept") - F.size("_lines")).alias("repeated"), (F.size("_lines") - F.size("_once")).alias("consecutive"), F.col("_n.samples").alias("samples"))


#: fixed values: what printing a page of an approval system leaves in a line, and lines that are only a page number
PRINT_REMAINS = (r"mode=getPrint", r"menu_depth=\d+", r"is_mark=", r"idx=\d+")
PAGE_LINE = r"(?m)^\s*\d+/\d+\s*$\n"


def without_print_remains(text: Column, hosts: tuple[str, ...] = ()) -> Column:
    """A text without lines that name a host (regular expressions) or hold what printing left, and without page numbers.

    Four line ends or more go altogether, blanks at the ends of lines too, three line ends become two, and the ends are trimmed. If fewer than 50
    characters of more than 100 are left, the text stays as it was.
    """
    # A pattern is tried where a line or a run of blanks begins, not at each of its characters.
    line = lambda p: f"(?<![^\\n])[^\\n]*{p}[^\\n]*\\n?"
    out = text
    for p in hosts:
        out = F.regexp_replace(out, line(p), "")
    out = F.regexp_replace(out, PAGE_LINE, "")
    for p in PRINT_REMAINS:
        out = F.regexp_replace(out, line(p), "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{4,}", ""), r"(?m)(?<![ \t])[ \t]+$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|(?<!\s)\s+\z", "")
    return let(F.struct(out.alias("out"), text.alias("text")), lambda s: F.when((F.length(s["out"]) < 50) & (F.length(s["text"]) > 100), s["text"]).otherwise(s["out"]))
