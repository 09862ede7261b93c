"""Fill-in-the-middle forms of texts, cut between units by one match of a counted, possessive pattern per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted

#: A line with its line feed, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")


def draw(seed: int, doc_id: str, number: int) -> Column:
    """The ``number``-th (from 0) group of eight hex digits of sha256 of ``seed:doc_id``; a NULL id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    unit: str = LINE,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` with ``n`` (units of the text), ``form``, ``output``, ``prefix_chars`` and ``middle_chars``.

    The text is cut after two drawn numbers of units: prefix, middle, suffix. ``psm`` writes prefix mark, prefix, suffix
    mark, suffix, middle mark, middle; ``spm`` writes suffix mark, suffix, prefix mark, prefix, middle mark, middle. A
    text that is empty or contains a mark stays as it is (``plain``), as do all but ``percent`` of the texts; their
    counts of characters are NULL. ``spm_percent`` of the others become spm. Draws depend on ``seed`` and the id only,
    so repeated rows get one result and a rerun the same.

    ``unit`` is a pattern without groups that count, whose matches one after the other cover a text. It is repeated
    as often as drawn, possessively, so that a match never goes back into a unit and long texts need no stack; one
    match of prefix, middle and suffix gives the output. NULL counts as empty; columns of the input with the names of
    new ones are replaced. Narrow, in built-in expressions only.
    """
    if any(not m for m in marks) or len(set(marks)) < 3 or any(_overlap(a, b) for a in marks for b in marks):
        raise ValueError("marks must be three different texts, none of which can begin inside another")
    new = {"n", "form", "output", "prefix_chars", "middle_chars"}
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in new]
    whole = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    rows = docs.select(*kept, whole.alias("__text"), *[draw(seed, doc_id, i).alias(f"__h{i + 1}") for i in range(4)])
    rows = rows.withColumn("n", F.regexp_count("__text", F.lit(f"(?s){unit}")).cast("long"))
    a, b = (F.expr(f"__h{i} % (n + 1)") for i in (1, 2))
    has_mark = F.lit(False)
    for mark in marks:
        has_mark = has_mark | F.contains(F.col("__text"), F.lit(mark))
    rows = rows.withColumns(
        {
            "__a": F.least(a, b),
            "__b": F.greatest(a, b),
            "form": F.when((F.col("__text") == "") | has_mark | (F.col("__h3") % 100 >= percent), "plain")
            .when(F.col("__h4") % 100 < spm_percent, "spm")
            .otherwise("psm"),
        }
    )
    group = f"((?:{unit}){{"
    pattern = F.concat(F.lit(rf"(?s)\A{group}"), F.col("__a"), F.lit(f"}}+){group}"), F.col("__b") - F.col("__a"), F.lit(r"}+)(.*)\z"))
    p, s, m = (mark.replace("\\", r"\\").replace("$", r"\$") for mark in marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    rows = rows.withColumn(
        "output", F.when(F.col("form") == "plain", F.col("__text")).otherwise(F.regexp_replace("__text", pattern, order))
    )
    # Marks occur nowhere else in the output, so their places tell the lengths.
    place = {mark: F.locate(mark, F.col("output")) for mark in marks}
    first, second, third = marks
    before = F.when(F.col("form") == "spm", place[third]).otherwise(place[second]) - F.when(F.col("form") == "spm", place[first]).otherwise(1)
    cut = F.col("form") != "plain"
    rows = rows.withColumns(
        {
            "prefix_chars": F.when(cut, before - len(first)).cast("long"),
            "middle_chars": F.when(cut, F.char_length("output") - place[third] + 1 - len(third)).cast("long"),
        }
    )
    return rows.select(*kept, "n", "form", "output", "prefix_chars", "middle_chars")


def _overlap(a: str, b: str) -> bool:
    """Whether ``b`` can begin inside ``a`` (but not with it), or ends in what begins another mark."""
    return any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a)))


def restored_text(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that :func:`fill_in_middle` rearranged, from the output and the form alone."""
    p, s, m = (re.escape(mark) for mark in marks)
    by_form = F.when(F.col(form) == "spm", F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1"))
    by_form = by_form.when(F.col(form) == "psm", F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2"))
    return by_form.otherwise(F.col(output))


def fill_digest(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    made = fill_in_middle(docs.select(F.col(quoted(doc_id)).alias("doc_id"), "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored_text(), 256).alias("restored_sha256"),
    )
