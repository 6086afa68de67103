"""Links between notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(x: Column) -> Column:
    """``x`` as a literal inside a regular expression."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}_ ])", r"\\$1")


def has_link(text: Column, base: Column, path: Column) -> Column:
    """The text links to the note, by base name or path, as a wiki or Markdown link in any case."""
    b, p = _quoted(base), _quoted(path)
    pattern = F.concat(
        F.lit(r"(?i)\[\["), b, F.lit(r"(?:\|[^\]]*)?\]\]|\[[^\n]*?\]\("), b, F.lit(r"\.md\)|\[\["), p, F.lit(r"(?:\|[^\]]*)?\]\]")
    )
    return F.regexp_like(text, pattern)


def with_link(text: Column, base: Column, path: Column, title: str) -> Column:
    """The text with a link to the note below the heading ``title``, which is added at the end if missing.

    A text that has the link already stays as it is.
    """
    head = f"\n## {title}\n"
    quoted = "".join(c if c.isalnum() or c in " _" else "\\" + c for c in title)
    section = rf"\n## {quoted}\n((?:- \[\[[^\]]+\]\]\n)*)"
    at = F.instr(text, head)
    items = F.regexp_extract(text, section, 1)
    end = at + len(head) - 1 + F.length(items)
    item = F.concat(F.lit("- [["), base, F.lit("]]\n"))
    extended = F.concat(F.left(text, end), item, F.substr(text, end + 1))
    return F.when(has_link(text, base, path), text).when(at > 0, extended).otherwise(F.concat(text, F.lit("\n" + head), item))


def link_edges(corpus: DataFrame) -> DataFrame:
    """(src_id, dst_id): who links to whom, by joining the targets found in the texts with titles and paths."""
    wiki = F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]|\n#]+)"), F.lit(1))
    plain = F.regexp_extract_all("text", F.lit(r"\]\(([^()\n]+)\.md\)"), F.lit(1))
    targets = corpus.select(F.col("doc_id").alias("src_id"), F.explode(F.array_distinct(F.transform(F.concat(wiki, plain), F.lower))).alias("target"))
    names = corpus.select(
        F.col("doc_id").alias("dst_id"),
        F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("path"), F.lower(F.regexp_replace("path", r"(?i)\.md$", ""))))).alias("target"),
    )
    return targets.join(names, "target").where(F.col("src_id") != F.col("dst_id")).select("src_id", "dst_id").distinct()
