"""Record constructors shared by sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sectioned(*parts: tuple[str, Column]) -> Column:
    """``## Heading`` blocks joined by empty lines; a block whose body is null or empty is left out."""
    blocks = [F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {heading}\n\n"), body)) for heading, body in parts]
    return F.array_join(F.array_compact(F.array(*blocks)), "\n\n")


def qa_text(question: str, contexts: str, answer: str) -> Column:
    head = F.concat(F.lit("## Question\n\n"), F.coalesce(F.col(question), F.lit("")), F.lit("\n\n## Evidence\n\n"), F.array_join(F.coalesce(F.col(contexts), F.array().cast("array<string>")), "\n\n"))
    given = F.coalesce(F.col(answer), F.lit("")) != ""
    return F.when(given, F.concat(head, F.lit("\n\n## Answer\n\n"), F.col(answer))).otherwise(head)
