"""Scalar scores and labels, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages and the file endings that stand for them.
ENDINGS = {
    "typescript": "ts tsx mts cts js jsx mjs cjs",
    "rust": "rs",
    "python": "py pyi",
    "go": "go",
    "java": "java",
    "kotlin": "kt kts",
    "ruby": "rb rake gemspec",
    "csharp": "cs",
    "php": "php phtml php8",
    "scala": "scala sc",
    "cpp": "cpp cc cxx hpp hh hxx",
    "c": "c h",
    "swift": "swift",
    "dart": "dart",
    "objc": "m mm",
    "json": "json jsonc",
    "yaml": "yml yaml",
    "toml": "toml",
    "xml": "xml xsd xsl",
    "markdown": "md markdown mdx",
}
EXTENSIONS = {ending: language for language, own in ENDINGS.items() for ending in own.split()}
#: Folders that a walk of sources leaves out.
SKIPPED_FOLDERS = ".claude .git target node_modules dist .next .vscode .vscode-test".split()
#: How high a neighbour's score may be shown by the answer's confidence.
CEILINGS = {"exact": 1.0, "strong": 1.0, "weak": 0.6, "none": 0.4}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def is_skipped(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.isin(SKIPPED_FOLDERS))


def display_score(score: Column, reranked: Column, primary: Column, confidence: Column) -> Column:
    """What a row shows: a reranked score as it is, a primary row the ceiling of the answer's confidence, a neighbour at most that."""
    ceiling = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CEILINGS.items() for x in kv]), confidence), F.lit(0.4))
    return F.when(reranked.isNotNull(), reranked).when(primary, ceiling).otherwise(F.least(score, ceiling))


def match_source(kind: Column, is_test: Column) -> Column:
    return F.when(is_test, "tests").when(kind.isin("anchor", "name"), "exact").when(kind == "knn", "semantic").otherwise("relevant")


def rerank_band(score: Column, exact: Column, weak: float = 0.5) -> Column:
    return F.when(exact, 0).when(score >= weak, 1).when(score.isNull(), 2).otherwise(3)


def rerank_multiplier(score: Column, weak: float = 0.5) -> Column:
    m = F.when(score <= weak, 0.1 + 0.9 * score / weak).otherwise(1 + (score - weak) / (1 - weak))
    return F.least(F.lit(2.0), F.greatest(F.lit(0.1), m))


def layered(*layers: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, source) of a setting: the first layer that has it."""
    value = F.coalesce(*[c for _, c in layers])
    source = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in layers])
    return value, source
