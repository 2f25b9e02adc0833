"""Filters over nodes and edges, as columns or semi-joins, so that Catalyst can push them into scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.schemas import CONTAINMENT_KINDS, SEMANTIC_KINDS

#: Path rules of vendored, cached, generated and test code.
VENDORED = r"^(third_party|vendor|node_modules)/|/node_modules/|^\.\./|/Library/Caches/|/\.cache/|/go-build/|/go/pkg/mod/"
STRUCTURAL = (
    r"/(tests|benches)/|^(tests|benches)/|(^|/)(fixtures|fuzz|testdata)/|_test\.go$|/_test/|/target/(debug|release|classes|generated-sources)/|/target/scala-|/dist/.*\.js$|/__pycache__/|\.pyc$"
    r"|(^|/)src/test/(java|kotlin|scala)/|(^|/)build/(classes|generated)/|\.class$|(^|/)spec/|/vendor/bundle/|/vendor/.*\.php$|\.(o|obj)$|/CMakeFiles/|/_deps/|/\.dart_tool/|/\.pub-cache/"
    r"|(^|/)(obj|bin)/(Debug|Release)/|\.(AssemblyInfo|GlobalUsings\.g)\.cs$"
)


def is_noise(path: Column, signature: Column) -> Column:
    return path.rlike(VENDORED) | signature.rlike(r"local [0-9]+$")


def is_structural_noise(path: Column, signature: Column, kind: Column) -> Column:
    return is_noise(path, signature) | kind.isin("doc-chunk", "crate") | signature.startswith("scip:") | path.rlike(STRUCTURAL)


def is_anchor_noise(path: Column, signature: Column, kind: Column, test_role: Column) -> Column:
    """What may not anchor a query: structural noise, packages of build workflows, and tests among the sources."""
    workflow = signature.startswith("pkg:") & path.rlike(r"(^|/)\.(github|gitlab|circleci|buildkite)/")
    return is_structural_noise(path, signature, kind) | workflow | (F.coalesce(test_role, F.lit(0)) > 0)


def visible_edges(edges: DataFrame, nodes: DataFrame, allowed: list[str] | None) -> DataFrame:
    """Edges whose target lies in an allowed corpus; an unknown corpus is denied; None allows all. Denied targets never enter a traversal."""
    if allowed is None:
        return edges
    return edges.join(nodes.where(F.col("corpus").isin(allowed)).select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def by_provenance(edges: DataFrame, want: str = "") -> DataFrame:
    """'': all; 'ratified': all but live; else exactly that."""
    known = {"", "ratified", "tree-sitter", "scip", "lsif", "live"}
    if want not in known:
        raise ValueError(f"provenance is one of {sorted(known)}")
    if not want:
        return edges
    return edges.where(F.col("provenance") != "live" if want == "ratified" else F.col("provenance") == want)


def edge_flags(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"is_semantic": F.col("kind").isin(*SEMANTIC_KINDS), "is_containment": F.col("kind").isin(*CONTAINMENT_KINDS), "is_heuristic": (F.col("kind") == "ref/call") & (F.col("provenance") == "tree-sitter")})


def match_path_hint(path: Column, hint: str) -> Column:
    return (path == hint) | path.endswith("/" + hint) | path.startswith(hint.rstrip("/") + "/") | path.contains(hint)


def exact_kind(name: Column, signature: Column) -> Column:
    """How a name meets a signature: exact, suffix (after a colon or a dot), prefix, substring, or null."""
    body = F.regexp_replace(signature, "^[^:]*:", "")
    return (
        F.when((signature == name) | (body == name), "exact").when(F.endswith(signature, F.concat(F.lit(":"), name)) | F.endswith(signature, F.concat(F.lit("."), name)), "suffix").when(F.startswith(body, name), "prefix").when(F.contains(signature, name), "substring")
    )
