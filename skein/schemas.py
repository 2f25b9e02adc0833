"""Column layouts of the graph tables, and fixed weights of edge kinds."""

#: nodes(id, corpus, path, language, signature, kind, package, line, end_line, test_role)
#: edges(src, dst, kind, provenance, language, confidence)
#: edge_sites(src, dst, kind, line, col)
NODE = ("id", "corpus", "path", "language", "signature", "kind", "package", "line", "end_line", "test_role")
EDGE = ("src", "dst", "kind", "provenance", "language", "confidence")

#: How much of a node's rank flows along an edge of each kind.
EDGE_WEIGHTS = {
    "ref/call": 1.00,
    "ffi/call": 0.85,
    "defines/binding": 0.70,
    "exports": 0.60,
    "depends": 0.50,
    "resolves-to": 0.50,
    "ref/field": 0.50,
    "ref/imports": 0.40,
    "is-implementation": 0.40,
    "configures": 0.35,
    "overrides": 0.30,
    "external-dependency": 0.30,
}

SEMANTIC_KINDS = ("ref/call", "ref/field", "ffi/call", "is-implementation", "overrides", "resolves-to")
CONTAINMENT_KINDS = ("defines/binding",)
