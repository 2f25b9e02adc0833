"""Ingest of dumps, manifests, sources and documents into nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def link_candidates(files: DataFrame, names: list[str]) -> DataFrame:
    """(importer, target): for each file and name the file of that name in its folder, by equality on the candidate path."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    c = files.select(F.col("id").alias("importer"), F.explode(F.array(*[F.concat(folder, F.lit("/" + n)) for n in names])).alias("path"))
    return c.join(files.select("path", F.col("id").alias("target")), "path").where("importer <> target").select("importer", "target")


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash)."""
    j = old.withColumnRenamed("hash", "was").join(new.withColumnRenamed("hash", "now"), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def lsif_occurrences(lines: DataFrame) -> DataFrame:
    """(path, line, symbol) from a line-per-item dump: contains edges tie ranges to documents, item edges tie them to result sets. Other lines are skipped."""
    from skein.sources.storage import written

    read = lines.select(F.json_tuple("value", "id", "label", "path", "symbol", "line", "outV", "inV").alias("id", "label", "path", "symbol", "line", "out", "in"))
    of = read.where("label IN ('document', 'range', 'resultSet', 'contains', 'item')")
    v = written(of.select(F.col("id").cast("long").alias("id"), "label", "path", "symbol", F.col("line").cast("int").alias("line"), F.col("out").cast("long").alias("out"), F.col("in").cast("long").alias("in")))  # a line is taken apart once
    docs = v.where("label = 'document'").select(F.col("id").alias("out"), "path")
    ranges = v.where("label = 'range'").select(F.col("id").alias("in"), "line")
    sets = v.where("label = 'resultSet'").select(F.col("id").alias("set_id"), "symbol")
    held = v.where("label = 'contains'").select("out", "in").join(docs, "out").join(ranges, "in").select(F.col("in").alias("range_id"), "path", "line")
    items = v.where("label = 'item'").select(F.col("out").alias("set_id"), F.col("in").alias("range_id"))
    return held.join(items, "range_id").join(sets, "set_id").select("path", "line", "symbol")


def scip_parts(c: F.Column) -> list[F.Column]:
    """(container, name, kind) of a symbol's last descriptors: types end in #, methods in (). and terms in a dot."""
    last = F.regexp_extract(c, r"([A-Za-z0-9_]+)(#|\(\)\.|\.)$", 1)
    mark = F.regexp_extract(c, r"(#|\(\)\.|\.)$", 1)
    owner = F.regexp_extract(c, r"([A-Za-z0-9_]+)#[A-Za-z0-9_]+(?:\(\))?\.$", 1)
    kind = F.when(mark == "#", "class").when(mark == "().", "method").when(mark == ".", "field").otherwise("unknown")
    return [owner.alias("container"), last.alias("name"), kind.alias("kind")]


def markdown_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, position, heading, n_chars): a document's sections; a heading is a line of one to six number signs and a space."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=#{1,6} )")
    s = docs.select("doc_id", F.posexplode(parts).alias("position", "section"))
    return s.select("doc_id", "position", F.regexp_extract("section", r"^#{1,6} ([^\n]*)", 1).alias("heading"), F.length("section").alias("n_chars"))


def extract_python(files: DataFrame) -> DataFrame:
    """Nodes (path, signature, kind, line, end_line) of Python sources (path, text), by the standard library's parser; files that don't parse give their file node alone."""
    import ast

    import pandas as pd

    def parse(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                rows.append((path, f"file:{path}", "file", None, None))
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue

                def visit(node, owner, path=path):
                    for child in ast.iter_child_nodes(node):
                        if isinstance(child, ast.ClassDef):
                            rows.append((path, f"class:{owner}{child.name}", "class", child.lineno, child.end_lineno))
                            visit(child, f"{owner}{child.name}.")
                        elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                            kind = "method" if owner else "function"
                            rows.append((path, f"{'method' if owner else 'fn'}:{owner}{child.name}", kind, child.lineno, child.end_lineno))
                            visit(child, f"{owner}{child.name}.")
                        elif isinstance(child, (ast.Import, ast.ImportFrom)):
                            module = "." * getattr(child, "level", 0) + (getattr(child, "module", None) or "")
                            names = [a.name for a in child.names] if isinstance(child, ast.Import) else [module]
                            rows.extend((path, f"import:{n}", "import", child.lineno, child.end_lineno) for n in names)
                        else:
                            visit(child, owner)

                visit(tree, "")
            yield pd.DataFrame(rows, columns=["path", "signature", "kind", "line", "end_line"]).astype({"line": "Int32", "end_line": "Int32"})

    return files.select("path", "text").mapInPandas(parse, "path string, signature string, kind string, line int, end_line int")


def package_dependencies(manifests: DataFrame) -> DataFrame:
    """(path, name, version) of the dependencies in JSON manifests (path, text)."""
    m = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    both = F.map_concat(F.coalesce(m["devDependencies"], F.create_map().cast("map<string,string>")), F.coalesce(m["dependencies"], F.create_map().cast("map<string,string>")))
    return manifests.select("path", F.explode(both).alias("name", "version"))
