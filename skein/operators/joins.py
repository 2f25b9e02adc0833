"""Joins of ingest and lookup. Range and suffix conditions carry equality keys, so that no plan is a nested loop over both sides."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.sources.storage import counted, written

#: Lines in a bin of the range joins.
BIN = 64
#: Values of a list that stands for as many rows of a key.
LISTED = 1024
#: Pairs that a task of ffi_edges makes, on average, at most.
PAIRS = 10_000_000


def with_signatures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' signatures; a missing end's is empty."""
    n = nodes.select("id", "signature")
    s, d = n.toDF("src", "src_sig"), n.toDF("dst", "dst_sig")
    return edges.join(s, "src", "left").join(d, "dst", "left").fillna("", ["src_sig", "dst_sig"])


def span_attribution(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each (path, line) the narrowest span of the path that holds the line, else the path's file node.

    Lines fall into bins and a span lies in each bin it touches: an equality on path and bin, so that a line meets only the
    spans around it, however many its file has.
    """
    bins = F.explode(F.sequence(F.expr(f"line div {BIN}"), F.expr(f"end_line div {BIN}")))
    spans = nodes.where("line IS NOT NULL AND end_line >= line").select("path", F.col("id").alias("span_id"), F.col("line").alias("from_line"), F.col("end_line").alias("to_line"), bins.alias("bin"))
    files = nodes.where("kind = 'file'").groupBy("path").agg(F.min("id").alias("file_id"))
    held = sites.withColumn("bin", F.expr(f"line div {BIN}")).join(spans, ["path", "bin"]).where("line BETWEEN from_line AND to_line").select("path", "line", "span_id", (F.col("to_line") - F.col("from_line")).alias("width"))
    best = held.groupBy("path", "line").agg(F.min(F.struct("width", "span_id")).alias("b")).select("path", "line", F.col("b.span_id").alias("span_id"))
    return sites.join(best, ["path", "line"], "left").join(files, "path", "left").select("path", "line", F.coalesce("span_id", "file_id").alias("owner"))


def nearest_line(refs: DataFrame, nodes: DataFrame, within: int = 5) -> DataFrame:
    """For each reference (path, signature, line) the node of that path and signature that holds the line, else the nearest within so many lines."""
    n = nodes.where("line IS NOT NULL").select("path", "signature", F.col("id").alias("node_id"), F.col("line").alias("n_line"), "end_line")
    j = refs.join(n, ["path", "signature"]).withColumns({"held": F.col("line").between(F.col("n_line"), F.col("end_line")), "gap": F.abs(F.col("line") - F.col("n_line"))}).where("held OR gap <= %d" % within)
    best = j.groupBy("ref_id").agg(F.min(F.struct((~F.col("held")).alias("out"), "gap", "node_id")).alias("b"))
    return best.select("ref_id", F.col("b.node_id").alias("node_id"), F.col("b.gap").alias("gap"))


def alias_rewrite(refs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Callees that have an alias are replaced by what it stands for."""
    return refs.join(aliases.select(F.col("alias").alias("callee"), "target"), "callee", "left").select(*[c for c in refs.columns if c != "callee"], F.coalesce("target", "callee").alias("callee"))


def suffix_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """Each file once for each suffix of whole path segments: a suffix match becomes an equality, its cost the path's depth."""
    parts = F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.withColumn("key", F.explode(suffixes))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, file_id): imports' targets, by the key that the importer's language gives an import and whole-segment suffixes of files.

    Dotted languages name a file by its path with dots; the others name it by a path.
    """
    spec = F.regexp_replace("spec", "^import:", "")
    dotted = F.translate(F.regexp_replace(spec, "\\.\\*$", ""), ".", "/")
    extensions = F.create_map(*[F.lit(x) for k, v in {"java": ".java", "kotlin": ".kt", "scala": ".scala", "csharp": ".cs", "python": ".py", "typescript": ".ts", "rust": ".rs", "go": ".go", "php": ".php"}.items() for x in (k, v)])
    base = F.when(F.col("language").isin("java", "kotlin", "scala", "csharp", "python"), dotted).when(F.col("language") == "php", F.translate(spec, "\\", "/")).otherwise(spec)
    keyed = imports.withColumn("key", F.concat(base, F.coalesce(F.element_at(extensions, F.col("language")), F.lit(""))))
    return keyed.join(suffix_keys(files.select(F.col("id").alias("file_id"), "path")), "key").select("import_id", "file_id").distinct()


def copackage_edges(files: DataFrame) -> DataFrame:
    """depends edges between all ordered pairs of files in a package. The result is as large as the packages' squares; that is what is asked for."""
    a, b = files.select(F.col("id").alias("src"), "package"), files.select(F.col("id").alias("dst"), "package")
    return a.join(b, "package").where("src <> dst").select("src", "dst", F.lit("depends").alias("kind"))


def ffi_edges(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Cross-language calls by corpus, target language and normalised name, with a confidence by the arities; sure ones also call back."""
    name = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    c, t = calls.withColumn("key", name(F.col("name"))), targets.withColumn("key", name(F.col("name"))).select("key", "corpus", F.col("id").alias("dst"), F.col("language").alias("target_language"), F.col("arity").alias("target_arity"))
    score = F.when(F.col("arity").isNull() | F.col("target_arity").isNull(), 50).when(F.col("arity") == F.col("target_arity"), 90).otherwise(30)
    # A name may stand for a large share of both sides: targets go to where calls are, and calls are dealt by what comes of them, not by name.
    on = ["key", "corpus", "target_language"]
    pairs = c.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(t.groupBy(*on).agg(F.count(F.lit(1)).alias("m")), on).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    parts = max(int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / PAIRS))
    # Calls that meet the same targets follow each other, so that the result packs well.
    found = c.repartition(parts, "src").sortWithinPartitions(*on, "arity").join(counted(t), on).select("src", "dst", score.alias("confidence"))
    row = lambda src, dst, kind: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.col("confidence"))
    there, back = row("src", "dst", "ffi/call"), row("dst", "src", "ref/call")
    return found.select(F.inline(F.when(F.col("confidence") >= 80, F.array(there, back)).otherwise(F.array(there))))


def with_inherited_version(wanted: DataFrame, provided: DataFrame) -> DataFrame:
    """Each dependency's version from its workspace; without one, 'workspace'. The last provider counts."""
    p = provided.groupBy("workspace", "name").agg(F.max_by("version", "position").alias("version"))
    return wanted.join(p, ["workspace", "name"], "left").withColumn("version", F.coalesce("version", F.lit("workspace")))


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(call_id, target): a call's only candidate of its signature, language and corpus; with several or none the call abstains (null)."""
    n = nodes.where(F.col("kind").isin("function", "method", "class")).select(F.col("signature").alias("callee"), "language", "corpus", F.col("id").alias("target"))
    j = calls.join(n, ["callee", "language", "corpus"], "left").where("target IS NULL OR target <> src")
    only = j.groupBy("call_id").agg(F.count("target").alias("n"), F.max("target").alias("target"))
    return calls.select("call_id").join(only, "call_id", "left").select("call_id", F.when(F.col("n") == 1, F.col("target")).alias("target"))


#: Kinds of node that a live edge of each kind may point at; other kinds of edge are refused.
DEFINITIONS = ("function", "method", "fn", "class", "interface", "struct", "trait", "enum", "type", "typedef", "union", "object", "protocol", "mixin", "extension", "namespace", "init")
LIVE_TARGETS = {"ref/call": DEFINITIONS, "ref/field": ("field",), "is-implementation": ("interface", "trait", "class", "struct", "protocol")}


def sound(candidates: DataFrame, nodes: DataFrame, targets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Candidate edges (src, dst, kind) that may be written: between two different known nodes of one corpus, to a kind of node that the kind of edge allows."""
    allowed = F.lit(False)
    for kind, own in (LIVE_TARGETS if targets is None else targets).items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("_kind").isin(*own))
    s, t = nodes.select(F.col("id").alias("src"), F.col("corpus").alias("_a")), nodes.select(F.col("id").alias("dst"), F.col("corpus").alias("_b"), F.col("kind").alias("_kind"))
    return candidates.where("src <> dst").join(s, "src").join(t, "dst").where(F.col("_a") == F.col("_b")).where(allowed).select(*candidates.columns)


def unify(foreign: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ladder of symbol unification: (sym_id, node_id, rung). Same file and leaf; else the only node of that leaf in the language; else missed."""
    from skein.functions.identifiers import leaf_of

    n = nodes.where("kind NOT IN ('file', 'doc-chunk', 'package')").select(F.col("id").alias("node_id"), F.col("path").alias("n_path"), F.col("language").alias("n_language"), leaf_of(F.col("signature")).alias("leaf"))
    f = foreign.withColumn("leaf", leaf_of(F.col("symbol")))
    first = f.join(n, (f["leaf"] == n["leaf"]) & (f["path"] == n["n_path"])).groupBy("sym_id").agg(F.min("node_id").alias("one"))
    rest = f.join(first, "sym_id", "left_anti")
    second = rest.join(n, (rest["leaf"] == n["leaf"]) & (rest["language"] == n["n_language"])).groupBy("sym_id").agg(F.countDistinct("node_id").alias("n"), F.min("node_id").alias("two")).where("n = 1")
    j = f.join(first, "sym_id", "left").join(second.select("sym_id", "two"), "sym_id", "left")
    rung = F.when(F.col("one").isNotNull(), "same-file").when(F.col("two").isNotNull(), "unique").otherwise("missed")
    return j.select("sym_id", F.coalesce("one", "two").alias("node_id"), rung.alias("rung"))


#: Lines by which a definition may miss the span of its node.
NEAR = 5


def _family(language: F.Column) -> F.Column:
    """Languages that share headers are one family."""
    return F.when(language.isin("c", "cpp", "objectivec"), "c").otherwise(language)


def _sort(kind: F.Column) -> F.Column:
    return F.when(kind.isin("function", "method", "constructor"), "function").when(kind.isin("class", "interface", "struct", "enum", "trait", "type"), "class").otherwise("variable")


def _block(name: F.Column) -> F.Column:
    """A block of a test language that an indexer takes for a scope: <it works>, but not <init>, <Class:X>, <Module:X> or an operator like <=>."""
    return F.coalesce(name.rlike("^<[A-Za-z].*>$") & ~name.rlike("^<(init>$|(Class|Module):)"), F.lit(False))


def unify_rungs(foreign: DataFrame, nodes: DataFrame, near: int = NEAR) -> DataFrame:
    """A compiler's definitions met with the graph's nodes: (sym_id, symbol, language, path, line, kind, node_id, rung, candidates).

    foreign: sym_id, symbol, container, name, kind (function, class, variable), language, path, line; a symbol may occur in many files. The first rung that holds counts:

    span      a node of that name in the file, around the line (the narrowest) or within `near` lines of it (the nearest); ties: least id
    twin      another occurrence of the symbol met a node by span: that of its first occurrence
    overload  a member function whose file has one group of overloads of that name: its first node; then twins of such
    family    a function or class whose name is one group in one file of the language's family: its first node

    dropped: blocks of test languages (_block), and definitions in one that have no node by span without it. unindexed: no node in that file; unplaced: no line;
    neither meets anything. ambiguous: groups in several files (candidates says how many); missed: none. Overloads in one file count as one candidate.
    A row without a name, path or kind meets nothing. Whatever the order of rows, the answer is the same: rungs are joins on (family, sort, name) and (path, sort, name).
    """
    from skein.sources.storage import written

    n = nodes.where("kind NOT IN ('file', 'doc-chunk', 'package')").select(
        F.col("id").alias("node_id"), "path", _family(F.col("language")).alias("_family"), _sort(F.col("kind")).alias("_sort"), F.regexp_replace("signature", "^[^:]*:", "").alias("_name"), F.col("line").alias("_from"), F.col("end_line").alias("_to")
    )
    n = written(n)  # both sides are read four times
    inside = _block(F.col("container")) & ~_block(F.col("name"))
    container = F.when(~inside, F.col("container"))
    f = foreign.select("sym_id", "symbol", "language", "path", "line", "kind", "name", _family(F.col("language")).alias("_family"), _sort(F.col("kind")).alias("_sort"), inside.alias("_inside"), container.isNotNull().alias("_member"), F.concat_ws(".", container, "name").alias("_name"))
    indexed = nodes.select("path").distinct().withColumn("_indexed", F.lit(True))
    f = f.join(indexed, "path", "left")
    open_ = F.col("_indexed") & F.col("line").isNotNull() & F.col("name").isNotNull() & F.col("kind").isNotNull() & ~_block(F.col("name"))
    f = written(f.withColumn("_open", F.coalesce(open_, F.lit(False))))
    live = f.where("_open")

    within = (F.col("line") >= F.col("_from")) & (F.col("line") <= F.col("_to"))
    off = F.abs(F.col("line") - F.col("_from"))
    how = F.when(within, F.struct(F.lit(0).alias("by"), (F.col("_to") - F.col("_from")).alias("far"), "node_id")).when(off <= near, F.struct(F.lit(1).alias("by"), off.alias("far"), "node_id"))
    one = live.select("sym_id", "path", "_sort", "_name", "line").join(n.drop("_family"), ["path", "_sort", "_name"]).groupBy("sym_id").agg(F.min(how)["node_id"].alias("_one"))

    group = n.groupBy("_family", "_sort", "_name", "path").agg(F.min(F.struct(F.coalesce("_from", F.lit(2**31 - 1)).alias("at"), "node_id"))["node_id"].alias("_group"))
    across = group.groupBy("_family", "_sort", "_name").agg(F.count(F.lit(1)).alias("candidates"), F.min("_group").alias("_only"))
    tried = live.where("NOT _inside").join(one, "sym_id", "left").join(group, ["_family", "_sort", "_name", "path"], "left")
    three = F.when(F.col("_member") & (F.col("_sort") == "function"), F.col("_group"))
    tried = tried.select("sym_id", "symbol", "_family", "_sort", "_name", "_one", three.alias("_three")).join(across, ["_family", "_sort", "_name"], "left")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("sym_id", c)))[c]
    spans = live.join(one, "sym_id").groupBy("symbol").agg(first("_one").alias("_two"))
    groups = tried.groupBy("symbol").agg(first("_three").alias("_late"))
    four = F.when((F.col("_sort") != "variable") & (F.col("candidates") == 1), F.col("_only"))
    late = tried.join(spans, "symbol", "left").join(groups, "symbol", "left").select("sym_id", "_two", "_three", "_late", four.alias("_four"), F.when(F.col("_sort") != "variable", F.col("candidates")).alias("candidates"))

    j = f.join(one, "sym_id", "left").join(late, "sym_id", "left")
    rung = F.when(_block(F.col("name")), "dropped").when(F.col("_indexed").isNull(), "unindexed").when(F.col("line").isNull(), "unplaced")
    rung = rung.when(F.col("_one").isNotNull(), "span").when(F.col("_inside"), "dropped").when(F.col("_two").isNotNull(), "twin").when(F.col("_three").isNotNull(), "overload").when(F.col("_late").isNotNull(), "twin")
    rung = rung.when(F.col("_four").isNotNull(), "family").when(F.col("candidates") > 1, "ambiguous").otherwise("missed")
    return j.select("sym_id", "symbol", "language", "path", "line", "kind", F.coalesce("_one", "_two", "_three", "_late", "_four").alias("node_id"), rung.alias("rung"), F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"))


def unify_misses(outcome: DataFrame) -> DataFrame:
    """(language, symbol, path, line, kind, candidates): functions and classes that unify_rungs tried and met nowhere, one row a symbol: its first occurrence."""
    tried = outcome.where("kind IN ('function', 'class') AND rung NOT IN ('dropped', 'unindexed', 'unplaced')")
    s = tried.groupBy("symbol").agg(F.count("node_id").alias("_met"), F.min(F.struct("sym_id", "language", "path", "line", "kind", "candidates")).alias("m"))
    return s.where("_met = 0").select("m.language", "symbol", "m.path", "m.line", "m.kind", "m.candidates")


def _listed(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """A row for each LISTED values of a key, with these as a list."""
    numbered = df.select(*key, value).withColumn("_l", F.floor((F.row_number().over(W.partitionBy(*key).orderBy(value)) - 1) / LISTED))
    return numbered.groupBy(*key, "_l").agg(F.sort_array(F.collect_list(value)).alias(value)).drop("_l")


def edit_overlap(hunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hunk_id, id): the innermost spans that a hunk of lines touches: those that hold no other touched span. Ids of nodes are unique.

    Hunks of the same lines touch the same spans and nodes of the same lines are one span, so both meet once for all their copies; copies are told apart at the end.
    """
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {BIN}"), F.expr(f"{b} div {BIN}"))).alias("bin")
    own = hunks.where("path IS NOT NULL AND hunk_start IS NOT NULL AND hunk_end IS NOT NULL").groupBy("hunk_id").agg(F.sort_array(F.collect_set(F.struct("path", "hunk_start", "hunk_end"))).alias("place"))
    own = written(own.where("hunk_id IS NOT NULL"))
    h = own.select("place").distinct().select("place", F.inline("place")).select("place", "path", "hunk_start", "hunk_end", bins("hunk_start", "hunk_end"))
    placed = nodes.where("id IS NOT NULL AND line IS NOT NULL AND end_line >= line").select("id", "path", "line", "end_line").distinct()
    n = placed.select("path", "line", "end_line").distinct().select("*", bins("line", "end_line"))
    hit = h.join(n, ["path", "bin"]).where("line <= hunk_end AND end_line >= hunk_start").select("place", "path", "line", "end_line").distinct()
    # Of spans by falling first lines, one is outer if an earlier one ends no later, or one of its own first line ends before.
    ends = hit.groupBy("place", "line").agg(F.min("end_line").alias("end_line"))
    later = F.min("end_line").over(W.partitionBy("place").orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, -1))
    inner = ends.withColumn("_later", later).where("_later IS NULL OR _later > end_line").drop("_later")
    spans = hit.join(inner, ["place", "line", "end_line"])
    # Both sides move as lists, whose pairs are made where they meet: a span that many places touch would else send a row for each of its nodes to each of them.
    ids, hunks_ = _listed(placed, ["path", "line", "end_line"], "id"), _listed(own, ["place"], "hunk_id")
    met = hunks_.join(spans.join(ids, ["path", "line", "end_line"]).select("place", "id"), "place")
    return met.select(F.explode("hunk_id").alias("hunk_id"), "id").select("hunk_id", F.explode("id").alias("id"))
