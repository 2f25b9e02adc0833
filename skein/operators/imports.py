"""Import resolution: which files an import names, for all languages in one plan.

Each language's rules turn an import into keys, each of a kind; files have keys of the same kinds; the two meet by an equality. 'file': a path ends, in
whole segments, with the key; 'folder': a file's folder does; 'in': the file's folder is the key; 'path': the file is the key. An import
(import_id, language, spec, path of the importer) may name many files, and a file by several rules: a row for each. Where a language tries one
candidate after another, rules have steps, and the first step with a file wins.

Relative specs are walked from the importer's folder; those that climb above the root name nothing. Null specs, languages without rules and files without a path give no
rows. A file's keys are as many as its path has segments, so no pairs of imports and files are tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Endings of class files by language, candidates of a module's path in order, and the last segments that name a package's own file.
CLASS_FILES = {"java": [".java"], "kotlin": [".kt", ".kts"], "scala": [".scala", ".sc"], "csharp": [".cs"]}
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
#: Other names of languages.
NAMES = {"c#": "csharp", "cs": "csharp", "c++": "cpp", "c": "cpp", "objc": "cpp", "objectivec": "cpp", "javascript": "typescript"}


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def walked(start: Column, spec: Column) -> Column:
    """The path that a relative spec leads to from a folder; null if it climbs above the root."""
    parts = F.filter(F.concat(F.split(start, "/"), F.split(spec, "/")), lambda x: ~x.isin("", "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def _key(kind: str, rule: str, key: Column, step: int = 0) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.lit(step).alias("step"), key.alias("key"))


def _rules(language: Column, spec: Column, path: Column) -> Column:
    """An array of (kind, rule, step, key) by language."""
    here, dotted = folder(path), F.translate(F.regexp_replace(spec, r"(\.\*)+$", ""), ".", "/")
    out = F.when(F.lit(False), F.array(_key("", "", spec)))
    for name, endings in CLASS_FILES.items():
        out = out.when(language == name, F.array(*[_key("file", "class", F.concat(dotted, F.lit(e))) for e in endings], _key("folder", "package", dotted)))
    module = F.translate(spec, ".", "/")
    absolute = F.array(_key("file", "module", F.concat(module, F.lit(".py"))), _key("file", "package", F.concat(module, F.lit("/__init__.py"))), _key("folder", "folder", module))
    # Leading dots: one is the importer's folder, each further one its parent.
    ups = F.length(F.regexp_extract(spec, r"^\.*", 0))
    rest = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    near = walked(here, F.concat(F.repeat(F.lit("../"), ups - 1), rest))
    relative = F.array(_key("path", "relative module", F.concat(near, F.lit(".py"))), _key("path", "relative package", F.concat(near, F.lit("/__init__.py"))))
    out = out.when((language == "python") & spec.startswith("."), relative).when(language == "python", absolute)
    php = F.translate(spec, "\\", "/")
    out = out.when(language == "php", F.array(_key("file", "class", F.concat(php, F.lit(".php"))), _key("folder", "namespace", php)))
    # A folder that ends the import's path, or, for a path with a domain, one that ends with all of it.
    held = F.transform(suffixes(spec), lambda s: F.struct(F.lit("in").alias("kind"), F.lit("module folder").alias("rule"), F.lit(0).alias("step"), s.alias("key")))
    whole = F.when(F.substring_index(spec, "/", 1).contains("."), F.array(_key("folder", "vendored module", spec))).otherwise(F.filter(F.array(_key("folder", "", spec)), lambda x: F.lit(False)))
    out = out.when(language == "go", F.concat(held, whole))
    quoted = F.regexp_replace(spec, '^"+|"+$', "")
    out = out.when((language == "cpp") & ~spec.startswith("<"), F.array(_key("path", "include", walked(here, quoted))))
    out = out.when(language == "swift", F.array(_key("module", "module", spec)))
    dart = F.when(spec.startswith("package:"), F.when(spec.contains("/"), F.regexp_replace(spec, "^[^/]*/", ""))).when(~spec.rlike(r"^(dart:|\./|\.\./)"), spec)
    out = out.when(language == "dart", F.array(_key("file", "library", dart)))
    out = out.when((language == "ruby") & ~spec.startswith("gem:"), F.array(_key("path", "relative", F.concat(walked(here, F.regexp_replace(spec, r"\.rb$", "")), F.lit(".rb")))))
    bare = walked(here, spec)
    out = out.when((language == "typescript") & spec.rlike(r"^\.\.?(/|$)"), F.array(*[_key("path", "relative", F.concat(bare, F.lit(e)), i) for i, e in enumerate(SCRIPT_ENDINGS)]))
    # crate:: from the folder above src and below it; self:: and super:: from the module, which a file that isn't mod, lib or main is by its own name.
    root = F.when(path.rlike("(^|/)src/"), F.regexp_extract(path, "^((?:.*/)?src)/", 1))
    own = F.when(path.rlike("(^|/)(mod|lib|main)[.]rs$"), here).otherwise(F.regexp_replace(path, "[.]rs$", ""))
    tail = F.regexp_replace(F.regexp_replace(spec, "^((crate|self|super)::)+", ""), "::", "/")
    supers = F.size(F.regexp_extract_all(F.regexp_extract(spec, "^((?:super::)*)", 1), F.lit("super"), F.lit(0)))
    rust = F.when(spec.startswith("crate::"), F.concat(root, F.lit("/"), tail)).when(spec.startswith("self::"), F.concat(own, F.lit("/"), tail)).when(supers > 0, walked(own, F.concat(F.repeat(F.lit("../"), supers), tail)))
    up = F.regexp_replace(rust, "/[^/]*$", "")  # an item of a module names the module's file
    return out.when(language == "rust", F.array(*[_key("path", "module", F.concat(p, F.lit(e)), i) for i, (p, e) in enumerate((p, e) for p in (rust, up) for e in (".rs", "/mod.rs"))]))


def file_keys(files: DataFrame) -> DataFrame:
    """file_id, target, kind, key of files (file_id, path)."""
    p = F.col("path")
    d = folder(p)
    of = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    none = F.array().cast("array<string>")
    keys = F.concat(of("file", suffixes(p)), of("path", F.array(p)), of("in", F.when(d != "", F.array(d)).otherwise(none)), of("folder", F.when(d != "", suffixes(d)).otherwise(none)), of("module", F.when(p.endswith(".swift"), F.array(F.substring_index(d, "/", -1))).otherwise(none)))
    return files.where("path IS NOT NULL").select("file_id", p.alias("target"), F.explode(keys).alias("k")).select("file_id", "target", "k.kind", "k.key")


def without_aliases(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """Imports whose spec begins with an alias (prefix, folder) with what it stands for: the longest prefix of whole segments wins, and the spec becomes a path from the root."""
    parts = F.split("spec", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    met = imports.where("spec IS NOT NULL").select("import_id", "spec", F.explode(prefixes).alias("prefix")).join(aliases.select("prefix", "folder"), "prefix")
    best = met.groupBy("import_id", "spec").agg(F.max_by("folder", F.struct(F.length("prefix"), "folder")).alias("_to"), F.max(F.length("prefix")).alias("_n"))
    ups = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    there = F.concat(F.lit("./"), ups, F.regexp_replace("_to", "/$", ""), F.expr("substring(spec, _n + 1)"))
    return imports.join(best, ["import_id", "spec"], "left").withColumn("spec", F.when(F.col("_to").isNotNull(), there).otherwise(F.col("spec"))).drop("_to", "_n")


def resolve(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """import_id, path (of the importer), file_id, target, rule: the files (file_id, path) that imports (import_id, language, spec, path) name. A leading `import:` of a spec is left out."""
    i = imports.select("import_id", "language", F.regexp_replace("spec", "^import:", "").alias("spec"), F.translate("path", "\\", "/").alias("path"))
    if aliases is not None:
        i = without_aliases(i, aliases)
    table = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    language = F.coalesce(F.try_element_at(table, F.lower("language")), F.lower("language"))
    keyed = i.where("spec IS NOT NULL AND path IS NOT NULL").withColumn("language", language)
    keyed = keyed.select("import_id", "language", "spec", "path", F.explode(_rules(F.col("language"), F.col("spec"), F.col("path"))).alias("k")).select("import_id", "language", "spec", "path", "k.*").where("key IS NOT NULL AND key <> ''")
    found = keyed.join(file_keys(files.select("file_id", F.translate("path", "\\", "/").alias("path"))), ["kind", "key"])
    first = F.min("step").over(W.partitionBy("import_id", "language", "spec", "path"))
    return found.withColumn("_first", first).where("step = _first").select("import_id", "path", "file_id", "target", "rule").distinct()
