"""Column functions over identifiers, signatures and paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query or an index ignores.
QUERY_STOP_WORDS = (
    "a an the of in to is for and or with that this how what where when which does are by my from at it its be as on so all me i you we they he she "
    "was were had has have been do did would could should"
).split()
#: Aliases added beside a term.
SYNONYMS = {
    "auth": ["rbac", "session", "login", "token"],
    "config": ["settings", "options", "cfg"],
    "database": ["sqlite", "store", "storage"],
    "delete": ["remove", "retract", "drop"],
    "error": ["err", "failure", "panic"],
    "remove": ["delete", "retract"],
    "store": ["database", "sqlite", "storage"],
    "traversal": ["bfs", "ppr", "pagerank", "walk"],
}


def raw_segments(c: Column) -> Column:
    """Words of an identifier in order: runs of ASCII letters or digits, cut at lower-to-upper and letter-digit changes, lower case."""
    cut = F.regexp_replace(c, "[^A-Za-z0-9]+", " ")
    cut = F.regexp_replace(cut, "([a-z0-9])([A-Z])", "$1 $2")
    cut = F.regexp_replace(cut, "([A-Za-z])([0-9])", "$1 $2")
    cut = F.regexp_replace(cut, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), " "), lambda x: x != "")


def segments(c: Column) -> Column:
    return F.array_distinct(raw_segments(c))


def _and_whole(own: Column, c: Column) -> Column:
    """Segments of three bytes or more, and the whole input in lower case where it is one word of three or more and none of the segments."""
    whole = F.lower(c)
    more = F.when(~c.rlike("\\s") & (F.octet_length(c) >= 3) & ~F.array_contains(own, whole), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(own, lambda x: F.octet_length(x) >= 3), more)


def index_tokens(c: Column, cap: int = 64, raw: Column | None = None) -> Column:
    """Segments of three bytes or more and the whole input in lower case where it is one word of three or more, in order, at most cap. raw: raw_segments of c, where a column has them."""
    return F.slice(_and_whole(segments(c) if raw is None else F.array_distinct(raw), c), 1, cap)


def index_terms(c: Column, raw: Column | None = None) -> Column:
    """index_tokens with each segment as often as it occurs and without a cap: what a document's length and a term's count are taken of."""
    return _and_whole(raw_segments(c) if raw is None else raw, c)


def leaf_of(c: Column) -> Column:
    """What follows the last dot of what follows the first colon."""
    body = F.regexp_replace(c, "^[^:]*:", "")
    return F.element_at(F.split(body, "\\."), -1)


def contains_token(token: str, c: Column) -> Column:
    """Whether the token is a segment of c or a run of segments joined: the joined segments contain it from one segment's start to another's end."""
    plain = "".join(x for x in token if x.isascii() and x.isalnum()).lower()
    if not plain:
        return F.lit(False)
    pattern = " ?".join(plain)
    return F.concat(F.lit(" "), F.array_join(raw_segments(c), " "), F.lit(" ")).rlike(f" {pattern} ")


def token_cost(signature: Column, kind: Column, path: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor((F.octet_length(signature) + F.octet_length(kind) + F.octet_length(path)) / 4))


def idf_weight(frequency: Column, total: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.log((total + 1) / (frequency + 1)) / F.log(total + 1)))


def intent(c: Column) -> Column:
    low = F.lower(c)
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(has("calls ", "callers", "called by"), "callers")
        .when(has("import", "depends", "dependency", "dependencies"), "deps")
        .when(low.rlike("^\\s*how(\\s|$)") | has("explain", "describe"), "explain")
        .when(has("between", "relation"), "relation")
        .otherwise("lookup")
    )


def stem(c: Column) -> Column:
    """The stem of an inflected word of ASCII letters; null where there is none of four letters or more."""
    low = F.lower(c)
    cut = (
        F.when(low.rlike("(ies|ied)$"), F.regexp_replace(low, "(ies|ied)$", "y"))
        .when(low.rlike("ing$"), F.regexp_replace(low, "ing$", ""))
        .when(low.rlike("ed$"), F.regexp_replace(low, "ed$", ""))
        .when(low.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(low, "es$", ""))
        .when(low.rlike("s$") & ~low.rlike("ss$"), F.regexp_replace(low, "s$", ""))
    )
    return F.when(c.rlike("^[A-Za-z]{5,}$") & (F.length(cut) >= 4), cut)


def stem_with_e(c: Column) -> Column:
    """The stem and an e, where the stem is the word without a whole es, ed or ing (cached: cache); null elsewhere."""
    low, own = F.lower(c), stem(c)
    whole = (low == F.concat(own, F.lit("es"))) | (low == F.concat(own, F.lit("ed"))) | (low == F.concat(own, F.lit("ing")))
    return F.when(whole, F.concat(own, F.lit("e")))


def canonical_corpus(url: Column) -> Column:
    """host/org/repo of a remote's address, in small letters; local/name where it has no path."""
    s = F.trim(url)
    tidy = lambda p: F.regexp_replace(F.regexp_replace(F.lower(p), "/+$", ""), r"(\.git)+$", "")
    scp = F.regexp_extract(s, "^git@([^:]*):", 1)
    rest = F.regexp_replace(F.regexp_replace(s, "^(?s:.*?)://", ""), "^[^@]*@", "")
    host = F.lower(F.regexp_extract(rest, "^([^/:]*)[^/]*/", 1))
    return (
        F.when(s.rlike("^git@[^:]*:"), F.concat(F.lower(scp), F.lit("/"), tidy(F.regexp_replace(s, "^git@[^:]*:", ""))))
        .when(rest.contains("/"), F.concat(host, F.lit("/"), tidy(F.regexp_replace(rest, "^[^/]*/", ""))))
        .otherwise(local_corpus(s))
    )


def local_corpus(name: Column) -> Column:
    """local/name, with a dash for what is neither letter, digit, dash nor underscore."""
    return F.concat(F.lit("local/"), F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-")))


def package_key(path: Column) -> Column:
    """A path's first folder; files at the top are (root); odd paths have none."""
    odd = path.startswith("..") | path.startswith("/") | path.contains("://")
    return F.when(odd, F.lit(None)).when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def package_root(path: Column) -> Column:
    return F.substring_index(path, "/", 2)


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, 3)))).otherwise(F.array().cast("array<string>"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
