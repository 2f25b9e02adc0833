"""The seed cascade: from a table of queries to ranked seeds, each with the lanes that found it, in one plan without a loop over queries.

Lanes, in order: a token is looked up as it is written; what is left open by its stem, then by its stem with an e, then as the one symbol that it
misspells. What is found anchors the query ('specific' or 'generic', by how rare the token is); words of signatures ('lexical') and vectors ('vector') are
lanes of their own. Weighted rank fusion joins the lanes; gates that need the fused seeds follow.

A query names the lanes that it may use as a bitmap, so that ranks without a lane are ranks of the same query with another bitmap: explain()
asks for all of them at once, and lanes are computed once for all.

queries: q, query, and lanes int (all if there is no such column). nodes: as in schemas. vectors: q, id, cosine, or None. Null and repeated queries: a null
text has no tokens and no seeds; q is to be unique. Work grows with the nodes that carry a query's tokens; tokens of all queries are looked up together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import identifiers as I
from skein.operators import filters, ranking
from skein.sources.storage import counted, written

#: Bits of lanes.
ANCHORS, LEXICAL, VECTORS = 1, 2, 4
ALL = ANCHORS | LEXICAL | VECTORS
LANES = {"anchors": ANCHORS, "lexical": LEXICAL, "vectors": VECTORS}
#: Weights of lanes in the fusion, and of a kept seed that only the fusion knows.
LANE_WEIGHTS = {"specific": 2.0, "lexical": 1.0, "vector": 1.0, "generic": 0.4}
#: Least idf of an anchor and of a specific one, anchors of a token, of a path, names looked at, names as rare as this many, share of a query's idf.
EMIT, SPECIFIC, PER_TOKEN, PER_PATH, LOOKED_AT, RARE, SUBJECT = 0.15, 0.55, 3, 2, 6, 3, 0.55
#: Lexical score that crosses packages, floor of it, least number of nodes, similarity of a misspelling, priority of exact seeds.
STRONG, LEAST, NODES, MISSPELT, PRIORITY = 0.3, 0.05, 1000, 0.7, 1.5
#: Vectors are trusted from, kept within, never below, and this many seeds stay; a seed far from all anchors stays from.
TRUSTED, BAND, FLOOR, KEEP, RESCUE = 0.58, 0.13, 0.55, 5, 0.85
#: Our own: how much a kind counts, and how many words' hits the lexical lane keeps.
BOOSTS, HITS = {"method": 1.2, "function": 1.2, "class": 1.1}, 50
#: Words at most that are looked for in a name by a pattern before it is taken apart, and characters of a word that the pattern has.
FEW, START = 1000, 32


def boost(kind: Column, boosts: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), kind), F.lit(1.0)) if boosts else F.lit(1.0)


def query_tokens(query: Column) -> Column:
    """A query's words in order, without punctuation around them but _ and ., and without stop words and single letters."""
    strip = r"""^[!"#$%&'()*+,\-/:;<=>?@\[\\\]^`{|}~]+|[!"#$%&'()*+,\-/:;<=>?@\[\\\]^`{|}~]+$"""
    bare = F.transform(F.split(F.coalesce(query, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, strip, ""))
    return F.filter(bare, lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(I.QUERY_STOP_WORDS))


def plain(token: Column) -> Column:
    """A token as runs of segments spell it."""
    return F.lower(F.regexp_replace(token, "[^A-Za-z0-9]", ""))


def runs(s: Column, longest: Column) -> Column:
    """Runs of segments, joined, up to a length: what contains_token finds. s is a column of its own, since an expression would be taken anew for each run."""
    own = F.flatten(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.transform(F.sequence(i, F.size(s)), lambda j: F.array_join(F.slice(s, i, j - i + 1), ""))))
    return F.when(F.size(s) > 0, F.array_distinct(F.filter(own, lambda r: F.length(r) <= longest))).otherwise(F.array().cast("array<string>"))


def names(c: Column, longest: Column) -> Column:
    """What contains_token finds in c."""
    return runs(I.raw_segments(c), longest)


def taken_apart(nodes: DataFrame) -> DataFrame:
    """The nodes with raw_segments of their signatures, and their bodies and leaves as runs spell them, as a table: names are taken apart once for all lanes, by one pattern."""
    c = F.col("signature")
    body = F.substr(c, F.instr(c, ":") + 1)
    segments = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+|[A-Z]+[a-z]*|[a-z]+"), F.lit(0)), F.lower)
    return written(nodes.select("id", "corpus", "path", "signature", "kind", "line", "end_line", "test_role", segments.alias("segments"), plain(body).alias("body"), plain(F.substring_index(body, ".", -1)).alias("leaf")))


def _holds(words: DataFrame, c: Column) -> Column:
    """Whether c may hold one of the words (one column, distinct): so where they are few and it holds the start of one, and of any c where they are many."""
    few = sorted({r[0][:START] for r in words.limit(FEW + 1).collect()})
    if len(few) > FEW:
        return F.lit(True)

    def of(tails: list[str]) -> str:
        if "" in tails:
            return ""
        by = {}
        for t in tails:
            by.setdefault(t[0], []).append(t[1:])
        return "(?:" + "|".join(re.escape(k) + of(v) for k, v in by.items()) + ")"

    return c.rlike(of(few)) if few else F.lit(False)


def _carriers(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """(form, id, word, rank, at): nodes, taken apart, that carry a form in signature or path, a row for each form.

    word: the form is a token of the index. rank: see _name_rank. at: what orders the node as an anchor; null if it can't be one, as the form is in its path only or it is noise.
    Forms of a node are found in its own row, so that nothing is shuffled; a path is taken apart once for all its nodes, and names only where they may hold a form. Ids of nodes are unique.
    """
    forms = written(forms.distinct())
    known = counted(forms)
    longest = F.broadcast(forms.agg(F.coalesce(F.max(F.length("form")), F.lit(0)).alias("_longest")))  # one row
    none = F.array().cast("array<string>")
    paths = nodes.select("path").distinct().withColumn("_s", I.raw_segments(F.col("path"))).crossJoin(longest)
    there = paths.select("path", F.explode(runs(F.col("_s"), F.col("_longest"))).alias("form")).join(known, "form").groupBy("path").agg(F.collect_set("form").alias("_there"))
    n = nodes.join(counted(written(there)), "path", "left").crossJoin(longest)
    n = n.withColumn("_own", F.when(_holds(forms, F.array_join("segments", "")), runs(F.col("segments"), F.col("_longest"))).otherwise(none))
    told = lambda forms, signed: F.transform(forms, lambda f: F.struct(f.alias("form"), F.lit(signed).alias("signed")))
    both = F.concat(told(F.col("_own"), True), told(F.array_except(F.coalesce("_there", none), F.col("_own")), False))
    # An outer explode: before an inner one, Catalyst makes the runs once more to see whether there are any. The join drops its nulls.
    hits = n.select(*nodes.columns, F.explode_outer(both).alias("_f")).select(*nodes.columns, F.col("_f.form").alias("form"), F.col("_f.signed").alias("signed")).join(known, "form")
    word = F.coalesce(F.array_contains(I.index_tokens(F.col("signature"), raw=F.col("segments")), F.col("form")), F.lit(False))
    noise = filters.is_anchor_noise(F.col("path"), F.col("signature"), F.col("kind"), F.col("test_role"))
    at = F.when(F.col("signed") & ~noise, F.struct("corpus", "path", "kind", "line", "end_line"))
    return hits.select("form", "id", word.alias("word"), _name_rank(F.col("form"), F.col("body"), F.col("leaf")).alias("rank"), at.alias("at"))


def _like(nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(token): names and segments that may be as similar as `least` to one of the words (q): all that are, and some others.

    So similar a token has so many of a word's trigrams that it holds one of any few of them: of those that end the word. Nodes that hold none are left out.
    """
    grams = words.select(I.trigrams(F.col("q")).alias("g")).select(F.explode(F.slice(F.reverse("g"), 1, F.size("g") - F.ceil(least * F.size("g") - 1e-9).cast("int") + 1)).alias("g")).distinct()
    nodes = nodes.where(_holds(grams, F.array_join("segments", "")))
    return nodes.select(F.col("leaf").alias("token")).union(nodes.select(F.explode_outer("segments"))).where("token IS NOT NULL").distinct()


def _terms(queries: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (q, position, token, form, rung, resolved) and the carriers of their forms."""
    from skein.plans.retrieval import corrections

    t = queries.select("q", F.posexplode(query_tokens(F.col("query"))).alias("position", "token"))
    rungs = F.array(F.struct(F.lit(0).alias("rung"), plain(F.col("token")).alias("form")), F.struct(F.lit(1).alias("rung"), I.stem(F.col("token")).alias("form")), F.struct(F.lit(2).alias("rung"), I.stem_with_e(F.col("token")).alias("form")))
    tried = written(t.select("q", "position", "token", F.explode(rungs).alias("r")).select("q", "position", "token", "r.rung", "r.form").where("form IS NOT NULL AND form <> ''"))
    found = written(_carriers(nodes, tried.select("form")))
    hit = found.select("form").distinct()
    direct = written(tried.join(hit, "form").groupBy("q", "position", "token").agg(F.min(F.struct("rung", "form")).alias("b")).select("q", "position", "token", "b.form", "b.rung"))
    open_ = written(t.join(direct.select("q", "position"), ["q", "position"], "left_anti"))
    # Only what no earlier lane took is corrected.
    words = written(open_.where(F.length("token") >= 4).select(F.lower("token").alias("q")).distinct())
    fixes = corrections(words, _like(nodes, words, MISSPELT), MISSPELT).where("token IS NOT NULL").select(F.col("q").alias("_w"), F.col("token").alias("form"))
    fixed = written(open_.join(fixes, F.lower("token") == F.col("_w")).select("q", "position", "token", "form", F.lit(3).alias("rung")))
    if not fixed.isEmpty():
        more = written(_carriers(nodes, fixed.select("form")))
        found = found.unionByName(more.join(hit, "form", "left_anti"))
        direct = direct.unionByName(fixed.join(more.select("form").distinct(), "form", "left_semi"))
    done = direct.withColumn("resolved", F.lit(True))
    rest = t.join(done.select("q", "position"), ["q", "position"], "left_anti").select("q", "position", "token", plain(F.col("token")).alias("form"), F.lit(None).cast("int").alias("rung"), F.lit(False).alias("resolved"))
    return written(done.unionByName(rest)), found


def _name_rank(form: Column, body: Column, leaf: Column) -> Column:
    """0: the form is the name; 1: the name starts with it; 2: it is elsewhere."""
    return F.when((body == form) | (leaf == form), 0).when(F.startswith(body, form) | F.startswith(leaf, form), 1).otherwise(2)


class Cascade:
    """Tables of a run: terms, anchors, lanes (q, id, lane, weight, ...), facts (a row a query) and seeds."""

    def __init__(self, queries: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, allowed: list[str] | None = None, boosts: dict[str, float] = BOOSTS):
        self.queries = written(queries.select("q", "query", (F.col("lanes") if "lanes" in queries.columns else F.lit(ALL)).cast("int").alias("lanes")))
        base = self.queries.select("q", "query").distinct()
        self.nodes = taken_apart(nodes)
        shown = self.nodes if allowed is None else self.nodes.where(F.col("corpus").isin(allowed))
        facts = F.col("kind")
        total = self.nodes.agg(F.greatest(F.lit(NODES), F.count(F.lit(1))).alias("total"))
        terms, hits = _terms(base, self.nodes)
        logic = F.when(F.col("kind").isin("method", "function", "constructor", "impl"), 0).when(F.col("kind").isin("field", "var", "variable", "property", "constant", "static", "import", "file-module"), 2).otherwise(1)
        span = F.when(F.col("end_line") >= F.col("line"), F.col("end_line") - F.col("line")).otherwise(0)
        frequency = hits.where("word").select("form", "id").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n"))
        # A form that the index doesn't hold can't be measured: it counts as everywhere.
        self.measured = written(terms.join(frequency, "form", "left").crossJoin(F.broadcast(total)).withColumn("frequency", F.coalesce("n", "total")).withColumn("idf", I.idf_weight(F.col("frequency"), F.col("total"))).drop("n", "total"))
        at = hits.where("id IS NOT NULL").withColumnRenamed("rank", "_rank")
        # Names are ranked a form at a time: many queries may ask for a form that many nodes carry.
        wanted = self.measured.where("resolved")
        first = wanted.join(at.groupBy("form").agg(F.min(F.struct("_rank", "id"))["id"].alias("top_node")), "form").select("q", "position", "top_node")
        pool = at.where("at IS NOT NULL").withColumn("_h", F.row_number().over(W.partitionBy("form").orderBy("_rank", "id"))).where(F.col("_h") <= LOOKED_AT)
        head = wanted.join(written(pool.select("form", "id", "_rank", "at.*")), "form")
        order = W.partitionBy("q", "position").orderBy(logic, F.desc(span), "_rank", "id")
        if allowed is not None:
            # Corrected tokens look for the first visible name; others lose the slots that hidden names had.
            head = head.withColumn("_ok", F.coalesce(F.col("corpus").isin(allowed), F.lit(False)))
        else:
            head = head.withColumn("_ok", F.lit(True))
        ordered = head.withColumn("_t", F.row_number().over(order))
        fixed = ordered.where("rung = 3 AND _ok").withColumn("_t", F.row_number().over(order)).where("_t = 1")
        plain_ = ordered.where((F.col("rung") < 3) & F.col("_ok") & (F.col("_t") <= PER_TOKEN) & (F.col("idf") >= EMIT))
        plain_ = plain_.withColumn("_t", F.row_number().over(order))
        there = W.partitionBy("q", "path").orderBy("position", "_t")
        slots = plain_.unionByName(fixed).withColumn("_p", F.row_number().over(there)).where((F.col("_t") == 1) | (F.col("_p") <= PER_PATH))
        weight = F.col("idf") * boost(facts, boosts)
        self.anchors = written(slots.select("q", "position", "id", "path", weight.alias("weight"), ((F.col("idf") >= SPECIFIC) | (F.col("rung") == 3)).alias("specific"), (F.col("rung") == 3).alias("corrected")))
        emitted = self.anchors.groupBy("q", "position").agg(F.count(F.lit(1)).alias("anchors"), F.min(F.when(F.col("corrected"), F.col("id"))).alias("_pick"))
        m = self.measured.join(first, ["q", "position"], "left").join(emitted, ["q", "position"], "left")
        self.terms = written(m.select("q", "position", "token", "form", "rung", "resolved", "frequency", "idf", F.when(F.col("rung") == 3, F.col("_pick")).otherwise(F.col("top_node")).alias("top_node"), F.coalesce("anchors", F.lit(0)).alias("anchors")))
        rare = self.terms.join(self.anchors.groupBy("q", F.col("id").alias("top_node")).agg(F.max("corrected").alias("_c")), ["q", "top_node"], "left").withColumn("_r", F.col("resolved") & F.col("_c").isNotNull() & ((F.col("frequency") <= RARE) | F.col("_c")))
        f = rare.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("resolved") & (F.col("idf") >= SPECIFIC), 1).otherwise(0)).alias("n_resolved"), F.sum("idf").alias("_all"), F.sum(F.when(F.col("_r"), F.col("idf")).otherwise(0.0)).alias("_rare"))
        f = base.join(f, "q", "left").withColumn("rare", F.coalesce((F.col("_rare") > 0) & (F.col("_rare") >= SUBJECT * F.col("_all")), F.lit(False)))
        self.facts = written(f.select("q", "query", F.coalesce("n", F.lit(0)).alias("tokens"), F.coalesce("n_resolved", F.lit(0)).alias("n_resolved"), F.when(F.col("n") > 0, F.col("n_resolved") / F.col("n")).otherwise(0.5).alias("coverage"), "rare", I.intent(F.col("query")).alias("intent")))
        self.lanes = written(self._lanes(shown, vectors, boosts))

    def _lanes(self, nodes: DataFrame, vectors: DataFrame | None, boosts) -> DataFrame:
        """q, id, lane, weight, rank; lexical hits twice: scoped by the anchors' packages, and not ('lexical open')."""
        best = self.anchors.groupBy("q", "id").agg(F.max("weight").alias("weight"), F.max("specific").alias("specific"))
        out = best.select("q", "id", F.when(F.col("specific"), "specific").otherwise("generic").alias("lane"), "weight")
        words = self.measured.select("q", "form").where("form <> ''").distinct()
        # The table between keeps the patterns of noise to nodes that were found, where Catalyst would try them on all.
        seeds = lambda found: written(found.join(nodes.select("id", "path", "kind", "signature"), "id")).where(~filters.is_structural_noise(F.col("path"), F.col("signature"), F.col("kind"))).drop("signature")
        scored = ranking.bm25_of(nodes.select("id", I.index_terms(F.col("signature"), F.col("segments")).alias("tokens")), words)
        top = W.partitionBy("q").orderBy(F.desc("score"), "id")
        scored = written(scored.withColumn("_k", F.row_number().over(top)).where(F.col("_k") <= HITS))
        hits = seeds(counted(scored)).withColumn("norm", F.greatest(F.lit(LEAST), F.col("score") / F.max("score").over(W.partitionBy("q"))))
        root = lambda c: F.when(F.size(F.split(c, "/")) >= 3, I.package_root(c))
        roots = self.anchors.select("q", root(F.col("path")).alias("_root")).where("_root IS NOT NULL").distinct().withColumn("_in", F.lit(True))
        scoped = roots.select("q").distinct().withColumn("_scoped", F.lit(True))
        hits = hits.withColumn("_root", root(F.col("path"))).join(roots, ["q", "_root"], "left").join(scoped, "q", "left")
        drops = F.col("_scoped").isNotNull() & F.col("_root").isNotNull() & F.col("_in").isNull() & (F.col("norm") < STRONG)
        own = F.explode(F.when(drops, F.array(F.lit("lexical open"))).otherwise(F.array(F.lit("lexical"), F.lit("lexical open")))).alias("lane")
        each = hits.select("q", "id", "path", "score", own, (F.col("norm") * boost(F.col("kind"), boosts)).alias("weight"))
        capped = each.withColumn("_n", F.row_number().over(W.partitionBy("q", "lane", "path").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= PER_PATH)
        out = out.unionByName(capped.select("q", "id", "lane", "weight"))
        if vectors is not None:
            v = seeds(counted(written(vectors.groupBy("q", "id").agg(F.max("cosine").alias("cosine")))))
            out = out.unionByName(v.select("q", "id", F.lit("vector").alias("lane"), (F.col("cosine") * boost(F.col("kind"), boosts)).alias("weight")))
        self.cosines = None if vectors is None else written(vectors.where("cosine IS NOT NULL").groupBy("q", "id").agg(F.max("cosine").alias("cosine")))
        return out.withColumn("rank", F.row_number().over(W.partitionBy("q", "lane").orderBy(F.desc("weight"), "id")))

    def fused(self) -> DataFrame:
        """q, lanes (asked for), id, score, weight, source, found (bitmap of the lanes that found it)."""
        asked = self.queries.select("q", "lanes")
        bit = F.when(F.col("lane").isin("specific", "generic"), ANCHORS).when(F.col("lane") == "vector", VECTORS).otherwise(LEXICAL)
        # With anchors, lexical hits are scoped; without them they are not.
        wanted = (F.col("lanes").bitwiseAND(bit) != 0) & F.when(F.col("lane") == "lexical", F.col("lanes").bitwiseAND(F.lit(ANCHORS)) != 0).when(F.col("lane") == "lexical open", F.col("lanes").bitwiseAND(F.lit(ANCHORS)) == 0).otherwise(True)
        w = F.coalesce(*[F.when(F.col("lane") == k, F.lit(v)) for k, v in LANE_WEIGHTS.items()], F.lit(LANE_WEIGHTS["lexical"]))
        j = asked.join(self.lanes, "q").where(wanted)
        f = j.groupBy("q", "lanes", "id").agg(F.sum(w / (ranking.RRF_K + F.col("rank"))).alias("score"), F.max("weight").alias("_w"), F.bit_or(bit).alias("found"))
        source = F.when(F.col("found").bitwiseAND(F.lit(ANCHORS)) != 0, "exact").when(F.col("found").bitwiseAND(F.lit(VECTORS)) != 0, "vector").otherwise("lexical")
        return f.select("q", "lanes", "id", "score", F.greatest("_w", 0.5 * F.col("score")).alias("weight"), source.alias("source"), "found")

    def seeds(self, edges: DataFrame | None = None) -> DataFrame:
        """q, lanes, rank, id, score, weight, source, found, after the gates.

        Vectors that are trusted drop seeds that they place far off, but for exact ones, the best few, and all seeds of a query that names something
        rare. With edges, seeds that lie more than two edges from every exact one go unless their cosine is high or unknown. Exact seeds of
        rare enough names weigh more than any other seed.
        """
        key = ["q", "lanes"]
        s = self.fused().join(self.facts.select("q", "rare"), "q")
        exact = F.col("source") == "exact"
        if self.cosines is not None:
            cos = self.cosines.join(self.queries.where(F.col("lanes").bitwiseAND(F.lit(VECTORS)) != 0).select("q", "lanes"), "q")
            s = s.join(cos, [*key, "id"], "left").join(cos.groupBy(*key).agg(F.max("cosine").alias("top")), key, "left")
            order = W.partitionBy(*key).orderBy(F.desc(F.coalesce("cosine", F.lit(0.0))), F.desc("score"), "id")
            near = F.coalesce("cosine", F.lit(0.0)) >= F.greatest(F.col("top") - BAND, F.lit(FLOOR))
            s = s.withColumn("_k", F.row_number().over(order))
            s = s.where(F.col("rare") | F.coalesce(F.col("top") < TRUSTED, F.lit(True)) | exact | near | (F.col("_k") <= KEEP)).drop("_k")
        else:
            s = s.withColumns({"cosine": F.lit(None).cast("double"), "top": F.lit(None).cast("double")})
        s = written(s)
        if edges is not None:
            # A seed is near if it, or what is beside it, is or lies beside an exact one: the edges are read once, and no second hop is made from hubs.
            named, others = s.where(exact).select(*key, "id").distinct(), s.where(~exact).select(*key, "id").distinct()
            ids = counted(s.select("id").distinct())
            # Two semi-joins, since Catalyst takes these below what tells repeated edges apart.
            out = edges.select(F.col("src").alias("id"), F.col("dst").alias("beside")).join(ids, "id", "left_semi")
            into = edges.select(F.col("dst").alias("id"), F.col("src").alias("beside")).join(ids, "id", "left_semi")
            beside = written(out.union(into).distinct())
            around = written(named.withColumnRenamed("id", "at").union(named.join(beside, "id").select(*key, F.col("beside").alias("at"))).distinct())
            steps = others.join(beside, "id").select(*key, "id", F.col("beside").alias("at"))
            near = steps.join(around, [*key, "at"], "left_semi").select(*key, "id").distinct()
            s = s.join(near.withColumn("_near", F.lit(True)), [*key, "id"], "left").join(named.select(*key).distinct().withColumn("_named", F.lit(True)), key, "left")
            s = s.where(exact | F.col("_named").isNull() | F.col("_near").isNotNull() | F.col("cosine").isNull() | (F.col("cosine") >= RESCUE)).drop("_near", "_named")
        trusted = F.coalesce(F.col("top") >= TRUSTED, F.lit(False))
        s = s.withColumn("weight", F.when(~exact & trusted & F.col("cosine").isNotNull(), F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine")))).otherwise(F.col("weight")))
        special = self.terms.where(F.col("resolved") & (F.col("idf") >= SPECIFIC) & F.col("top_node").isNotNull()).select("q", F.col("top_node").alias("id")).distinct().withColumn("_special", F.lit(True))
        s = s.join(special, ["q", "id"], "left").withColumn("_other", F.max(F.when(~exact, F.col("weight"))).over(W.partitionBy(*key)))
        agrees = ~trusted | (F.coalesce("cosine", F.lit(0.0)) >= F.greatest(F.col("top") - BAND, F.lit(FLOOR)))
        lifted = exact & (F.col("rare") | F.col("_special").isNotNull()) & agrees
        s = s.withColumn("weight", F.when(lifted, F.greatest("weight", PRIORITY * F.coalesce("_other", F.lit(0.0)))).otherwise(F.col("weight")))
        return s.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id"))).select("q", "lanes", "rank", "id", "score", "weight", "source", "found")


def explain(queries: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, vectors: DataFrame | None = None, allowed: list[str] | None = None, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """q, id, found, rank, and without_<lane>, the rank where the query may not use a lane (null: no seed then), of each seed with or without a lane.

    One pass: each query is asked with four bitmaps of lanes at once.
    """
    masks = [ALL, *(ALL & ~b for b in LANES.values())]
    asked = queries.select("q", "query").withColumn("lanes", F.explode(F.array(*map(F.lit, masks))))
    s = Cascade(asked, nodes, vectors, allowed, boosts).seeds(edges)
    rank = lambda m: F.max(F.when(F.col("lanes") == m, F.col("rank")))
    return s.groupBy("q", "id").agg(F.bit_or("found").alias("found"), rank(ALL).alias("rank"), *[rank(m).alias(f"without_{n}") for n, m in zip(LANES, masks[1:])])
