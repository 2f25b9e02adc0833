"""Fill-in-the-middle arrangements of texts, and the texts back from them, in Spark SQL's own functions: a map over rows, without a shuffle.

A text's units are its runs of A-Z and a-z and its other code points, one each. Two cuts, drawn by a hash of the document's id, part them
into prefix, middle and suffix, which the form arranges around sentinels: psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle,
plain the text as it is. A text that holds a sentinel stays plain, so an arrangement has each sentinel once and reads back without doubt.

Null text is empty, and an empty text is plain with no units. A null id hashes as an empty string and stays null. Rows are taken one
by one, so repeated ones give repeated results; a very long text is the array of its units in one row. Other columns are left out, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A sentinel, and a unit: together the units are the whole text.
SENTINEL, UNIT = "<[PSM]>", "[A-Za-z]+|[^A-Za-z]"


def draws(seed: int, id_col: str) -> Column:
    """sha256 of `seed:id` in hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)


def draw(digest: Column, k: int) -> Column:
    """The k-th (from 1) group of eight digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _joined(units: str, first: Column, size: Column) -> Column:
    return F.array_join(F.slice(units, first, size), "")


def fill_in_middle(docs: DataFrame, seed: int = 1, arranged: int = 90, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n long (units), form, prefix_chars, middle_chars long (null if plain), output.

    arranged: the hundredths of documents that are not left plain by the draw; spm: the hundredths of those that are spm.
    """
    # A column that later steps use more than once is a projection of its own, which Catalyst doesn't merge, so that units are found once.
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), draws(seed, id_col).alias("h"))
    d = d.withColumn("units", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    d = d.withColumn("n", F.size("units").cast("long"))
    d = d.withColumns({"a": draw(F.col("h"), 1) % (F.col("n") + 1), "b": draw(F.col("h"), 2) % (F.col("n") + 1)})
    d = d.withColumns({"a": F.least("a", "b").cast("int"), "b": F.greatest("a", "b").cast("int")})
    plain = (F.col("text") == "") | F.col("text").rlike(SENTINEL) | (draw(F.col("h"), 3) % 100 >= arranged)
    d = d.withColumn("form", F.when(plain, "plain").when(draw(F.col("h"), 4) % 100 < spm, "spm").otherwise("psm"))
    one = F.lit(1)
    parts = F.struct(
        _joined("units", one, F.col("a")).alias("prefix"),
        _joined("units", F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"),
        _joined("units", F.col("b") + 1, F.col("n").cast("int") - F.col("b")).alias("suffix"),
    )
    d = d.withColumn("p", F.when(F.col("form") != "plain", parts)).select("doc_id", "text", "n", "form", "p")
    psm = F.concat(F.lit(PREFIX), "p.prefix", F.lit(SUFFIX), "p.suffix", F.lit(MIDDLE), "p.middle")
    spm_ = F.concat(F.lit(SUFFIX), "p.suffix", F.lit(PREFIX), "p.prefix", F.lit(MIDDLE), "p.middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return d.select("doc_id", "text", "n", "form", F.length("p.prefix").cast("long").alias("prefix_chars"), F.length("p.middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an arrangement was made of; null if its sentinels are not those of its form."""
    parts = F.split(output, SENTINEL)
    order = F.regexp_replace(F.array_join(F.regexp_extract_all(output, F.lit(SENTINEL), F.lit(0)), ""), "[<>]", "")
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when((form == "psm") & (order == "PSM"), psm).when((form == "spm") & (order == "SPM"), spm)


def restore(arranged: DataFrame) -> DataFrame:
    """The rows of fill_in_middle with their text rebuilt, as `restored`, from output and form alone."""
    return arranged.withColumn("restored", restored(F.col("output"), F.col("form")))
