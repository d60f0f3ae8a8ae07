"""Line deduplication with a log-template tree, in DataFrame functions only.

Every line is cut into tokens at runs of white space; tokens with a digit
are variable fields (``<*>``), unless all tokens of the line are: such a line
is compared as it stands.  The tree has a fixed depth: token count, then the leading
``DEPTH`` tokens.  Inside a leaf, positions where no token holds more than
half of the leaf's lines are variable as well; a line that agrees with the
leaf's constant tokens in at least ``SIMILARITY`` of its positions takes the
leaf's template, any other line is a template of its own.

A template recurs when it stands in enough documents that differ from each
other.  Copies count once: documents with the same set of lines are one
representative from the start, lines vote once per representative, and
representatives with the same set of templates count as one.  Lines of
recurring templates are dropped from every document - but a document that
consists of recurring templates alone is a copy as a whole: it is left as it
is to the document-level operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailforge.llm.common import small_enough
from retailforge.session import stage

DEPTH = 3
SIMILARITY = 0.7
#: representatives that a template needs, for lines of up to SHORT tokens and for longer ones
SHORT, MIN_SHORT, MIN_LONG = 3, 10, 3
SPACE = r"[ \t\x0b\f\r]+"
VARIABLE = r"[^ ]*[0-9][^ ]*"
#: leaves or templates up to this number are broadcast to the lines (rows of a few longs); more are joined by shuffle
BROADCAST_ROWS = 1_000_000
#: parts that the lines of one leaf are spread over
SALTS = 16


def _spaced(line: Column) -> Column:
    """A line with its tokens between single blanks; empty if it is white space alone."""
    odd = line.startswith(" ") | line.endswith(" ")
    for c in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)


def _masked(spaced: Column) -> Column:
    """A line whose variable fields are alike."""
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, VARIABLE, "<*>")).otherwise(spaced)


def _literal(masked: Column) -> Column:
    """No token but variable ones: masked, nothing would be left to compare."""
    return masked.startswith("<*>") & (F.replace(F.replace(masked, F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) == "")


def _forms(lines: Column) -> Column:
    """Lines -> ``l, t, m``: as they are, spaced, masked.  Nested, so that each form is made once per line."""
    spaced = F.transform(lines, lambda l: F.struct(l.alias("l"), _spaced(l).alias("t")))
    return F.transform(spaced, lambda x: F.struct(x["l"].alias("l"), x["t"].alias("t"), _masked(x["t"]).alias("m")))


def _size(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _lead(masked: Column) -> Column:
    return F.substring_index(masked, " ", DEPTH)


def _hash(form: Column) -> Column:
    """Hash of what a line is compared by."""
    return F.xxhash64(F.when(_literal(form["m"]), form["t"]).otherwise(form["m"]))


def _leaf(masked: Column) -> Column:
    return F.xxhash64(_size(masked), _lead(masked))


def _path(form: Column) -> Column:
    """Tree path of a line: token count, leading part, leaf, and the hash of all tokens; a literal line is a leaf of its own."""
    m = form["m"]
    return F.struct(_size(m).alias("n"), _lead(m).alias("lead"),
                    F.when(_literal(m), F.xxhash64(_size(m), form["t"])).otherwise(_leaf(m)).alias("leaf"), _hash(form).alias("line"))


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def _lines(text_col: str) -> Column:
    return F.split(F.col(f"`{text_col}`"), "\n", -1)


def parsed(docs: DataFrame, text_col: str) -> DataFrame:
    """``text, rep, paths, size`` per document: hash of the text and of its set of lines, tree paths, number of different lines.

    Lines of white space alone are left out; paths may repeat.
    """
    forms = F.filter(_forms(F.array_distinct(_lines(text_col))), lambda x: x["t"] != "")
    rows = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.xxhash64(F.col(f"`{text_col}`")).alias("text"), F.transform(forms, _path).alias("paths"))
    rows = rows.withColumn("set", F.array_distinct(F.transform("paths", lambda p: p["line"])))
    return rows.select("text", F.xxhash64(F.sort_array("set")).alias("rep"), "paths", F.size("set").alias("size"))


def representatives(rows: DataFrame) -> DataFrame:
    """``rep, n, leaf, line, size``: the different lines of every different set of lines."""
    lines = rows.select("rep", "size", F.explode("paths").alias("p"))
    return lines.groupBy("rep", F.col("p.leaf").alias("leaf"), F.col("p.line").alias("line")).agg(F.first("p.n").alias("n"), F.first("size").alias("size"))


def generalised_lines(docs: DataFrame, lines: DataFrame, text_col: str) -> DataFrame:
    """``(leaf, line)`` of the lines that take their leaf's template."""
    counts = lines.where(F.col("n") > DEPTH).groupBy("leaf", "line").agg(F.count("*").alias("m"))
    leaves = counts.groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("m").alias("total"))
    leaves = stage(leaves.where((F.col("variants") > 1) & (F.col("total") >= MIN_LONG)).select("leaf", "total"), "leaves")
    texts = (docs.where(F.col(f"`{text_col}`").isNotNull())
             .select(F.explode(_forms(F.array_distinct(_lines(text_col)))).alias("x"))
             .where((F.col("x.t") != "") & ~_literal(F.col("x.m"))).select(F.col("x.m").alias("t"))
             .select("t", _leaf(F.col("t")).alias("leaf")))
    known = _checked(leaves)
    texts = texts.join(known, "leaf").groupBy("leaf", "total", F.xxhash64("t").alias("line")).agg(F.first("t").alias("t"))
    variants = stage(texts.join(counts, ["leaf", "line"]).withColumn("t", F.split("t", " ", -1)), "leaf-variants")
    votes = (variants.select("leaf", "total", "m", F.posexplode("t").alias("p", "token")).where(F.col("p") >= DEPTH)
             .groupBy("leaf", "total", "p", "token").agg(F.sum("m").alias("m")).where(F.col("m") * 2 > F.col("total")))
    constant = votes.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("p", "token"))).alias("constant"))
    # the variants of one leaf may be many: its constant tokens go to SALTS parts of them
    constant = constant.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    agree = F.size(F.filter(F.sequence(F.lit(DEPTH), F.size("t") - 1),
                            lambda i: F.col("constant")[i] == F.element_at(F.col("t"), i + 1)))
    return (variants.withColumn("salt", F.pmod("line", F.lit(SALTS))).join(constant, ["leaf", "salt"])
            .where(agree + DEPTH >= F.size("t") * SIMILARITY).select("leaf", "line"))


def recurring_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """``k_text, dropped``: per different text the hashes of its lines whose template recurs."""
    rows = stage(parsed(docs, text_col), "parsed-lines")
    lines = stage(representatives(rows), "template-lines")
    general = stage(generalised_lines(docs, lines, text_col).withColumn("general", F.lit(True)), "generalised")
    named = lines.join(_checked(general), ["leaf", "line"], "left").withColumn("template", F.when(F.col("general"), F.lit(0)).otherwise(F.col("line")))
    # only representatives with a generalised line can have the templates of another one
    touched = named.where("general").select("rep").distinct()
    sets = named.join(_checked(touched), "rep", "left_semi").groupBy("rep").agg(F.collect_set(F.xxhash64("leaf", "template")).alias("templates"))
    sets = stage(sets.select("rep", F.xxhash64(F.sort_array("templates")).alias("same")), "template-sets")
    counts = (named.join(_checked(sets), "rep", "left").groupBy("leaf", "n", "template", F.coalesce("same", "rep").alias("same")).agg(F.lit(1).alias("one"))
              .groupBy("leaf", "n", "template").agg(F.count("*").alias("documents")))
    need = F.when(F.col("n") <= SHORT, MIN_SHORT).otherwise(MIN_LONG)
    recurring = stage(counts.where(F.col("documents") >= need).select("leaf", "template"), "recurring-templates")
    hit = named.join(_checked(recurring), ["leaf", "template"]).groupBy("rep", "size").agg(F.collect_set("line").alias("dropped"))
    hit = hit.where(F.size("dropped") < F.col("size")).select("rep", "dropped")
    return rows.select(F.col("text").alias("k_text"), "rep").distinct().join(hit, "rep").select("k_text", "dropped")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, n_lines, n_dropped, kept_text``: every row with its lines of recurring templates left out.

    ``row`` holds all columns unchanged.  Lines end at ``\\n``; empty lines
    are kept, and so is the text of a row without a recurring line, or with
    recurring lines only, byte for byte.  NULL text stays NULL with 0 lines.
    Repeated rows, and documents with the same lines in any order, count
    once towards what recurs.  An empty table gives no rows.
    """
    found = recurring_lines(docs, text_col)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.when(text.isNotNull(), F.xxhash64(text)).alias("t"))
    out = rows.join(found, rows["t"] == found["k_text"], "left").select("row", "text", F.split("text", "\n", -1).alias("lines"), "dropped")
    keep = F.transform(F.filter(_forms(F.col("lines")), lambda x: ~F.array_contains(F.col("dropped"), _hash(x))), lambda x: x["l"])
    out = out.withColumn("kept", F.when(F.col("dropped").isNotNull(), keep))
    return out.select("row", F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
                      F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias("n_dropped"),
                      F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"))
