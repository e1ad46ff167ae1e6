"""Codes to topics by a concordance of patterns: ranges, classes and expressions, the first match counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import stored
from .relational import forward_fill

LEVELS = ("L0", "L1", "L2", "L3")


def topics(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows (seq, TOPIC, USPC) with a code, and topic_des: the four levels joined.

    A topic's level is the number of its dots; levels are filled forward each on
    its own, so below a new upper level old deeper ones stay.
    """
    named = rows.withColumns({c: F.when(C.level_of("TOPIC") == k, C.topic_name("TOPIC")) for k, c in enumerate(LEVELS)})
    filled = forward_fill(named, LEVELS, order)
    return filled.where(F.col("USPC").isNotNull()).withColumn("topic_des", C.join_levels(LEVELS))


def expand_patterns(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """(seq, topic_des, pattern) of each pattern in USPC: lists split, 'code+' widened to its descendants.

    In a list with commas a code itself always counts; alone, 'code+' counts only
    through the tree. tree: cat_id, code, ancestor_codes.
    """
    part = F.explode(F.split("USPC", ";"))
    parts = rows.select("seq", "topic_des", part.alias("part"))
    slashed = F.split("part", "/")
    listed = F.contains("part", F.lit(","))
    parent = C.pad_left(F.trim(F.get(slashed, F.lit(0))), 3)
    subs = F.when(F.size(slashed) > 1, F.split(F.get(slashed, F.lit(1)), ",")).otherwise(F.array(F.lit(None).cast("string")))
    flat = parts.where(~listed | (F.size(slashed) > 1)).select("seq", "topic_des", listed.alias("listed"), parent.alias("parent"), F.explode_outer(subs).alias("sub"))
    code = F.replace(F.btrim("sub", F.lit("+")), F.lit("."), F.lit(""))
    flat = flat.withColumns({"wide": F.coalesce(F.contains("sub", F.lit("+")), F.lit(False)), "code": F.when(F.col("listed"), code).otherwise(F.trim(F.replace(F.trim(F.btrim(F.trim("sub"), F.lit("+"))), F.lit("."), F.lit(""))))})
    own = flat.where(~F.col("wide") | F.col("listed"))
    below = tree.select(F.col("cat_id").alias("parent"), F.col("code").alias("_below"), F.explode("ancestor_codes").alias("code"))
    widened = flat.where("wide").join(below, ["parent", "code"]).withColumn("code", F.col("_below"))
    both = own.select("seq", "topic_des", "parent", "code", "listed").unionByName(widened.select("seq", "topic_des", "parent", "code", "listed"))
    pattern = F.when(F.col("code").isNull(), F.col("parent")).otherwise(F.concat_ws("/", "parent", F.when(F.col("listed"), F.replace("code", F.lit(" "), F.lit(""))).otherwise(F.col("code"))))
    return both.select("seq", "topic_des", pattern.alias("pattern")).distinct()


def compile_patterns(patterns: DataFrame) -> DataFrame:
    """kind 0: a range within a class, compared as text; 1: an expression; 2: a whole class. Ranges of another form are left out."""
    parts = F.split("pattern", "[/-]")
    kind = F.when(F.contains("pattern", F.lit("-")), 0).when(~F.contains("pattern", F.lit("/")), 2).otherwise(1)
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"\+", ".*"), "various", ".*")
    out = patterns.select(
        "seq", "topic_des", kind.alias("kind"), F.get(parts, F.lit(0)).alias("parent"), F.get(parts, F.lit(1)).alias("lo"), F.get(parts, F.lit(2)).alias("hi"), quoted.alias("regex"), F.size(parts).alias("_n")
    )
    return out.where((F.col("kind") != 0) | (F.col("_n") == 3)).drop("_n")


def literal_factor(expression: str | None) -> str:
    """The longest text that every match of an expression holds, as far as it can be told; '' if none can.

    Groups and alternatives tell nothing; a character before a quantifier that lets it be missing doesn't count.
    """
    runs, run, k = [], "", 0
    text = expression or ""
    while k < len(text):
        ch = text[k]
        if ch == "\\":
            if text[k + 1 : k + 2].isalnum() or k + 1 == len(text):
                if text[k + 1 : k + 2] in ("Q", "E"):
                    return ""
                runs, run = [*runs, run], ""
            else:
                run += text[k + 1]
            k += 2
            continue
        if ch in "()|":
            return ""
        if ch == "[":
            end = text.find("]", k + 2)
            if end < 0 or "[" in text[k + 1 : end] or "\\" in text[k + 1 : end]:
                return ""
            runs, run, k = [*runs, run], "", end
        elif ch in "*?{":
            runs, run = [*runs, run[:-1]], ""
            k = max(k, text.find("}", k)) if ch == "{" else k
        elif ch in ".^$+":
            runs, run = [*runs, run], ""
        else:
            run += ch
        k += 1
    return max([*runs, run], key=len)


#: Characters of the grams by which codes meet expressions.
GRAM = 3


def matching(codes: DataFrame, expressions: DataFrame) -> DataFrame:
    """Distinct codes (code) with the expressions (regex, and other columns) that match anywhere in them.

    Each expression is filed under one gram of its literal factor, the one that fewest codes have; a code is
    looked up by its grams, and only what meets is tried. An expression with a gram that no code has is not
    tried at all; one without a factor meets every code.
    """
    factor = F.pandas_udf(lambda texts: texts.map(literal_factor), "string")
    own = stored(expressions.withColumns({"_id": F.monotonically_increasing_id(), "_factor": factor("regex")}), "expressions")
    size = F.least(F.char_length("_factor"), F.lit(GRAM))
    filed = own.select("_id", F.explode(F.array_distinct(_grams(F.col("_factor"), size))).alias("_gram"))
    sizes = sorted(r[0] for r in own.select(size).distinct().collect())  # GRAM + 1 at most
    found = F.flatten(F.array(*(_grams(F.col("code"), F.lit(n)) for n in sizes))) if sizes else F.array().cast("array<string>")
    looked = codes.select("code", F.explode(F.array_distinct(found)).alias("_gram"))
    often = looked.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    best = filed.join(often, "_gram", "left").groupBy("_id").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all")).where("_all")
    return looked.join(best, "_gram").join(own, "_id").where(F.regexp_like("code", F.col("regex"))).drop("_gram", "_id", "_factor", "_all")


def _grams(text: Column, size: Column) -> Column:
    """All grams of a size; size 0 gives the empty one."""
    last = F.char_length(text) - size + 1
    some = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, size))
    return F.when(size == 0, F.array(F.lit(""))).when(last < 1, F.array().cast("array<string>")).otherwise(some)


def first_match(df: DataFrame, raw: str, compiled: DataFrame, name: str = "est_description") -> DataFrame:
    """df with the topic of the first match: readings of the code in order, then rows of the concordance in order.

    Only distinct codes meet the patterns. Ranges and classes meet them by an equi-join on the class,
    expressions by an index of their literal factors (``matching``). The match goes back by an equi-join.
    """
    codes = df.select(raw).where(F.col(raw).isNotNull() & (F.col(raw) != "[]")).distinct()
    tried = codes.select(raw, F.posexplode(C.uspc_candidates(raw)).alias("pos", "c")).select(raw, "pos", C.candidate_code(F.col("c")).alias("code"))
    tried = tried.withColumns({"_class": F.substring_index("code", "/", 1), "_sub": F.when(F.contains("code", F.lit("/")), F.substring_index("code", "/", -1))})
    ranged, expressions = compiled.where("kind <> 1"), compiled.where("kind = 1")
    within = (F.col("kind") == 2) | ((F.col("_sub") >= F.col("lo")) & (F.col("_sub") <= F.col("hi")))
    by_class = tried.join(ranged, F.col("_class") == F.col("parent")).where(within)
    by_expression = tried.join(matching(tried.select("code").distinct(), expressions), "code")
    hits = by_class.select(raw, "pos", "seq", "topic_des").unionByName(by_expression.select(raw, "pos", "seq", "topic_des"))
    found = hits.groupBy(raw).agg(F.min_by("topic_des", F.struct("pos", "seq")).alias(name))
    return df.join(found.withColumnRenamed(raw, "_raw"), F.col(raw) == F.col("_raw"), "left").drop("_raw")
