"""Fill-in-the-middle transformation by counted quantifiers.

``regexp_count`` gives the number n of tokens (a run of letters A-Z, a-z, or any other
single code point). Two cut points a <= b among 0..n come from a hash of the row's id. A
pattern of the row's own, ``(unit{a})(unit{b-a})(rest)`` with possessive quantifiers, then
captures prefix, middle and suffix in one match, and the replacement of the row's form puts
them in order between marks. Possessive counted groups are matched in a loop without
backtracking, so neither the stack nor the time of a very long text grows faster than
the text.

All of it is column expressions in one projection: no shuffle, no state, and a lost task is
rerun from its input. The choice depends on the id alone, so it does not change with
partitioning. Null texts are empty, and an empty text stays plain with n = 0. A null id is
hashed as the empty string. Repeated rows give repeated results; other columns of the input
are not returned, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import strings

MARKS = ("<P>", "<S>", "<M>")
TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: One token; the run of letters gives nothing back, so a count of units has one reading.
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
#: Order of prefix ($1), middle ($2) and suffix ($3) between the marks.
ORDERS = {"psm": "<P>$1<S>$3<M>$2", "spm": "<S>$3<P>$1<M>$2"}


def _hash(digest: Column, k: int) -> Column:
    """The k-th group of 8 hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
                   fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output), one row per document.

    ``form``: plain (the text as it is), psm or spm; plain rows have null lengths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    counted = (docs.select(F.col(id_col).alias("id"), F.coalesce(strings(docs, text_col), F.lit("")).alias("text"))
               .withColumns({"n": F.regexp_count("text", F.lit(TOKEN)).cast("long"), "h": digest}))
    marked = F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    x, y = _hash(F.col("h"), 1) % (F.col("n") + 1), _hash(F.col("h"), 2) % (F.col("n") + 1)
    cut = counted.withColumns({
        "a": F.least(x, y), "b": F.greatest(x, y),
        "form": F.when((F.col("text") == "") | marked | (_hash(F.col("h"), 3) % 100 >= fim_percent), "plain")
        .when(_hash(F.col("h"), 4) % 100 < spm_percent, "spm").otherwise("psm")})
    pattern = F.concat(F.lit(rf"\A({UNIT}{{"), F.col("a").cast("string"), F.lit(rf"}}+)({UNIT}{{"),
                       (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)((?s:.*+))\z"))
    order = F.when(F.col("form") == "spm", ORDERS["spm"]).otherwise(ORDERS["psm"])
    out = cut.withColumn("output", F.when(F.col("form") == "plain", F.col("text"))
                         .otherwise(F.regexp_replace("text", pattern, order)))
    parts = out.withColumn("parts", _parts(F.col("output"), F.col("form")))
    return parts.select(
        F.col("id").alias(id_col), "text", "n", "form", F.length(F.col("parts.prefix")).cast("long").alias("prefix_chars"),
        F.length(F.col("parts.middle")).cast("long").alias("middle_chars"), "output")


def _parts(output: Column, form: Column) -> Column:
    """Prefix, middle and suffix between the marks; null for plain rows.

    The text holds no mark, and no mark's end is another's beginning, so the marks found
    in the output are those that were put there."""
    between = lambda first, last: F.substring_index(F.substring_index(output, first, -1), last, 1)
    spm = form == "spm"
    return F.when(form != "plain", F.struct(
        F.when(spm, between("<P>", "<M>")).otherwise(between("<P>", "<S>")).alias("prefix"),
        F.substring_index(output, "<M>", -1).alias("middle"),
        F.when(spm, between("<S>", "<P>")).otherwise(between("<S>", "<M>")).alias("suffix")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = _parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(parts["prefix"], parts["middle"], parts["suffix"]))
