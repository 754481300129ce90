"""Fill-in-the-middle examples: a text is cut between units, and its parts change places.

Units are the matches of a pattern, left to right. They are relations, not loops: matches become rows,
windows sum their lengths, the requested cuts join them by unit ordinal, the offsets of a document meet
again, and the text is cut by substring. Rows are made on two levels, so that a text of n units makes some n / BLOCK rows:
first blocks of exactly BLOCK units (the last may have fewer), then the units of the blocks that hold a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a block.
BLOCK = 256
#: A unit is a code point.
CODE_POINT = "."
#: What stands before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are rearranged, and of those so many of 100 with the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def _unit(unit: str) -> str:
    """What the pattern does not match is a unit for each code point, so units cover the text."""
    return "(?s)." if unit == CODE_POINT else f"(?s)(?:{unit}|.)"


def _blocks(text: Column, unit: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{_unit(unit)}{{1,{BLOCK}}}"), F.lit(0))


def unit_count(text: Column, unit: str = CODE_POINT) -> Column:
    """Units of a text; those of its last block are counted, all others are full."""
    parts = _blocks(text, unit)
    last = F.regexp_count(F.try_element_at(parts, F.lit(-1)), F.lit(_unit(unit)))
    return F.when(F.length(text) == 0, 0).otherwise((F.size(parts) - 1) * BLOCK + last).cast("long")


def cut_offsets(cuts: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """(key, offsets): the code points before each cut, for every different key of cuts(key, text, ordinals array<long>).

    An ordinal asks for the place after so many units; 0 is the beginning. Equal keys have equal texts
    and ordinals; repeated ones are looked at once, and go before they are shuffled. Only the lengths of blocks, and the text of those that hold a cut, are shuffled.
    A key without an ordinal above 0 has no row."""
    once = cuts.select("key", "ordinals").dropDuplicates(["key"])
    asked = once.select("key", F.posexplode("ordinals").alias("which", "ordinal")).where("ordinal > 0")
    asked = asked.select("key", "which", F.expr(f"(ordinal - 1) div {BLOCK}").alias("within"), ((F.col("ordinal") - 1) % BLOCK).alias("last"))
    held = F.transform("ordinals", lambda o: F.floor((o - 1) / F.lit(BLOCK)).cast("int"))
    slim = lambda piece, i: F.struct(F.length(piece).alias("chars"), F.when(F.array_contains("held", i), piece).alias("piece"))
    found = cuts.select("key", held.alias("held"), _blocks(F.col("text"), unit).alias("pieces")).select("key", F.transform("pieces", slim).alias("blocks"))
    rows = found.dropDuplicates(["key"]).select("key", F.posexplode("blocks").alias("block", "b")).select("key", "block", "b.*")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.withColumn("before", F.coalesce(F.sum("chars").over(before), F.lit(0))).where(F.col("piece").isNotNull())
    met = blocks.join(asked, "key").where(F.col("block") - F.col("within") == 0)  # a key has as many of both as it has cuts; joined by it alone, blocks stay where they are
    units = met.select("key", "which", "before", "last", F.posexplode(F.regexp_extract_all("piece", F.lit(_unit(unit)), F.lit(0))).alias("nth", "unit")).where("nth <= last")
    so_far = Window.partitionBy("key", "which").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.col("before") + F.sum(F.length("unit")).over(so_far)).where("nth = last")
    return ends.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("which", "end"))).alias("offsets"))  # as many as the key has ordinals


def _draws(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output for every row of docs(doc_id, text).

    Draws come from the hash of the doc_id: two cuts among the n + 1 places between units, whether the text stays plain, and whether the suffix
    goes first (spm) or the prefix (psm). Plain too: empty texts and those that hold one of the three marks, which could not be told from a mark later.

    Null text: empty. Null doc_id: its decimals are empty, so all of them share their draws. Rows that repeat doc_id and text get
    equal results, a row each; one doc_id with several texts is cut text by text. Long texts make more rows, not larger ones.
    An empty table gives an empty result; other columns are ignored, whatever their names."""
    h1, h2, h3, h4 = _draws(F.col("doc_id"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))))
    rows = rows.withColumn("n", unit_count(F.col("text"), unit))
    rows = rows.withColumn("form", F.when((F.col("n") == 0) | marked | (h3 % 100 >= RATE), "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    offsets = cut_offsets(rows.where("form <> 'plain'").select("key", "text", F.array(F.least(one, two), F.greatest(one, two)).alias("ordinals")), unit)
    # by another spelling of the key the join has shuffles of its own, which can be split where one row repeats very often
    offsets = offsets.select(F.hex("key").alias("of"), "offsets")
    cut = rows.where("form <> 'plain'")
    cut = cut.join(offsets, F.hex("key") == F.col("of"), "left")
    at = [F.coalesce(F.element_at("offsets", k), F.lit(0)).cast("long") for k in range(2)]
    cut = cut.select("doc_id", "text", "n", "form", at[0].alias("prefix_chars"), (at[1] - at[0]).alias("middle_chars"))
    p, m, text = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int"), F.col("text")
    prefix, middle, suffix = text.substr(F.lit(1), p), text.substr(p + 1, m), text.substr(p + m + 1, F.length(text))
    spelled = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    psm, spm = (F.concat(*[F.lit(x) if isinstance(x, str) else x for x in spelled[form]]) for form in ("psm", "spm"))
    made = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    none = F.lit(None).cast("long")
    return made.unionByName(rows.where("form = 'plain'").select("doc_id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: marks are found again, since no rearranged text holds one."""

    def between(first: str, second: str | None) -> Column:
        begin = F.position(F.lit(first), output) + len(first)
        return output.substr(begin, (F.position(F.lit(second), output) if second else F.length(output) + 1) - begin)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b,
  CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT *, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
x AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, m) AS mid, substr(t, p + m + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN p END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN m END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM x
"""
