"""Fill-in-the-middle samples, cut between words by joins of unit tables.

A text is a sequence of units: a word with the space before it, or space at the
end. The units of the texts that are cut are a table of (text, ordinal, length);
a window sums lengths up to each unit, requests (text, ordinals of two cuts) meet
them by ordinal, an aggregate has both offsets of a text, and substrings between
the offsets make the sample. No row but a text's own holds its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.sized import broadcast_if_small
from lexmill.sources.shared import bounded_batches, cut

SEED = 42
#: Shares in percent: of texts that are cut, and of those that put the suffix first.
CUT_SHARE, SPM_SHARE = 50, 80
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = "<[PSM]>"
#: Copies of a row that are dealt out together.
COPIES = 256
_KEY = ["_k1", "_k2"]


def _planned(docs: DataFrame, id_col: str, text_col: str, seed: int, cut_share: int, spm_share: int) -> DataFrame:
    """``doc_id``, ``text``, ``n``, ``form``, ``lo`` and ``hi`` (units before the middle, and before the suffix), and two hashes of id and text that name a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = [F.xxhash64(F.lit(k), "doc_id", "text").alias(name) for k, name in enumerate(_KEY)]
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), *named)
    a, b = h(1) % (F.col("n") + 1), h(2) % (F.col("n") + 1)
    whole = (F.col("text") == "") | F.col("text").rlike(_MARK) | (h(3) % 100 >= cut_share)
    form = F.when(whole, "plain").when(h(4) % 100 < spm_share, "spm").otherwise("psm")
    return rows.select("*", form.alias("form"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def cut_offsets(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Characters before two cuts of each text: keys, ``at_lo`` and ``at_hi``; a text whose cuts both stand at 0 has no row.

    ``texts`` has unique keys and ``text``, ``requests`` the same keys and the ordinals
    ``lo`` and ``hi``: a cut stands after so many units. Texts are dealt by key before
    they are taken apart, so their units never move.
    """
    units = texts.repartition(*_KEY).select(*_KEY, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    units = units.select(*_KEY, (F.col("at") + 1).cast("long").alias("ordinal"), F.length("unit").cast("long").alias("size"))
    upto = Window.partitionBy(*_KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    running = units.select(*_KEY, "ordinal", F.sum("size").over(upto).alias("chars"))
    met = running.join(requests, _KEY).where("ordinal = lo or ordinal = hi")
    return met.groupBy(*_KEY).agg(*[F.max(F.when(F.col("ordinal") == F.col(c), F.col("chars"))).alias(f"at_{c}") for c in ("lo", "hi")])


def _parts(text: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    return F.substring(text, F.lit(1), lo), F.substring(text, lo + 1, hi - lo), F.substring(text, hi + 1, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that a sample was made of: cut texts hold no marker, so the sample's markers part it exactly."""
    part = F.split(output, _MARK, -1)
    text = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(text)


def _sampled(cuts: DataFrame) -> DataFrame:
    """Rows of unique keys with ``prefix_chars``, ``middle_chars`` and ``output``."""
    offsets = cut_offsets(cuts.select(*_KEY, "text"), cuts.select(*_KEY, "lo", "hi"))
    zero = F.lit(0).cast("long")
    met = cuts.join(offsets, _KEY, "left").withColumns({"at_lo": F.coalesce("at_lo", zero).cast("int"), "at_hi": F.coalesce("at_hi", zero).cast("int")})
    before, middle, after = _parts(F.col("text"), F.col("at_lo"), F.col("at_hi"))
    psm = F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    return met.withColumns({"prefix_chars": F.col("at_lo").cast("long"), "middle_chars": (F.col("at_hi") - F.col("at_lo")).cast("long"), "output": output})


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """``doc_id``, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``output``, a row per input row.

    Hashes of ``seed`` and the id choose form and cuts, so rows that repeat an id
    share their form; those that repeat an id and a text are cut once, and their
    sample is dealt out as often as they occur. A null id hashes as the empty text.
    Null and empty texts give an empty plain sample; texts with a marker stay whole;
    very long texts are a row a word while they are cut; other columns of ``docs`` are
    not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = _planned(docs, id_col, text_col, seed, cut_share, spm_share)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    none = F.lit(None).cast("long")
    plain = rows.where("form = 'plain'").select("doc_id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    cuts = rows.where("form <> 'plain'")
    repeated = cut(cuts.groupBy(*_KEY).agg(F.count("*").alias("copies")).where("copies > 1"), "repeated")
    if repeated.isEmpty():
        return plain.unionByName(_sampled(cuts).select(columns))
    known = broadcast_if_small(repeated)
    once = cuts.join(known, _KEY, "left_anti")
    firsts = cuts.join(known, _KEY, "left_semi").groupBy(*_KEY).agg(*[F.first(c).alias(c) for c in cuts.columns if c not in _KEY])
    dealt = _sampled(firsts).join(known, _KEY).withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition(*_KEY, "part")
    again = dealt.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(copies, (part + 1) * {COPIES}) - 1)")))
    return plain.unionByName(_sampled(once).select(columns)).unionByName(again.select(columns))


def op11_relational_fim(spark, sf_dir: str) -> DataFrame:
    """Samples of all ``documents``, digested with the texts that they are turned back into."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = "('0x' || sha256('42:' || doc_id)[{a}:{b}])::BIGINT"
_HS = [_H.format(a=8 * k + 1, b=8 * k + 8) for k in range(4)]
OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
p AS (SELECT *, len(units) AS n, least({_HS[0]} % (len(units) + 1), {_HS[1]} % (len(units) + 1)) AS lo, greatest({_HS[0]} % (len(units) + 1), {_HS[1]} % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_HS[2]} % 100 >= {CUT_SHARE} THEN 'plain' WHEN {_HS[3]} % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS a, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:n], '') AS z FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""
