"""Vocabulary of tokens and catalog of labels.

Both are as large as the code dictionaries, not the records; their global
numbering runs over distinct codes only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c

# ---- Fixed values: coding systems in vocabulary order ----------------------
SYSTEMS = {"dx": "[DX]", "med": "[MED]", "lab": "[LAB]"}


def _fixed_tokens(spark: SparkSession) -> DataFrame:
    rows = [(0, i, t, "operational") for i, t in enumerate(fv.OPERATIONAL_TOKENS)]
    rows += [(1, i, t, "disposition") for i, t in enumerate(fv.DISPOSITION_TOKENS.values())]
    rows += [(2, i, t, "sex") for i, t in enumerate(fv.SEX_TOKENS.values())]
    return spark.createDataFrame(rows, "grp int, pos int, token string, family string")


def special_tokens(nonnumeric: DataFrame) -> DataFrame:
    """(token, family, index): fixed tokens, then those of non-numeric results.

    Seen sign tokens come first; `[topN]` is filled from the lowest to the
    highest seen N.
    """
    spark = nonnumeric.sparkSession
    rank = F.regexp_extract("token", r"^\[top(\d+)\]$", 1)
    seen = nonnumeric.select("token").distinct()
    signs = seen.filter(rank == "").withColumn("pos", F.coalesce(
        c.map_literal("token", {t: i for i, t in enumerate(fv.PRESET_RESULT_TOKENS.values())}),
        F.lit(99)))
    tops = (seen.filter(rank != "").select(rank.cast("int").alias("r"))
            .agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter(F.col("lo").isNotNull())
            .select(F.explode(F.sequence("lo", "hi")).alias("pos")))
    every = (_fixed_tokens(spark)
             .unionByName(signs.select(F.lit(3).alias("grp"), "pos", "token",
                                       F.lit("nonnumeric").alias("family")))
             .unionByName(tops.select(F.lit(4).alias("grp"), "pos",
                                      F.concat(F.lit("[top"), F.col("pos").cast("string"),
                                               F.lit("]")).alias("token"),
                                      F.lit("nonnumeric").alias("family"))))
    numbered = o.ordered_scan(every, [], ["grp", "pos", "token"], F.col("grp"),
                              {"index": o.row_number()})
    return numbered.select("token", "family", (F.col("index") - 1).cast("int").alias("index"))


def distinct_codes(*tables: DataFrame) -> DataFrame:
    """(system, code) pairs seen in any of the tables."""
    out = tables[0].select("system", "code")
    for t in tables[1:]:
        out = out.unionByName(t.select("system", "code"))
    return out.filter(F.col("code").isNotNull()).distinct()


def _pieces(code: Column, system: Column, sizes: dict[str, Sequence[int]]) -> Column:
    """Array of (segment, token) of a code, whole codes where a system has no sizes."""
    whole = F.array(F.struct(F.lit(1).alias("segment"), code.alias("token")))
    expr = None
    for name, parts in sizes.items():
        tokens = F.array(*[F.struct(F.lit(i).alias("segment"), t.alias("token"))
                           for i, t in enumerate(c.segment_code(code, parts), start=1)])
        expr = F.when(system == name, tokens) if expr is None else expr.when(system == name, tokens)
    return whole if expr is None else expr.otherwise(whole)


def token_width(sizes: dict[str, Sequence[int]], limit: int = 10) -> int:
    width = max(
        (len(sizes["dx"]) + 2) if sizes.get("dx") else 3,
        *[(len(sizes[s]) + 1) if sizes.get(s) else 2 for s in ("med", "lab")])
    if width > limit:
        raise ValueError(f"codes may have at most {limit - 2} segments")
    return width


def vocabulary(codes: DataFrame, specials: DataFrame, sizes: dict[str, Sequence[int]] | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """Token table (system, segment, token, index) and code map.

    `codes` has (system, code); provisional diagnoses carry the suffix. The
    code map has (system, original_value, tokenized_value, tokens).
    """
    sizes = {k: v for k, v in (sizes or {}).items() if v}
    width = token_width(sizes)
    system_no = c.map_literal("system", {s: i for i, s in enumerate(SYSTEMS)})
    prov = (F.col("system") == "dx") & F.col("code").endswith(fv.PROVISIONAL_SUFFIX)
    suffix = len(fv.PROVISIONAL_SUFFIX)
    base = F.when(prov, F.expr(f"substring(code, 1, length(code) - {suffix})")).otherwise(F.col("code"))
    segmented = F.col("system").isin(*sizes) if sizes else F.lit(False)
    # without segments a provisional code is a token of its own
    unit = F.when(segmented, base).otherwise(F.col("code"))
    listed = (codes.withColumns({"__prov": prov, "__base": base, "__sys": system_no})
              .withColumn("__unit", unit)
              .withColumn("__pieces", _pieces(F.col("__unit"), F.col("system"), sizes)))
    pieces = listed.select("system", "__sys", "code", F.explode("__pieces").alias("p")).select(
        "system", "__sys", "code", F.col("p.segment").alias("segment"), F.col("p.token").alias("token"))
    named = pieces.filter(F.col("token") != "")
    tokens = named.select("__sys", "system", "segment", "token").distinct()
    numbered = o.ordered_scan(tokens, [], ["__sys", "segment", "token"],
                              F.struct("__sys", "segment", F.substring("token", 1, 4)),
                              {"__rn": o.row_number()})
    n_special = specials.select(F.count(F.lit(1))).scalar()
    token_table = numbered.select(
        "system", "segment", "token",
        (F.col("__rn") - 1 + n_special).cast("int").alias("index"))

    placed = named.join(token_table, ["system", "segment", "token"])
    gathered = placed.groupBy("system", "code").agg(
        F.map_from_entries(F.collect_list(F.struct("segment", "index"))).alias("__idx"),
        F.array_sort(F.collect_list(F.struct("segment", "token"))).alias("__tok"))
    n_seg = max([1, *[len(v) for v in sizes.values()]])
    joined = gathered.join(listed.select("system", "code", "__prov"), ["system", "code"])
    system_token = c.map_literal("system", SYSTEMS)
    index_of = {t: i for i, t in enumerate(fv.OPERATIONAL_TOKENS)}
    raw = F.array(c.map_literal("system", {s: index_of[t] for s, t in SYSTEMS.items()}),
                  *[F.coalesce(F.try_element_at("__idx", F.lit(i)), F.lit(0)) for i in range(1, n_seg + 1)],
                  *[F.lit(0)] * (width - 1 - n_seg))
    prv = F.lit(index_of["[PRV]"])
    slot = F.array_position(raw, F.lit(0))
    tokens_col = F.when(
        F.col("__prov"),
        F.transform(raw, lambda x, i: F.when((i + 1) == slot, prv).otherwise(x))).otherwise(raw)
    text = F.concat_ws(",", system_token, F.transform("__tok", lambda s: F.when(
        F.col("__prov"), F.replace(s["token"], F.lit(fv.PROVISIONAL_SUFFIX), F.lit("")))
        .otherwise(s["token"])))
    code_map = joined.select(
        "system", F.col("code").alias("original_value"),
        F.concat(text, F.when(F.col("__prov"), F.lit(",[PRV]")).otherwise(F.lit("")))
        .alias("tokenized_value"),
        tokens_col.cast("array<int>").alias("tokens"))
    return token_table, code_map


def time_bin_texts(spark: SparkSession, small: int, large: int,
                   sections: Sequence = fv.TIME_BIN_SECTIONS) -> DataFrame:
    """(pos, text) of every time bin, in label order."""
    per_small, per_large = c.DAY // small, c.DAY // large
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    first = spark.range(per_small).select(
        F.col("id").alias("pos"),
        F.concat(F.lit("+ "), (F.col("id") * small).cast("string"), F.lit("-"),
                 (F.col("id") * small + small - 1).cast("string"), F.lit(" minutes")).alias("text"))
    out, offset = first, per_small
    for start, end, step in sections:
        n = c.section_bins(start, end, step)
        day = F.lit(start) + F.floor(F.col("id") / per_large) * step
        lo = F.pmod("id", F.lit(per_large)) * large
        hi = lo + large - 1
        days = F.concat(F.lit("+ "), day.cast("string"), F.lit(" days")) if step == 1 else F.concat(
            F.lit("+ "), day.cast("string"), F.lit("-"), (day + step - 1).cast("string"),
            F.lit(" days"))
        text = F.concat(days, F.lit(" & "), two(F.floor(lo / 60)), F.lit(":"),
                        two(F.pmod(lo, F.lit(60))), F.lit("-"), two(F.floor(hi / 60)), F.lit(":"),
                        two(F.pmod(hi, F.lit(60))))
        out = out.unionByName(spark.range(n * per_large).select(
            (F.col("id") + offset).alias("pos"), text.alias("text")))
        offset += n * per_large
    last = spark.range(1).select(F.lit(offset).cast("long").alias("pos"),
                                 F.lit(f"over {sections[-1][1]} days").alias("text"))
    return out.unionByName(last)


def catalog(specials: DataFrame, code_map: DataFrame, names: DataFrame, width: int,
            bins: int = 501, small: int = 10, large: int = 60,
            sections: Sequence = fv.TIME_BIN_SECTIONS) -> DataFrame:
    """(label, kind, family, original_value, text, tokenized_value, tokens) of all classes.

    Order: special tokens, diagnoses, medications, labs, numeric bins, time
    bins. `names` has (system, item_code, item_name).
    """
    spark = specials.sparkSession
    none = F.array().cast("array<int>")
    special = specials.select(
        F.lit(0).alias("grp"), F.col("index").cast("long").alias("pos"), F.lit("").alias("key"),
        F.lit("special").alias("kind"), "family", F.col("token").alias("original_value"),
        c.token_description("token").alias("text"), F.col("token").alias("tokenized_value"),
        F.array("index").cast("array<int>").alias("tokens"))
    base = F.replace("original_value", F.lit(fv.PROVISIONAL_SUFFIX), F.lit(""))
    coded = (code_map.withColumn("__b", base)
             .join(names.select(F.col("system"), F.col("item_code").alias("__b"), "item_name"),
                   ["system", "__b"], "left"))
    prov = F.col("original_value").endswith(fv.PROVISIONAL_SUFFIX)
    name = F.coalesce("item_name", "__b")
    codes = coded.select(
        (c.map_literal("system", {s: i for i, s in enumerate(SYSTEMS)}) + 1).alias("grp"),
        F.lit(0).cast("long").alias("pos"), F.col("original_value").alias("key"),
        F.col("system").alias("kind"), F.col("system").alias("family"), "original_value",
        F.when(prov, F.concat(name, F.lit(" " + fv.PROVISIONAL_SUFFIX))).otherwise(name).alias("text"),
        "tokenized_value", "tokens")
    numeric = spark.range(bins).select(
        F.lit(4).alias("grp"), F.col("id").alias("pos"), F.lit("").alias("key"),
        F.lit("numeric").alias("kind"), F.lit("numeric").alias("family"),
        c.uniform_step(F.col("id"), bins).cast("string").alias("original_value"),
        F.concat((c.logit_quantile(F.col("id"), bins) * 100).cast("string"),
                 F.lit(" percentile")).alias("text"),
        F.lit("").alias("tokenized_value"), none.alias("tokens"))
    times = time_bin_texts(spark, small, large, sections).select(
        F.lit(5).alias("grp"), "pos", F.lit("").alias("key"), F.lit("time").alias("kind"),
        F.lit("time").alias("family"), F.lit("").alias("original_value"), "text",
        F.lit("").alias("tokenized_value"), none.alias("tokens"))
    every = special.unionByName(codes).unionByName(numeric).unionByName(times)
    padded = every.withColumn("tokens", F.concat(
        "tokens", F.array_repeat(F.lit(0), F.lit(width) - F.size("tokens"))))
    # One window: the catalog has the size of the code dictionaries.
    number = F.row_number().over(Window.orderBy("grp", "pos", "key"))
    return padded.withColumn("label", number).select((F.col("label") - 1).cast("int").alias("label"), "kind", "family",
                           "original_value", "text", "tokenized_value", "tokens")


def catalog_slice(table: DataFrame, name: str) -> DataFrame:
    """Rows of one family: full, all_codes, all_categorical, a kind or a family."""
    if name == "full":
        return table
    if name == "all_codes":
        return table.filter(F.col("kind").isin(*SYSTEMS))
    if name == "all_categorical":
        return table.filter(F.col("kind").isin("special", *SYSTEMS))
    return table.filter((F.col("kind") == name) | (F.col("family") == name))


def label_ranges(table: DataFrame) -> DataFrame:
    """Lowest and highest label per kind and family."""
    return table.groupBy("kind", "family").agg(
        F.min("label").alias("first_label"), F.max("label").alias("last_label"),
        F.count(F.lit(1)).alias("n_labels"))
