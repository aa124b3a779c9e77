"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling. Spark SQL only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.scratch import Scratch

#: The sides that are raked, in order.
SIDES = ("source", "lang", "topic")
#: Without target shares a side gets its own shares raised to this power and scaled to one.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS = 12
#: Under bounds so many rounds make a part, whose cells are written; parts follow until less than SETTLED of the weight moves.
PART_ROUNDS, PARTS, SETTLED = 2, 40, 1e-6
#: Up to so many cells (counted) fitting runs in one task and the join is a broadcast; beyond, both shuffle.
FEW_CELLS = 100_000
_BITS = 48
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


def word_count(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``, the token weight used without a tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def token_weight(text: str = "text") -> Column:
    """Words, and the characters of scripts that put no spaces between words: a weight that any language has."""
    return word_count(text) + F.coalesce(F.regexp_count(text, F.lit(_UNSPACED)), F.lit(0))


def form(text: str = "text", words: Column | None = None) -> Column:
    """A topic for tables without one, by the form of a text: note, listing, markup or article."""
    words = word_count(text) if words is None else words
    lines = F.coalesce(F.regexp_count(text, F.lit("\n")), F.lit(0)) + 1
    signs = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0))
    return F.when(words < 50, "note").when(10 * signs > words, "markup").when(words < 8 * lines, "listing").otherwise("article")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*SIDES).agg(F.sum("tokens").cast("double").alias("base"))


def _wished(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None) -> DataFrame:
    """Adds total, the wish of each side's value (scaled to the total) and a mark on one cell of each value."""
    total = F.sum("base").over(Window.partitionBy())
    out = cells.withColumn("total", total).withColumn("weight", F.col("base"))
    for side in SIDES:
        own = F.sum("base").over(Window.partitionBy(side))
        if targets and side in targets:
            wish = F.lit(0.0)
            for value, share in targets[side].items():
                wish = F.when(F.col(side).eqNullSafe(F.lit(value)), float(share)).otherwise(wish)
            wish = F.when(own > 0, wish).otherwise(0.0)
        else:
            wish = F.when(own > 0, F.pow(own / F.col("total"), F.lit(EXPONENTS[side]))).otherwise(0.0)
        out = out.withColumn(f"wish_{side}", wish)
        out = out.withColumn(f"one_{side}", F.row_number().over(Window.partitionBy(side).orderBy(*SIDES)) == 1)
        sum_ = F.sum(F.when(F.col(f"one_{side}"), F.col(f"wish_{side}"))).over(Window.partitionBy())
        out = out.withColumn(f"wish_{side}", F.when(sum_ > 0, F.col(f"wish_{side}") / sum_ * F.col("total")).otherwise(0.0))
    return out


def fit(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Rake the token weights of cells (source, lang, topic, base) to shares of each side; adds ``weight``.

    ``targets`` gives shares by side and value; values it does not name keep no weight, and shares are
    scaled to one over the values that hold tokens. A side it does not name gets EXPONENTS. Null is a
    value like others. The weights keep the total of ``base``; the last side is met exactly, the others as
    closely as ``rounds`` rounds bring them.
    """
    out = _wished(cells, targets)
    for _ in range(rounds):
        for side in SIDES:
            now = F.sum("weight").over(Window.partitionBy(side))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") / now * F.col(f"wish_{side}")).otherwise(0.0))
    return out.select(*SIDES, "base", "weight")


def fit_within(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, keep_share: float, few: bool = True
) -> DataFrame:
    """As ``fit``, with no cell above ``base / keep_share``: a draw cannot give more than all of a cell.

    What a full cell cannot take goes to the cells of its value that have room. A value whose cells are all
    full stays below its wish, and the other values of its side share the rest in the proportions of their
    wishes. If all cells that have a wish on every side are full, the total is below that of ``base``. Adds
    ``weight`` and, for each side, ``wish`` (before bounds) and ``goal`` (what its values can hold).
    """
    scratch = Scratch(cells.sparkSession)

    def written(df: DataFrame) -> DataFrame:
        out = scratch.keep(df)
        return out.coalesce(1) if few else out

    out = _wished(cells, targets)
    wished = F.col("base") > 0
    for side in SIDES:
        wished = wished & (F.col(f"wish_{side}") > 0)
    out = out.withColumn("cap", F.when(wished, F.col("base") / F.lit(float(keep_share))).otherwise(0.0))
    out = out.withColumn("total", F.least("total", F.sum("cap").over(Window.partitionBy())))
    for side in SIDES:
        wish, one = F.col(f"wish_{side}"), F.col(f"one_{side}")
        out = out.withColumn("_room", F.sum("cap").over(Window.partitionBy(side)))
        out = out.withColumn("_full_at", F.when(one & (wish > 0), F.col("_room") / wish))
        up = Window.partitionBy().orderBy(F.col("_full_at").asc_nulls_last(), *(F.col(s).asc_nulls_first() for s in SIDES))
        down = Window.partitionBy().orderBy(F.col("_full_at").desc_nulls_first(), *(F.col(s).desc_nulls_last() for s in SIDES))
        mine = F.col("_full_at").isNotNull()
        full = F.coalesce(F.sum(F.when(mine, F.col("_room"))).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        open_ = F.sum(F.when(mine, wish)).over(down.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_level", F.when(mine, (F.col("total") - full) / open_))
        level = F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(Window.partitionBy())
        most = F.max("_full_at").over(Window.partitionBy())
        out = out.withColumn(f"goal_{side}", F.least(F.col("_room"), F.coalesce(level, most, F.lit(0.0)) * wish))
    out = out.withColumn("weight", F.when(F.col("cap") > 0, F.col("base")).otherwise(0.0))
    sides = [f"{kind}_{side}" for kind in ("wish", "goal") for side in SIDES]
    columns = [*SIDES, "base", "cap", "weight", *sides]
    out = written(out.select(columns))
    for _ in range(PARTS):
        out = written(_rounds_within(out).select(*columns, "before"))
        held, before = F.least("weight", "cap"), F.least("before", "cap")
        moved, whole = out.agg(F.sum(F.abs(held - before)), F.sum(held)).first()
        out = out.drop("before")
        if not whole or moved <= SETTLED * whole:
            break
    return out.select(*SIDES, "base", F.least("weight", "cap").alias("weight"), *sides)


def _rounds_within(cells: DataFrame) -> DataFrame:
    """Some rounds over cells whose ``weight`` counts as ``cap`` where it is more; ``before`` is the weight they had."""
    out = cells.withColumn("before", F.col("weight"))
    for _ in range(PART_ROUNDS):
        for side in SIDES:
            own, goal = Window.partitionBy(side), F.col(f"goal_{side}")
            is_full = F.col("weight") >= F.col("cap")
            out = out.withColumns({
                "_full": F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).over(own),
                "_open": F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).over(own),
                "_all": F.sum("weight").over(own),
            })
            grow = (F.col("_open") > 0) & (goal > F.col("_full"))
            shrink = (F.col("_all") > 0) & (F.col("_full") + F.col("_open") > goal)
            factor = F.when(grow, (goal - F.col("_full")) / F.col("_open")).when(shrink, goal / F.col("_all")).otherwise(1.0)
            out = out.withColumn("weight", F.col("weight") * factor)
    return out


def draw(id_col: str, text_col: str, seed: int) -> Column:
    """A number in [0, 1) for each document, from a hash of its id (of its text if it has none)."""
    key = F.concat_ws("-", F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)


def _fitted(docs: DataFrame, targets, keep_share: float, text_col: str, topic: Column | None, words: Column, bounded: bool) -> tuple[DataFrame, bool]:
    """The fitted cells, written, and whether they are few."""
    spark = docs.sparkSession
    sides = docs.select(F.col("source").cast("string"), F.col("lang").cast("string"), words.alias("tokens"), F.col(text_col).alias("_text"))
    cells = Scratch(spark).keep(_cells(sides.withColumn("topic", form("_text", F.col("tokens")) if topic is None else topic)))
    few = cells.count() <= FEW_CELLS
    cells = cells.coalesce(1) if few else cells
    return Scratch(spark).keep(fit_within(cells, targets, keep_share, few) if bounded else fit(cells, targets)), few


def calibrate(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep_share: float = 0.5,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    tokens: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Probabilities that bring a corpus to target shares of source, language and topic, and the draw.

    Returns ``document`` (the input row as a struct), source, lang, topic, n_tokens, ratio (fitted over
    own weight of the cell), probability (keep_share * ratio, at most 1), sampled and sample_weight
    (ratio / probability: what the draw could not give). With ``bounded`` no probability is cut: cells are
    fitted under the bound (``fit_within``), so the drawn rows themselves meet all targets that can be
    reached at keep_share and each sample_weight is 1 / keep_share; ``shares`` tells which cannot. A row for each input row; one hash draw per
    document, so rows that share an id are drawn together and a rerun draws the same. Null sides are a
    value of their own; a null text has no tokens; a cell without tokens has ratio 1; an empty table
    gives an empty result; columns of any name stay inside the struct.
    """
    words = word_count(text_col) if tokens is None else tokens
    rows = docs.select(
        F.struct(*docs.columns).alias("document"), F.col("source").cast("string"), F.col("lang").cast("string"),
        words.alias("tokens"), F.col(text_col).alias("_text"), draw(id_col, text_col, seed).alias("_draw"),
    )
    rows = rows.withColumn("topic", form("_text", F.col("tokens")) if topic is None else topic).drop("_text")
    fitted, few = _fitted(docs, targets, keep_share, text_col, topic, words, bounded)
    fitted = fitted.select(*(F.col(s).alias(f"_{s}") for s in SIDES), F.when(F.col("base") > 0, F.col("weight") / F.col("base")).otherwise(1.0).alias("ratio"))
    same = [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in SIDES]
    out = rows.join(F.broadcast(fitted) if few else fitted, same[0] & same[1] & same[2], "left")
    out = out.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * keep_share))
    return out.select(
        "document", *SIDES, F.col("tokens").alias("n_tokens"), "ratio", "probability", (F.col("_draw") < F.col("probability")).alias("sampled"),
        F.when(F.col("probability") > 0, F.col("ratio") / F.col("probability")).otherwise(0.0).alias("sample_weight"),
    )


def shares(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    keep_share: float = 0.5,
    text_col: str = "text",
    topic: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """What the bounded draw gives: side, value, its share of the tokens, wished, expected in the draw, and reached.

    ``reached`` is false where the expected share is off the wished one by more than a hundredth of it.
    """
    fitted, _ = _fitted(docs, targets, keep_share, text_col, topic, token_weight(text_col) if tokens is None else tokens, True)
    out = None
    for side in SIDES:
        rows = fitted.groupBy(F.lit(side).alias("side"), F.col(side).alias("value")).agg(
            F.sum("base").alias("share"), F.max(f"wish_{side}").alias("wished"), F.sum("weight").alias("expected")
        )
        out = rows if out is None else out.unionByName(rows)
    whole = Window.partitionBy("side")
    for name in ("share", "wished", "expected"):
        sum_ = F.sum(name).over(whole)
        out = out.withColumn(name, F.when(sum_ > 0, F.col(name) / sum_).otherwise(0.0))
    return out.withColumn("reached", F.abs(F.col("expected") - F.col("wished")) <= F.col("wished") / 100)


def sample(docs: DataFrame, **how) -> DataFrame:
    """The documents of the bounded draw, with the columns they came with; tokens are weighed by ``token_weight``."""
    how = {"bounded": True, "tokens": token_weight(how.get("text_col", "text")), **how}
    return calibrate(docs, **how).filter("sampled").select("document.*")
